"""File sources, publishing, task tables, scoring and streaming state."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.functions.text import instruction_records
from flowloom.operators import evaluation as EV
from flowloom.operators import packets as W
from flowloom.operators import sampling as SP
from flowloom.operators import scoring as SC
from flowloom.plans import sweep as SW
from flowloom.plans.evaluation_queries import load_rule
from flowloom.plans.streaming_queries import stream_of
from flowloom.session import new_folder
from flowloom.sources import tables as IO
from flowloom.streaming import stateful as ST


def test_delimited_edges(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text('a,b,label\n1,2,"x,y"\n4,5\n6,7,8,9\n,3,z\n')
    df = IO.read_flow_csv(spark, str(tmp_path), None)
    assert {tuple(r) for r in df.collect()} == {(1.0, 2.0, "x,y"), (4.0, 5.0, None), (None, 3.0, "z")}
    with pytest.raises(FileNotFoundError):
        IO.read_flow_csv(spark, str(tmp_path / "nothing"))


def test_separators(spark, tmp_path):
    for name, text in (("c", "a,b\n"), ("s", "a;b\n"), ("t", "a\tb\n"), ("p", "a|b\n"), ("one", "a\n")):
        (tmp_path / name).write_text(text)
    assert [IO.sniff_separator(spark, str(tmp_path / n)) for n in ("c", "s", "t", "p", "one")] == [",", ";", "\t", "|", ","]


def test_instruction_array(spark, tmp_path):
    rows = [{"instruction": "i", "input": "x", "output": "y"}, {"instruction": "j", "input": "x", "output": "z"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    for name in ("array.json", "lines.json"):
        assert [r.asDict() for r in IO.read_instructions(spark, str(tmp_path / name)).orderBy("output").collect()] == rows


def test_merge_by_position_and_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    schema = spark.createDataFrame([], "x double, y double").schema
    assert sorted(tuple(r) for r in IO.merge_parts(spark, str(tmp_path), schema).collect()) == [(1.0, 2.0), (3.0, 4.0)]
    assert sorted(tuple(r) for r in IO.merge_parts(spark, str(tmp_path), schema, "strict").collect()) == [(1.0, 2.0), (4.0, 3.0)]


def test_merge_keeps_rows_of_files_with_other_columns(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,note,a\n3,x,4\nb,note,a\n5,a,6\n")
    (tmp_path / "3.csv").write_text("b\n7\n")
    rows = IO.merge_parts(spark, str(tmp_path), schema, "strict").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == [(1.0, 2.0), (4.0, 3.0), (6.0, 5.0), (None, 7.0)]
    (tmp_path / "4.csv").write_text("8,9\n")
    with pytest.raises(ValueError, match="no header"):
        IO.merge_parts(spark, str(tmp_path), schema, "strict")


def test_replace_folder(spark, tmp_path):
    old, new = str(tmp_path / "set"), str(tmp_path / "set-new")
    spark.range(3).write.parquet(old)
    spark.range(5).write.parquet(new)
    IO.replace_folder(spark, new, old)
    assert spark.read.parquet(old).count() == 5 and not (tmp_path / "set-new").exists()


def test_publish_skips_and_guards(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"), F.lit("c").alias("label"))
    rows = SP.stratified_split(instruction_records(df, keep=["k"]), "k", by="output").drop("k")
    folder = new_folder(spark, "t")
    assert not SW.is_published(spark, folder, 1)
    assert SW.publish(rows, folder, ["x"], "src", True) == SW.SUCCESS
    assert SW.publish(rows, folder, ["x"], "src", True) == SW.SKIPPED
    assert SW.read_prepared(spark, folder, 1).count() == 40
    with pytest.raises(ValueError):
        SW.read_prepared(spark, folder, 2)
    meta = IO.read_metadata(spark, folder).first()
    assert (meta.total_samples, meta.train_samples, meta.test_samples, meta.class_distribution) == (40, 28, 6, {"c": 40})


def test_sweep_isolates_failures(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("double").alias("Rate"), (F.col("id") % 7).cast("double").alias("IAT"),
        (F.col("id") % 5).cast("double").alias("Std"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    base = new_folder(spark, "sweep")
    from flowloom.operators.selection import Forest

    status, used = SW.sweep(df, "k", [2, 500], lambda n: f"{base}/{n}", "src", (Forest(3, 3),))
    assert {(r.n_features, r.status) for r in status.collect()} == {(2, "SUCCESS"), (500, "FAILED")}
    assert len(used[2]) == 2
    with pytest.raises(ValueError):
        SW.sweep(df, "k", [0], str, "src")


def test_phase_report(spark):
    rows = [(1, "preprocessing", "SUCCESS"), (1, "training", "SUCCESS"), (2, "preprocessing", "SKIPPED"), (2, "training", "FAILED"),
            (3, "preprocessing", "FAILED"), (4, "preprocessing", "SUCCESS")]
    report = SW.phase_report(spark.createDataFrame(rows, "n_features int, task_type string, status string"))
    assert {r.n_features: (r.training, r.result) for r in report.collect()} == {
        1: ("OK", "COMPLETE"), 2: ("KO", "PARTIAL"), 3: ("SKIP", "FAILED"), 4: ("KO", "PARTIAL")}
    assert tuple(SW.phase_totals(report).first()) == (4, 3, 1, 1)


def test_scoring(spark):
    assert SC.score_one(spark, {"IAT": 0.1, "Rate": 5.0}, load_rule) == "Benign"
    assert SC.score_one(spark, {"IAT": 2.0}, load_rule) == "Unknown"


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "true string, predicted string")
    pairs = EV.pair_counts(df)
    got = {r.label: (r.precision, r.recall, round(r.f1, 6), r.support) for r in EV.per_class(pairs).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.5, 1.0, 0.666667, 1), "c": (0.0, 0.0, 0.0, 1)}
    assert sum(r.n for r in EV.confusion(pairs).collect()) == 4 and EV.confusion(pairs).count() == 9
    assert EV.accuracy(df).first()[0] == 0.5


def test_report_and_evaluation_files(spark):
    df = spark.createDataFrame([("a", "a", 0.5), ("a", "b", 1.5)], "true string, predicted string, t double")
    lines = {(r.section, r.line_no): r.text for r in EV.report(df, "t").collect()}
    assert lines[("OVERALL PERFORMANCE", 1)] == "Accuracy: 0.5000"
    assert lines[("INFERENCE PERFORMANCE", 6)] == "Throughput: 1.00 samples/second"
    assert lines[("CLASS DISTRIBUTION", 1)] == "a: 2 samples (100.0%)"
    assert lines[("PER-CLASS PERFORMANCE", 1)] == f"{'a':<20} {1.0:<10.4f} {0.5:<10.4f} {2 / 3:<10.4f} {2:<10}"
    folder = new_folder(spark, "eval")
    EV.write_evaluation(df, folder, "t")
    assert spark.read.json(f"{folder}/metrics").count() == 5


# ---- streaming -------------------------------------------------------------------------------------


def two_bursts(make_packets):
    """A flow that pauses for 10 minutes, and a late packet at the end."""
    times = [0, 1, 2, 602, 603, 604, 900, 3]
    return make_packets([dict(ts_us=1_000_000_000 + t * 1_000_000) for t in times])


def run_flow(spark, df, steps=8, **kw):
    folder = new_folder(spark, "flow")
    query = ST.flow_features(stream_of(spark, df, "packet_no", steps, 1), folder, **kw)
    query.awaitTermination()
    return {r.packet_no: r.flow_packets for r in ST.read_output(spark, folder).collect()}


def test_flow_state_without_expiry(spark, make_packets):
    assert run_flow(spark, two_bursts(make_packets)) == {i: i + 1 for i in range(8)}


def test_idle_flows_expire_and_late_rows_drop(spark, make_packets):
    got = run_flow(spark, two_bursts(make_packets), idle_seconds=120, delay_seconds=60)
    # A flow is forgotten once it has been silent for more than 120 s.
    assert got[2] == 3 and got[4] == got[3] + 1 and 7 not in got


def test_expiry_does_not_depend_on_micro_batches(spark, make_packets):
    df = two_bursts(make_packets).filter("packet_no < 7")
    for steps in (1, 2, 5):
        assert run_flow(spark, df, steps, idle_seconds=120, delay_seconds=60) == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 3, 6: 1}


def test_streams_agree_with_batch_after_a_restart(spark, make_packets):
    rows = [dict(ts_us=1_000_000 * (i * 7 % 50), ip_proto=(6, 17, 1)[i % 3], frame_len=60 + i % 11, capture_id="ab"[i % 2])
            for i in range(97)]
    df = make_packets(rows)
    blocks = W.capture_times(W.blocks_of(df))
    batch = W.rates(W.directions(W.flow_runs(W.window_statistics(blocks)))).df
    for run, columns in (
        (ST.flow_features, ["flow_us", "flow_packets", "flow_bytes", "dst_to_src_pkt", "rate", "srate"]),
        (ST.capture_features, ["iat_us", "cumulative_us"]),
        (ST.window_features, ["w_sum", "w_min", "w_max", "w_std", "w_covariance", "w_magnitude"]),
    ):
        source, folder = new_folder(spark, "source"), new_folder(spark, "out")
        for low, high in ((0, 30), (31, 96)):  # the second run goes on from the checkpoint of the first
            df.filter(F.col("packet_no").between(low, high)).coalesce(1).write.mode("append").parquet(source)
            run(spark.readStream.schema(df.schema).parquet(source), folder).awaitTermination()
        cells = ["packet_no", *[F.round(c, 6).alias(c) for c in columns]]
        got = ST.read_output(spark, folder).select(*cells).orderBy("packet_no").collect()
        assert got == batch.select(*cells).orderBy("packet_no").collect(), run.__name__


def test_capped_rows_without_class_and_with_gaps(spark):
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2], None if i % 3 else 2**60 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label string, n bigint")
    folder = new_folder(spark, "caps")
    ST.capped_rows(stream_of(spark, df, "id", 4, 1), folder, 7, "label", "id").awaitTermination()
    want = [r for c in "ab" for r in [x for x in rows if x[1] == c][:7]]
    assert sorted(map(tuple, ST.read_output(spark, folder).collect())) == sorted(want)


def test_blanks_in_names_survive(spark):
    assert S.snake("Protocol Type") == "protocol_type"
