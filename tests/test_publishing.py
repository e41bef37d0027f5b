"""Publishing by version, arrays of records, counts without a job, and sketches."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators import packets as W
from flowloom.operators import statistics as ST
from flowloom.plans import sweep as SW
from flowloom.plans.catalog import QUERIES
from flowloom.sources import tables as IO
from flowloom.sources import versions as V


def records(spark, n, word="x"):
    return spark.createDataFrame(
        [("i", f"{word}{i}", "a" if i % 2 else "b", ("train", "validation", "test")[i % 3]) for i in range(n)],
        "instruction string, input string, output string, split string")


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["records", "metadata", "switch", "previous pointer", "pointer", "clean-up"])
def test_a_crash_at_any_step_leaves_a_whole_data_set(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "set")
    assert SW.publish(records(spark, 12), folder, ["f"], "s", False) == SW.SUCCESS

    def crash(*a, **k):
        raise Crash

    write_name = V._write_name
    with monkeypatch.context() as m:
        if step == "records":
            m.setattr(IO, "write_splits", crash)
        elif step == "metadata":
            m.setattr(IO, "write_metadata", crash)
        elif step == "switch":
            m.setattr(SW, "switch_to", crash)
        elif step == "clean-up":
            m.setattr(V, "remove_others", crash)
        else:
            wanted = V.PREVIOUS if step == "previous pointer" else V.POINTER
            m.setattr(V, "_write_name", lambda s, f, pointer, n: crash() if pointer == wanted else write_name(s, f, pointer, n))
        with pytest.raises(Crash):
            SW.publish(records(spark, 30, "y"), folder, ["f", "g"], "s", False)
    n, width = (30, 2) if step == "clean-up" else (12, 1)
    assert SW.read_prepared(spark, folder, width).count() == n
    assert IO.read_metadata(spark, folder).first()["total_samples"] == n
    assert SW.publish(records(spark, 9, "z"), folder, ["f", "g", "h"], "s", False) == SW.SUCCESS
    assert SW.read_prepared(spark, folder, 3).count() == 9
    versions = [d for d in os.listdir(folder) if d.startswith("v-")]
    assert len(versions) == 2  # the current one and the one before it


def test_records_and_metadata_of_one_version_only(spark, tmp_path):
    folder = str(tmp_path / "plain")
    IO.write_splits(records(spark, 6), folder)  # a folder without versions is read as it is
    assert IO.read_split(spark, folder, "train").count() == 2 and V.current(spark, folder) == folder


def test_arrays_are_cut_into_records(spark, tmp_path):
    rows = [{"instruction": "i", "input": f"a {{b}}, \"c\" {i}", "output": "o"} for i in range(400)]
    tricky = [{"instruction": "i", "input": "}, {", "output": "p"}, {"instruction": "i", "input": "x\"}, {\"", "output": "q"}]
    (tmp_path / "compact.json").write_text(json.dumps(rows))
    (tmp_path / "indented.json").write_text("\n" + json.dumps(rows, indent=4) + "\n")
    (tmp_path / "tight 100%.json").write_text(json.dumps(rows, separators=(",", ":")))
    (tmp_path / "tricky.json").write_text(json.dumps([*tricky, *rows[:3]]))
    mixed = ", ".join(json.dumps(r) for r in rows[:5]) + " ,\n" + ",".join(json.dumps(r) for r in rows[5:9])
    (tmp_path / "changing separators.json").write_text(f" [ {mixed} ] ")
    (tmp_path / "one.json").write_text(json.dumps(rows[:1]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows[:7])))
    got = sorted((r.input, r.output) for r in IO.read_instructions(spark, str(tmp_path)).collect())
    want = sorted((r["input"], r["output"]) for r in [*rows * 3, *rows[:9], *tricky, *rows[:3], *rows[:1], *rows[:7]])
    assert got == want


def test_an_array_is_many_tasks(spark, tmp_path):
    rows = [{"instruction": "i", "input": "x" * 50, "output": str(i)} for i in range(2_000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = IO.read_instructions(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 4
        assert {int(r.output) for r in df.collect()} == set(range(2_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_steps_are_counted_without_a_job(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    tracker = spark.sparkContext.statusTracker()

    def jobs(run):
        group = f"g{run.__name__}"
        spark.sparkContext.setJobGroup(group, "")
        run()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    counts = ST.StepCounts()

    def plain():
        df.filter("x < 3").drop("x").write.parquet(str(tmp_path / "a"))

    def counted():
        small = counts.step("kept", counts.step("read", df).filter("x < 3"))
        small.drop("x").write.parquet(str(tmp_path / "b"))

    assert jobs(plain) == jobs(counted)
    got = [tuple(r) for r in counts.table(spark).orderBy("place").collect()]
    assert got == [(1, "read", 100, 2), (2, "kept", df.filter("x < 3").count(), 2)]


def test_sketches_of_hosts(spark, make_packets):
    df = make_packets([dict(capture_id="c" if i % 2 else "d", src_ip=f"10.{i % 250}.{i // 250}.1", dst_ip=f"10.9.{i % 3}.7") for i in range(3_000)])
    exact = {r.capture_id: r.n_hosts for r in W.distinct_hosts(df).collect()}
    sketches = W.host_sketches(df)
    for r in W.sketched_hosts(sketches.unionByName(sketches)).collect():
        assert abs(r.n_hosts - exact[r.capture_id]) <= 0.07 * exact[r.capture_id]  # four standard errors
    assert max(len(r.sketch) for r in sketches.collect()) < 2 ** (W.SKETCH_BITS + 1)
    everyone = df.select(F.explode(F.array("src_ip", "dst_ip"))).distinct().count()
    assert abs(W.sketched_hosts_of_all(sketches).first().n_hosts - everyone) <= 0.07 * everyone
    few = make_packets([dict(src_ip=f"10.0.0.{i % 9}", dst_ip="10.1.1.1") for i in range(200)])
    assert W.sketched_hosts(W.host_sketches(few)).first().n_hosts == 10


def test_sketched_quantiles_on_tied_data(spark):
    """The rank of an approximate quantile is off by at most the promised share, a tie counting as all of its ranks."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") % 101).cast("double")).alias("tied"),
        F.sqrt(F.col("id").cast("double")).alias("spread"), F.lit(None).cast("double").alias("nothing"))
    accuracy = 200
    found = ST.sketched_quantiles(df, ["tied", "spread", "nothing"], [0.1, 0.5, 0.8], accuracy)
    for c in ("tied", "spread"):
        values = sorted(r[0] for r in df.select(c).collect())
        for share in (0.1, 0.5, 0.8):
            v = found[(c, share)]
            below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert below - 1 / accuracy <= share <= upto + 1 / accuracy and v in values
    assert found[("nothing", 0.5)] is None
    table = {r.feature: r for r in ST.column_statistics(df, ["tied", "spread"], approximate=True).collect()}
    exact = {r.feature: r for r in ST.column_statistics(df, ["tied", "spread"]).collect()}
    assert all(table[c].mean == exact[c].mean and abs(table[c].median - exact[c].median) < 1 for c in table)
    assert S.LABEL not in table


def test_a_second_sweep_of_one_count_leaves_the_others_alone(spark, tmp_path):
    from flowloom.operators.selection import Forest

    df = spark.range(60).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("double").alias("Rate"), (F.col("id") % 7).cast("double").alias("IAT"),
        (F.col("id") % 5).cast("double").alias("Std"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    folder = str(tmp_path / "sweep")

    def run(counts, **kw):
        status, used = SW.sweep_table(df, "k", counts, folder, "src", (Forest(3, 3),), **kw)
        return {(r.n_features, r.status) for r in status.collect()}, used

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names
                if f.endswith(".json")}

    done, used = run([2, 3, 500])
    assert done == {(2, "SUCCESS"), (3, "SUCCESS"), (500, "FAILED")} and {n: len(f) for n, f in used.items()} == {2: 2, 3: 3}
    before = files()
    assert run([2, 3])[0] == {(2, "SKIPPED"), (3, "SKIPPED")} and files() == before
    assert run([3], again=True)[0] == {(3, "SUCCESS")}
    after = files()
    assert {f: t for f, t in before.items() if "n_features=2" in f} == {f: t for f, t in after.items() if "n_features=2" in f}
    assert not {f for f in before if "n_features=3" in f} & set(after)
    counts = {(r.n_features, r.split): r["count"] for r in SW.read_sweep(spark, folder).groupBy("n_features", "split").count().collect()}
    assert counts == {(n, s): c for n in (2, 3) for s, c in (("train", 42), ("validation", 9), ("test", 9))}
    with pytest.raises(ValueError):
        run([0])


def test_records_are_compressed_in_files_of_bounded_size(spark, tmp_path):
    rows = [("i" * 400, f"Rate: {i}.0, Weight: {i % 7}.0, " + "HTTP: 0.0, " * 40, "o", "train" if i % 3 else "test") for i in range(900)]
    df = spark.createDataFrame(rows, "instruction string, input string, output string, split string").coalesce(1)
    IO.write_splits(df, str(tmp_path / "splits"))
    plain = sum(len(json.dumps(r)) for r in rows)
    assert sum(f.stat().st_size for f in (tmp_path / "splits").rglob("part-*")) < plain / 5
    assert sorted(map(tuple, IO.read_split(spark, str(tmp_path / "splits")).collect())) == sorted(rows)
    IO.write_instructions(df.drop("split"), str(tmp_path / "lines"), records_per_file=100)
    assert len(list((tmp_path / "lines").glob("part-*"))) == 9
    assert sorted(map(tuple, IO.read_instructions(spark, str(tmp_path / "lines")).collect())) == sorted(r[:3] for r in rows)


def test_arrays_are_written_row_by_row(spark, tmp_path):
    """Whole files of one array each, whatever the rows of a task; marks as an indented and as a compact file have them."""
    rows = [("i", f"a {i}", "o") for i in range(1_010)]
    df = spark.createDataFrame(rows, "instruction string, input string, output string").coalesce(1)
    for name, marks in (("compact", ("[", ",", "]", " ")), ("indented", ("[\n  ", ",\n  ", "\n]", "\n"))):
        folder = tmp_path / name
        IO.write_instruction_arrays(df, str(folder), *marks, records_per_file=100)
        IO.write_instruction_arrays(df.filter("false"), str(folder), *marks, records_per_file=100)  # adds no array
        arrays = [json.loads(t) for f in folder.glob("part-*") if (t := gzip.open(f, "rt").read())]
        assert sorted(map(len, arrays)) == [10, *[100] * 10]
        assert sorted(tuple(r.values()) for a in arrays for r in a) == sorted(rows)
        assert sorted(map(tuple, IO.read_instructions(spark, str(folder)).collect())) == sorted(rows)


def test_arrays_of_the_query_are_no_values(spark, small):
    plans = []
    write = IO.write_instruction_arrays
    with pytest.MonkeyPatch.context() as m:
        m.setattr(IO, "write_instruction_arrays", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().toString()), write(df, *a, **k)))
        QUERIES["a04_arrays_and_lines"](spark, small)
    assert len(plans) == 2 and not any("collect_list" in p for p in plans)
