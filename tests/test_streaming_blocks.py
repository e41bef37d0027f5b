"""Streams whose keys are larger than a task: blocks of a capture or class, and what came before them."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import packets as W
from flowloom.plans.streaming_queries import stream_of
from flowloom.session import new_folder
from flowloom.streaming import stateful as ST

WINDOW = ["w_sum", "w_min", "w_max", "w_avg", "w_std", "w_magnitude", "w_radius", "w_covariance", "w_variance"]


def one_hot_capture(make_packets, n=230):
    """Nearly all packets are of one capture; some are dropped, so positions have gaps, and times go back and forth."""
    rng = random.Random(11)
    return make_packets([
        dict(capture_id="hot" if i % 9 else "small", ts_us=1_700_000_000_000_000 + i * 900 + rng.randint(-4000, 4000),
             frame_len=rng.randint(60, 1500), link_type="bluetooth" if rng.random() < 0.1 else "ethernet") for i in range(n)])


@pytest.mark.parametrize("steps", [1, 2, 5])
@pytest.mark.parametrize("run,columns", [
    (ST.capture_features, ["iat_us", "cumulative_us"]), (ST.window_features, WINDOW)])
def test_a_hot_capture_is_spread_and_equal_to_batch(spark, make_packets, steps, run, columns):
    df = one_hot_capture(make_packets)
    batch = W.window_statistics(W.capture_times(W.blocks_of(df))).df
    cells = ["packet_no", *[F.round(c, 6).alias(c) for c in columns]]
    want = batch.select(*cells).orderBy("packet_no").collect()
    folder = new_folder(spark, "blocks")
    run(stream_of(spark, df, "packet_no", steps, 3), folder, block_rows=17).awaitTermination()
    assert ST.read_output(spark, folder).select(*cells).orderBy("packet_no").collect() == want


def test_no_call_gets_more_than_a_block(spark, make_packets, tmp_path):
    """The rows that one call holds are those of one block, and the state of a key sees one row per task and block."""
    df = one_hot_capture(make_packets)
    rows = stream_of(spark, W.keep_frames(df).select("capture_id", "packet_no", "ts_us"), "packet_no", 1, 2)

    def sizes(key, own, n, first, last):
        out = own[["capture_id", "packet_no"]].head(1).copy()
        out["rows"], out["before"] = len(own), n
        return out

    folder = new_folder(spark, "sizes")
    out = ST.in_blocks(rows, ["capture_id"], "packet_no", sizes, "capture_id string, packet_no bigint, rows bigint, before bigint", "ts_us", 1, 20)
    ST.write_rows(out, folder, "sizes").awaitTermination()
    got = ST.read_output(spark, folder).orderBy("capture_id", "packet_no").collect()
    assert len(got) > 15 and max(r.rows for r in got) <= 20
    for name in ("hot", "small"):
        before = 0
        for r in (r for r in got if r.capture_id == name):
            assert r.before == before
            before += r.rows


@pytest.mark.parametrize("steps", [1, 3])
def test_a_hot_class_is_capped_over_blocks(spark, steps):
    rows = [(i, None if i % 11 == 0 else "b" if i % 7 == 0 else "a", None if i % 3 else 2**60 + i) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, label string, n bigint")
    for cap in (0, 5, 40, 1_000):
        folder = new_folder(spark, "caps")
        ST.capped_rows(stream_of(spark, df, "id", steps, 3), folder, cap, "label", "id", block_rows=13).awaitTermination()
        want = [r for c in "ab" for r in [x for x in rows if x[1] == c][:cap]]
        assert sorted(map(tuple, ST.read_output(spark, folder).collect())) == sorted(want)


def test_sizes_that_are_not_known_and_captures_without_a_name(spark, make_packets):
    df = make_packets([dict(capture_id=None if i % 2 else "c", frame_len=None if i % 13 == 0 else 60 + i) for i in range(90)])
    batch = W.window_statistics(W.capture_times(W.blocks_of(df))).df
    cells = ["packet_no", "w_sum", "w_min", F.round("w_std", 6).alias("s")]
    folder = new_folder(spark, "unknown")
    ST.window_features(stream_of(spark, df, "packet_no", 2, 2), folder, block_rows=11).awaitTermination()
    got = ST.read_output(spark, folder).select(*cells).orderBy("packet_no").collect()
    assert [r[:2] for r in got if r.packet_no % 2 == 0] == [r[:2] for r in batch.select(*cells).orderBy("packet_no").collect() if r.packet_no % 2 == 0]
    assert len(got) == 90


def test_a_small_flow_costs_no_table_operation(monkeypatch):
    """Rows out of order, a gap in sizes and a pause, without a sort or grouping of tables."""
    import numpy as np
    import pandas as pd

    class State:
        hasTimedOut = exists = False

        def update(self, value):
            self.exists, self.get = True, value

    def refuse(*_, **__):
        raise AssertionError("a table operation per flow")

    rows = pd.DataFrame({"packet_no": [2, 0, 1, 3], "ts_us": [30, 0, 10, 500], "ip_proto": [17, 6, 6, 6], "frame_len": [7.0, 5.0, np.nan, 9.0]})
    for kind in (pd.DataFrame, pd.Series):
        monkeypatch.setattr(kind, "sort_values", refuse)
        monkeypatch.setattr(kind, "groupby", refuse)
    state = State()
    (out,) = ST._flow_update(100, False)(("c", "a", 1, "b", None), iter([rows]), state)
    assert out["packet_no"].tolist() == [0, 1, 2, 3] and out["flow_packets"].tolist() == [1, 2, 1, 1]
    assert out["flow_bytes"].tolist() == [5, 5, 7, 9] and out["flow_us"].tolist() == [0, 10, 0, 0]
    assert out["tcp_packets"].tolist() == [1, 2, 2, 1] and state.get[:2] == (1, 9) and state.get[-1] == 500


def test_summaries_sort_a_batch_once(monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *_, **__: calls.append(1))
    batch = pd.DataFrame({"c": ["a", None, "a", "b"], ST.BLOCK: [0, 0, 0, 0], "p": [5, 1, 3, 2], "v": [50, 10, None, 20]})
    (out,) = ST._summaries(["c"], "p", "v", 1)(iter([batch]))
    got = {r["c"]: (r[ST._N], r["first_at"], r[ST._TAIL]) for r in out.to_dict("records")}
    assert got == {"a": (2, 3, [50]), None: (1, 1, [10]), "b": (1, 2, [20])} and not calls
