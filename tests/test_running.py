"""Running operators: many small blocks give what one block gives, and what plain Python gives."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import packets as W
from flowloom.operators.running import Level, Run, cut_blocks, running, running_levels


def hot_packets(make_packets, n=240):
    """One flow has more than half of the rows; timestamps go back and forth."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.6
        a = ("10.0.0.10", 80) if hot else (f"10.0.0.{rng.randint(1, 3)}", rng.choice([21, 22, 443, 5000]))
        b = ("10.0.0.2", 4000) if hot else (f"10.0.1.{rng.randint(1, 2)}", rng.choice([53, 67, 6000]))
        if rng.random() < 0.5:
            a, b = b, a
        kind = rng.random()
        rows.append(dict(
            capture_id="c1" if i % 5 else "c2", ts_us=1_700_000_000_000_000 + i * 1000 + rng.randint(-5000, 5000),
            eth_type=2048 if kind < 0.85 else rng.choice([2054, 34525]), ip_proto=rng.choice([6, 6, 17, 1]),
            src_ip=a[0], dst_ip=b[0], src_port=a[1], dst_port=b[1], frame_len=rng.randint(60, 1500),
            tcp_flags=rng.randint(0, 255), opt_len=4 * rng.randint(0, 3)))
    return make_packets(rows)


OPERATORS = {
    "capture": lambda b: W.capture_times(b).df.select("packet_no", "iat_us", "cumulative_us"),
    "windows": lambda b: W.window_statistics(W.capture_times(b)).df.select(
        "packet_no", "w_sum", "w_min", "w_max", F.round("w_std", 6).alias("s"), F.round("w_magnitude", 6).alias("m")),
    "flow": lambda b: W.rates(W.directions(W.flow_runs(b))).df.select(
        "packet_no", "flow_us", "flow_packets", "flow_bytes", "tcp_packets", "dst_to_src_pkt", "rate", "srate"),
    "strict": lambda b: W.directions(W.flow_runs(b), "strict").df.select(
        "packet_no", "src_to_dst_pkt", "src_to_dst_byte", "dst_to_src_pkt", "dst_to_src_byte"),
    "idle": lambda b: W.idle_time(b).df.select("packet_no", "idle_us"),
    "times": lambda b: W.flow_time_statistics(b).df.select(
        "packet_no", "ts_min_us", "ts_max_us", "ts_sum_us", F.round("ts_mean_offset_us", 3).alias("mean"),
        F.round("ts_std_us", 2).alias("std")),
    "hosts": lambda b: W.host_counters(b, "strict").df.select(
        "packet_no", "src_pkts", "dst_pkts", "src_byte_count", "dst_byte_count"),
    "protocols": lambda b: W.protocol_host_counters(b).df.select("packet_no", "src_proto_pkts", "dst_proto_pkts"),
    "ports": lambda b: W.protocol_port_counters(b, "strict").df.select("packet_no", "src_port_pkts", "dst_port_pkts"),
    "incoming": lambda b: W.incoming_connections(b).df.select("packet_no", "incoming_src", "incoming_dst"),
    "arp": lambda b: W.arp_counter(b).df.select("packet_no", "arp_packets"),
    "flags": lambda b: W.flag_counts(b, "strict").df.select("packet_no", "ack_count", "urg_count"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_blocks_do_not_change_results(make_packets, name):
    df = hot_packets(make_packets)
    one = sorted(OPERATORS[name](W.blocks_of(df)).collect())
    many = sorted(OPERATORS[name](W.blocks_of(df, block_rows=7)).collect())
    assert many == one


def test_whole_feature_row_in_small_blocks(make_packets):
    df = hot_packets(make_packets)
    one = {r["packet_no"]: r for r in W.packet_features(df).collect()}
    many = {r["packet_no"]: r for r in W.packet_features(df, block_rows=11).collect()}
    assert one.keys() == many.keys()
    for k, row in one.items():
        for c in row.asDict():
            a, b = row[c], many[k][c]
            assert a == b or (isinstance(a, float) and abs(a - b) < 1e-9 * max(1.0, abs(a))), (k, c, a, b)


def test_two_streams_in_small_blocks(make_packets):
    df = hot_packets(make_packets)
    assert sorted(W.two_stream_statistics(df, 7).collect(), key=str) == sorted(W.two_stream_statistics(df).collect(), key=str)


def test_idle_time_by_brute_force(make_packets):
    df = hot_packets(make_packets)
    got = {r[0]: r[1] for r in W.idle_time(W.blocks_of(df, 9)).df.select("packet_no", "idle_us").collect()}
    seen = {}
    for r in df.orderBy("packet_no").collect():
        if r.eth_type != 2048 or r.ip_proto not in (6, 17):
            assert got[r.packet_no] == 0
            continue
        ends = tuple(sorted([(r.src_ip, r.src_port), (r.dst_ip, r.dst_port)]))
        times = seen.setdefault((r.capture_id, r.ip_proto, ends), [])
        times.append(r.ts_us)
        times.sort()
        want = times[-1] - times[-2] if len(times) > 1 else times[-1]
        assert got[r.packet_no] == want


def test_no_partials_when_groups_fit_one_block(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("p"))
    assert not cut_blocks(df, ["g"], "p", 1000).multi
    blocks = cut_blocks(df, ["g"], "p", 10)
    assert blocks.multi
    out = running(blocks, ["g"], [Run("n", "count"), Run("s", "sum", F.col("p")), Run("f", "first", F.col("p"))]).df
    assert [(r.n, r.s, r.f) for r in out.orderBy("p").collect()] == [(i + 1, i * (i + 1) // 2, 0) for i in range(100)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_all_levels_share_one_carry_table(spark, make_packets, tmp_path, mode):
    path = str(tmp_path / "packets")
    hot_packets(make_packets).write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(W.packet_features(df, block_rows=100, mode=mode))
    assert plan.count("Exchange") <= 4 and plan.count("Scan parquet") <= 2 and "Join" not in plan
    assert plan_of(W.packet_features(df, mode=mode)).count("Exchange") == 1


@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_features_do_not_depend_on_blocks(make_packets, mode):
    df = hot_packets(make_packets)
    one = {r["packet_no"]: r for r in W.packet_features(df, mode=mode).collect()}
    for block_rows in (1, 7, 100):
        many = {r["packet_no"]: r for r in W.packet_features(df, block_rows=block_rows, mode=mode).collect()}
        assert many.keys() == one.keys()
        for k, r in one.items():
            assert all(a == b or a == pytest.approx(b) for a, b in zip(r, many[k]) if not isinstance(a, str))


def test_levels_against_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(f"g{rng.randrange(2)}", i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i bigint, k string, v bigint")
    fns = ("count", "sum", "min", "max", "first", "prev")
    levels = [
        Level((), [Run(f"all_{f}", f, F.col("v")) for f in fns]),
        Level(("k",), [Run(f"own_{f}", f, F.col("v")) for f in fns] + [Run("own_n", "count")])]
    for block_rows in (1, 13, 1000):
        got = {r["i"]: r for r in running_levels(cut_blocks(df, ["g"], "i", block_rows), levels).df.collect()}
        held = {}
        for g, i, k, v in rows:
            for prefix, key in (("all", (g,)), ("own", (g, k))):
                if prefix == "own" and k is None:
                    continue
                old = held.setdefault((prefix, key), [])
                r = got[i]
                assert r[f"{prefix}_prev"] == (old[-1] if old else None)
                old.append(v)
                some = [x for x in old if x is not None]
                want = (len(some), sum(some) if some else None, min(some, default=None), max(some, default=None), old[0])
                assert tuple(r[f"{prefix}_{f}"] for f in fns[:5]) == want
                if prefix == "own":
                    assert r["own_n"] == len(old)
