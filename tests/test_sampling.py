"""Ranks, quotas and splits against plain Python, with one class that holds most rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.operators import ranking as R
from flowloom.operators import sampling as SP


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 < 7, "DDoS").when(F.col("id") % 10 < 9, "Benign").when(F.col("id") % 40 == 9, "XSS").otherwise("SqlInjection")
    return spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), label.alias("label"), F.col("id").alias("pos")).cache()


def by_hash(rows):
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.label].append((hashlib.md5(f"{r.key}:42".encode()).hexdigest(), r.key))
    return {g: [k for _, k in sorted(v)] for g, v in groups.items()}


@pytest.mark.parametrize("per", [64, 10_000])
def test_take_random(rows, per):
    want = by_hash(rows)
    quota = {"DDoS": 500, "Benign": 10_000, "XSS": 1, "SqlInjection": 0}
    got = R.take_random(rows, "label", "key", quota, rows_per_bucket=per).collect()
    expected = {k for g, n in quota.items() for k in want[g][:n]}
    assert {r.key for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("per", [64, 10_000])
def test_ranks(rows, per):
    want = {k: i + 1 for ks in by_hash(rows).values() for i, k in enumerate(ks)}
    got = R.with_rank(rows, "label", "key", rows_per_bucket=per).collect()
    assert {r.key: r._rank for r in got} == want


@pytest.mark.parametrize("per", [64, 10_000])
def test_first_come(rows, per):
    got = SP.cap_first_come(rows, "pos", 30, rows_per_bucket=per).collect()
    want = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        if len(want[r.label]) < 30:
            want[r.label].append(r.key)
    assert {r.key for r in got} == {k for ks in want.values() for k in ks}


@pytest.mark.parametrize("per", [64, 10_000])
def test_splits(rows, per):
    counts = Counter(r.label for r in rows.collect())
    got = SP.stratified_split(rows, "key", rows_per_bucket=per).collect()
    assert len(got) == 4000 and len({r.key for r in got}) == 4000
    assert Counter(r.split for r in got) == {"train": 2800, "validation": 600, "test": 600}
    for label, n in counts.items():
        assert abs(sum(r.label == label and r.split == "train" for r in got) - 0.7 * n) <= 1
    whole = SP.random_split(rows, "key", rows_per_bucket=per).collect()
    assert Counter(r.split for r in whole) == {"train": 2800, "validation": 600, "test": 600}


def test_folds(rows):
    got = Counter((r.label, r.fold) for r in SP.stratified_folds(rows, "key", rows_per_bucket=64).collect())
    for label in {g for g, _ in got}:
        sizes = [got[(label, f)] for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_one_row_class_cannot_be_split(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "key string, label string")
    with pytest.raises(ValueError, match="x"):
        SP.stratified_split(df, "key")


def test_largest_remainder():
    assert SP.largest_remainder({"a": 5, "b": 3, "c": 2}, 3) == {"a": 1, "b": 1, "c": 1}
    assert sum(SP.largest_remainder({"a": 7, "b": 11, "c": 13}, 10).values()) == 10


def test_plan():
    plan = {p.label: p for p in SP.balance_plan({"DDoS": 900, "Benign": 50, "XSS": 120, "SqlInjection": 20}, 500, 2000)}
    assert [(plan[c].kept, plan[c].target, plan[c].way) for c in ("DDoS", "XSS", "SqlInjection", "Benign")] == [
        (500, 500, "trim"), (120, 500, "synthesise"), (20, 500, "duplicate"), (50, 500, "fill")]
    with pytest.raises(ValueError, match="DDoS"):
        SP.balance_plan({"Benign": 10})


def test_balanced_counts(spark, small):
    from flowloom.plans.sampling_queries import clean_flows

    df = clean_flows(spark, small)
    counts = R.class_counts(df, "label")
    out = SP.balanced_dataset(df, "flow_id", 400, 4000, rows_per_bucket=100).cache()
    plan = SP.balance_plan(counts, 400, 4000)
    assert R.class_counts(out, "label") == {p.label: p.target for p in plan}
    drawn = out.filter("is_synthetic").agg(F.max("HTTP"), F.min("HTTP"), F.count_distinct("HTTP")).first()
    assert set(drawn[:2]) <= {0.0, 1.0}
    assert {r.label: r.n for r in out.filter("not is_synthetic").groupBy("label").agg(F.count("*").alias("n")).collect()} == {
        p.label: p.kept for p in plan}


def test_sampling_moves_no_rows(rows):
    plan = R.take_random(rows, "label", "key", {"DDoS": 500, "Benign": 100})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_rank_of_a_missing_class_at_any_size(spark):
    from flowloom.operators import ranking as R

    df = spark.createDataFrame([(f"k{i}", None if i % 10 == 0 else "a") for i in range(1000)], "k string, label string")
    one = {r.k: r._rank for r in R.with_rank(df, "label", "k", rows_per_bucket=10**6).collect()}
    many = {r.k: r._rank for r in R.with_rank(df, "label", "k", rows_per_bucket=10).collect()}
    assert one == many and len(one) == 1000


@pytest.mark.parametrize("n", [0, 1, 7, 150, 399, 400, 500])
def test_head_by_ranges(spark, n):
    """More rows than a top-k may bring to one task: whole ranges, and the beginning of one."""
    df = spark.range(400).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 37, F.lit(400)).cast("string")).alias("key"), "id")
    out = SP.head(df, "key", n, top_k_rows=5, rows_per_range=50)
    assert [r.key for r in out.collect()] == sorted(f"k{i}" for i in range(400))[:n]


def test_head_of_flows_has_no_task_of_all_rows(spark, small):
    from flowloom.plans.sampling_queries import clean_flows

    df = clean_flows(spark, small).select("flow_id", "label")
    plan = SP.head(df, "flow_id", 1_500, rows_per_range=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # ranges and the rest, no limit over the table
