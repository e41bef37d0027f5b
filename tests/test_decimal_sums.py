"""Sums of whole numbers against sums of decimals, and plans that sort no lists."""

import random

from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators import ranking as R
from flowloom.operators import sampling as SP
from flowloom.operators import statistics as ST
from flowloom.plans.catalog import QUERIES
from flowloom.plans.sampling_queries import clean_flows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_of_decimals(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.1, -0.3, 1e-9, 5e-10, 1.5e-9, 2.5e-9, -2.5e-9, 4.9999999999e-10, 999_999.999999999, 1e6, 1234567.123456789, 2.0**53, 1e18, -9e18,
              123456.0000000005, 8191.0000000015, 2 / 3, 1e-300, 0.0000000005000000001, 262144.00000000047]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 8) for _ in range(4_000)]
    values += [(rng.randint(-10**13, 10**13) + 0.5) / 1e9 for _ in range(2_000)]  # as near to a tie as a double gets
    rows = [(str(i), v, None) for i, v in enumerate(values)] + [("all", v, None if i % 2 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("none", None, None)], "g string, `a b` double, c double")
    want = df.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(F.col(S.q(c)).cast("decimal(28,9)")).alias(c) for c in ("a b", "c")])
    got = ST.decimal_sums(df, ["a b", "c"], "g")
    assert got.schema["c"].dataType == want.schema["c"].dataType
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_balanced_digest_adds_no_decimals_per_value(spark, small):
    assert "sum(cast" not in _plan(QUERIES["s08_balanced_dataset"](spark, small)).replace("partial_", "").replace("as decimal(28,9)", "")


def test_drawn_groups_are_put_together_without_lists(spark, small):
    df = clean_flows(spark, small)
    counts = R.class_counts(df, "label")
    plan = _plan(SP.synthesise(df, "flow_id", {"XSS": 300, "SqlInjection": 250}, counts))
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_histogram_of_ranks_is_computed_once(spark, small):
    ranked = R.with_rank(clean_flows(spark, small).select("flow_id", "label"), "label", "flow_id", rows_per_bucket=100)
    assert _plan(ranked).count("FileScan") == 1  # the histogram is a local table by now


def test_only_classes_with_a_cut_are_hashed(spark, monkeypatch):
    seen = []
    cumulative = R._cumulative
    monkeypatch.setattr(R, "_cumulative", lambda rows, by: seen.append({r[0] for r in rows.select(by).collect()}) or cumulative(rows, by))
    df = spark.range(1_000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("c"), F.col("id") % 4).alias("label"))
    out = R.take_random(df, "label", "k", {"c0": 10, "c1": 250, "c3": 5}, R.class_counts(df, "label"))
    assert R.class_counts(out, "label") == {"c0": 10, "c1": 250, "c3": 5} and seen == [{"c0", "c3"}]
