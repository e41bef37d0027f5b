"""Statistics, engineered features, scores and selection on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators import columns as C
from flowloom.operators import features as FE
from flowloom.operators import selection as SEL
from flowloom.operators import statistics as ST
from flowloom.plans.sampling_queries import clean_flows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2500, 1.5), rng.integers(0, 4, 1500)])
    return spark.createDataFrame([(float(v), float(-v * v)) for v in values], "a double, `b c` double").repartition(5).cache(), values


def test_order_statistics_when_narrowing(numbers):
    df, values = numbers
    shares = {"a": [0.0, 0.25, 0.5, 0.8, 1.0], "b c": [0.5, 0.9]}
    narrow = ST.quantiles(df, shares, exact_values=100)
    direct = ST.quantiles(df, shares)
    for (c, p), got in narrow.items():
        data = values if c == "a" else -values * values
        assert got == pytest.approx(float(np.quantile(data, p)), abs=1e-12)
        assert got == direct[(c, p)]


def test_moments_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    m = ST.moments(df, ["a", "b"])
    assert (m["a"]["mean"], m["a"]["std"], m["a"]["var"]) == (2.0, 1.0, 1.0)
    assert m["b"]["n"] == 0 and ST.quantiles(df, {"b": [0.5]}) == {("b", 0.5): None}


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3)], "x double")
    assert [r.n for r in ST.histogram(df, "x", 3).orderBy("bin").collect()] == [1, 1, 2]


def smoke(spark):
    """The smoke table's columns, fixed values, with gaps."""
    rows = [
        (0.5, 1.0, 2.0, 4.0, 6, 1, 0, 1, "Benign"), (1.5, None, -0.5, float("inf"), 17, 0, 1, 0, "Malicious"),
        (2.5, 3.0, 1.0, 2.0, 1, 0, 0, 0, "Malicious"), (3.5, 5.0, float("nan"), 1.0, 6, 1, 0, 1, "Benign")]
    return spark.createDataFrame(
        rows, "flow_duration double, Header_Length double, Duration double, Rate double, `Protocol Type` int, TCP int, UDP int, HTTP int, label string")


def test_engineering_guards_and_imputation(spark):
    made = FE.engineer(smoke(spark))
    assert "Rate_ratio" not in made.df.columns and "flag_complexity" not in made.df.columns
    assert made.temporal == ["Duration_log", "Duration_squared", "flow_intensity", "flow_efficiency"]
    rows = made.df.orderBy("flow_duration").collect()
    assert rows[1].Header_Length == 3.0 and rows[1].Rate == 2.0 and rows[3].Duration == 1.0
    assert rows[0].protocol_diversity == 2.0 and rows[0].flow_intensity == 0.0
    assert rows[0].flow_efficiency == pytest.approx(1 / (0.5 + 1e-6))
    assert rows[1].Duration_log == pytest.approx(math.log(0.5))
    assert [r.burst_indicator for r in rows] == [1, 0, 0, 0]


def test_constant_column_has_no_anomaly(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, "x"), (1.0, 3.0, 9.0, "y")], "a double, b double, c double, label string")
    assert [(r.anomaly_score, r.high_anomaly) for r in FE.engineer(df).df.collect()] == [(None, 0), (None, 0)]


def test_strict_transform_ignores_new_table(spark):
    df = smoke(spark)
    fitted = SEL.FittedSelection(
        ["Rate", "burst_indicator"], [], {}, {"Rate": (0.0, 1.0), "burst_indicator": (0.0, 1.0)}, FE.learn(df))
    later = df.filter("flow_duration > 1").withColumn("Rate", F.lit(3.0))
    # 3.0 is above the fitted 0.8 quantile of 2.8, but not above the quantile of the new table itself.
    for mode, flag in (("strict", 1.0), ("compat", 0.0)):
        assert {r.burst_indicator for r in fitted.transform(later, mode).collect()} == {flag}
    only = fitted.transform(df.drop("Rate"), keep=[S.LABEL])
    assert only.columns == ["label"]  # features the table does not have are left out


def test_variance_threshold_is_exclusive(spark):
    step = math.sqrt(0.005)
    df = spark.createDataFrame([(0.0, 0.0, 7.0), (2 * 0.0625, 2 * step * 1.001, 7.0)], "a double, b double, c double")
    assert SEL.variance_filter(df, ["a", "b", "c"], threshold=2 * 0.0625**2) == ["b"]
    with pytest.raises(ValueError):
        SEL.variance_filter(df, ["c"])


def test_anova_by_hand(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (5.0, "b"), (6.0, "b"), (7.0, "b")], "x double, label string")
    assert SEL.anova_f(df, ["x"]).first().f_score == pytest.approx(24.0)


def test_mutual_information_by_hand(spark):
    df = spark.createDataFrame([(float(i % 2), float(i // 50), "ab"[i % 2]) for i in range(100)], "x double, y double, label string")
    got = {r.feature: r.mi_score for r in SEL.mutual_information(df, ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(math.log(2)) and got["y"] == pytest.approx(0.0, abs=1e-12)
    narrow = {r.feature: r.mi_score for r in SEL.mutual_information(df, ["x", "y"], exact_values=10).collect()}
    assert narrow == got


def test_union_cap_prefers_later_column_on_ties():
    scores = SEL.union_cap(["a", "b", "c"], {"a": 1.0, "b": 1.0, "c": 0.5}, {"a": 0.0, "b": 0.0, "c": 9.0}, 1)
    assert [s.feature for s in scores if s.selected] == ["c"]
    scores = SEL.union_cap(["a", "b", "c"], {"a": 1.0, "b": 1.0, "c": 1.0}, {}, 2)
    assert [s.feature for s in scores if s.selected] == ["b", "c"]


def test_complete_critical():
    assert SEL.complete_critical(["x", "Rate"], ["x", "Rate", "Duration", "IAT", "TCP"], 4) == ["x", "Rate", "Duration", "TCP"]
    assert SEL.complete_critical(["x", "y"], ["x", "y"], 1) == ["x"]


def test_forest_finds_planted_feature(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("double").alias("planted"),
        (F.hash("id") % 100).cast("double").alias("noise"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    found = SEL.rf_importance(df, ["noise", "planted"], "key", forests=(SEL.Forest(5, 4),))
    assert SEL.top_n(["noise", "planted"], found, 1) == ["planted"]


def test_fallback(spark):
    df = spark.createDataFrame([("1", 1.0, 2.0, "a"), ("2", 1.0, 4.0, "b")], "key string, LLC double, Rate double, label string")
    out, fitted = SEL.select_or_original(df, "key", SEL.SelectionSettings.for_count(50))
    assert fitted is None and out.columns == ["Rate", "LLC", "label"]
    assert [r.Rate for r in out.orderBy("Rate").collect()] == [-1.0, 1.0]


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {tuple(r) for r in SEL.with_label_index(df).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_column_checks(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None)], "HTTP int, Rate double, label string, other double")
    assert C.column_check(df.columns)["extra"] == ["other"] and "DNS" in C.column_check(df.columns)["missing"]
    assert C.validate_columns(df).filter("status = 'missing'").count() == 44
    assert C.label_column(df) == "label" and C.label_column(df.drop("label")) == "other"
    assert C.detect_binary(df) == ["HTTP"] and C.detect_discrete(df) == ["HTTP", "label"]
    assert C.missing_features(df, ["Rate", "IAT"]) == (["Rate"], ["IAT"])
    with pytest.raises(ValueError, match="IAT"):
        C.require_columns(df, ["Rate", "IAT"])
    zero = FE.fill_zero(spark.createDataFrame([(None, None), (float("nan"), "x")], "a double, b string")).collect()
    assert [tuple(r) for r in zero] == [(0.0, "0"), (0.0, "x")]


def test_order_statistics_of_tied_and_odd_columns(spark):
    """The digit search ends on heavy ties, and knows signs, zeros, NULL and neighbours in value."""
    rng = np.random.default_rng(2)
    n = 3000
    columns = {
        "half": [float(i % 2) for i in range(n)],
        "fifth": [float(i % 5 == 0) for i in range(n)],
        "two": [1e300 if i < 10 else (7.0 if i % 2 else -7.0) for i in range(n)],
        "nulls": [None if i % 3 else float(i) for i in range(n)],
        "signs": [-0.0 if i % 2 else 0.0 for i in range(n)],
        "close": [1.0 + 2.0**-52 * (i % 4) for i in range(n)],
        "wide": [float(x) for x in rng.standard_normal(n) * 10.0 ** rng.integers(-200, 200, n)],
    }
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    shares = {c: [0.0, 0.25, 0.5, 0.8, 1.0] for c in columns}
    assert ST.quantiles(df, shares, exact_values=10) == ST.quantiles(df, shares)


def test_passes_do_not_grow_with_columns(spark):
    df = spark.range(500).selectExpr(*[f"cast(id % {i + 2} as double) as c{i}" for i in range(20)])
    jobs = []
    for names in (["c0"], df.columns):
        group = f"digits-{len(names)}"
        spark.sparkContext.setJobGroup(group, group)
        counts = {c: 500 for c in names}
        ST.order_statistics(df, {c: [100, 400] for c in names}, counts, exact_values=10)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_numeric_key_is_no_anomaly_column(spark):
    df = spark.sql("select id as k, double(id % 3) as `Header_Length`, double(id) as Rate, double(id % 5) as IAT, 'x' as label from range(20)")
    assert "k" not in FE.learn(df, "k").z
    assert list(FE.learn(df, "k").z) == ["Header_Length", "Rate", "IAT"]


def test_forests_learn_from_a_bounded_stratified_sample(spark):
    """A table ten times the bound: the sample keeps class shares and small classes, and the planted feature stays on top."""
    df = spark.range(6_000).select(
        F.col("id").cast("string").alias("key"), F.when(F.col("id") % 1_000 == 0, "rare").otherwise(F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("label"))
    df = df.withColumns({
        "strong": F.when(F.col("label") == "a", 1.0).otherwise(0.0), "noise": (F.hash("key") % 100).cast("double")})
    sample = SEL.fit_sample(df, "key", max_fit_rows=600)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("key").alias("n")).collect()}
    assert counts.keys() == {"a", "b", "rare"} and 590 <= sum(counts.values()) <= 602 and abs(counts["b"] - 2 * counts["a"]) < 10
    assert SEL.fit_sample(df, "key", max_fit_rows=10_000).count() == 6_000
    found = SEL.rf_importance(df, ["noise", "strong"], "key", forests=(SEL.Forest(20, 5),), max_fit_rows=600)
    assert found["strong"] > 2 * found["noise"]


def test_large_columns_take_few_passes(spark):
    """Columns of few values are settled by one pass, others as soon as few values are left; NaN, zeros and values met late count."""
    n = 6_000
    df = spark.range(n, numPartitions=3).selectExpr(
        "double(id % 7) as few", "if(id % 2 = 0, -0.0D, 0.0D) as zeros", f"if(id = {n - 1}, -1e9D, 5D) as late",
        "if(id % 3 = 0, double('NaN'), double(id)) as nan", "double(hash(id)) / 7 as wide", "double(id * id) as square")
    rows = df.toPandas()
    ranks = {c: [0, 100, 3_000, n - 1] for c in df.columns}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ST, "FEW_VALUES", 50)
        found = ST.order_statistics(df, ranks, {c: n for c in df.columns}, exact_values=500)
        few = ST._of_few_values(df, ranks)
    for (c, r), got in found.items():
        np.testing.assert_equal(got + 0.0, float(np.sort(rows[c].to_numpy() + 0.0)[r]))
    assert len(found) == 4 * len(df.columns) and {c for c, _ in few} == {"few", "zeros", "late"}


def test_sums_read_a_written_table(spark, small):
    """Formulas and sums are not one stage: its method would be too long to compile. The session keeps its settings."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    ready = SEL.prepare(clean_flows(spark, small), "flow_id")
    assert "engineered-" in ready.made.df.inputFiles()[0] and spark.conf.get(name) == before
    plain = FE.engineer(clean_flows(spark, small), key="flow_id").df
    for c, m in ST.moments(plain, ready.names).items():
        assert ready.moments[c]["n"] == m["n"] and ready.moments[c]["mean"] == pytest.approx(m["mean"], rel=1e-9)


def test_forests_are_fitted_side_by_side(spark, monkeypatch):
    """All fits are under way at once, each on few tasks; the sum is in the order of the fits."""
    import threading

    from pyspark.ml.classification import RandomForestClassifier

    class Model:
        def __init__(self, value):
            self.featureImportances = self
            self.value = value

        def toArray(self):
            return [self.value, 1.0]

    together = threading.Barrier(4, timeout=60)
    parts = []

    def fit(self, table):
        together.wait()  # breaks unless four fits wait here
        parts.append(table.rdd.getNumPartitions())
        return Model(float(self.getMaxDepth()))

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    df = spark.range(400).selectExpr("id", "cast(id % 2 as string) as label", "double(id) as a", "double(id % 3) as b").repartition(8)
    found = SEL.rf_importance(df, ["a", "b"], "id", forests=(SEL.Forest(2, 3), SEL.Forest(2, 5)), folds=2)
    assert found == {"a": 4.0, "b": 1.0} and max(parts) <= 2
