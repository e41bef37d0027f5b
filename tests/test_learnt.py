"""What engineering learns: medians and quantiles of filled columns by one search, against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import features as FE
from flowloom.operators import statistics as ST
from flowloom.plans.sampling_queries import clean_flows


@pytest.mark.parametrize("exact", [1, 10**6])
@pytest.mark.parametrize("known", [0, 1, 2, 3, 40, 41, 99, 100])
def test_quantiles_of_filled_columns(spark, known, exact):
    rng = random.Random(known)
    df = spark.createDataFrame([
        (None if i >= known else rng.choice([rng.uniform(-9, 9), 1.0, 2.0]), float(rng.randint(0, 5))) for i in range(100)], "a double, `b c` double")
    counts = {"a": known, "b c": 100}
    gaps = [c for c in counts if counts[c] < 100]
    shares = {"a": [0.0, 0.3, 0.5, 0.8, 1.0], "b c": [0.8, 0.25]}
    medians, found = ST.filled_quantiles(df, gaps, shares, counts, 100, exact)
    want = ST.quantiles(df, {c: [0.5] for c in gaps})
    assert medians == {c: want[(c, 0.5)] for c in gaps}
    full = df.select(F.coalesce("a", F.lit(medians.get("a")).cast("double")).alias("a"), "`b c`")
    assert found == ST.quantiles(full, shares)


def test_quantiles_are_searched_once(spark, small, monkeypatch):
    df = clean_flows(spark, small)
    calls = []
    search = ST.order_statistics
    monkeypatch.setattr(ST, "order_statistics", lambda *a, **kw: calls.append(1) or search(*a, **kw))
    monkeypatch.setattr(ST, "value_counts", lambda *a: pytest.fail("counted again"))
    stats = FE.learn(df, "flow_id")
    assert len(calls) == 1 and set(stats.medians) == {"Rate"} and stats.q80.keys() == {"Rate", "IAT"}
    calls.clear()
    assert FE.learn_medians(df) == stats.medians and len(calls) == 1
