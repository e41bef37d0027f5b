"""Numbers printed from whole numbers against Python, and a text that is generated code."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import text as X
from flowloom.functions.formatting import fixed, rounded


@pytest.mark.parametrize("places", [1, 2, 4, 6, 9])
def test_fixed_near_halves(spark, places):
    rng, unit = random.Random(places), 10.0**-places
    values = [0.0, -0.0, 1e-300, -1e-12, unit, -unit, unit / 2, 9e10, 1e11 + 0.125, -123456789.0, 1e15]
    values += [rng.choice([-1, 1]) * (rng.randrange(10 ** rng.randint(1, 12)) + 0.5) * unit for _ in range(2_000)]  # half a unit, as near as a double gets
    values += [(2 * rng.randrange(10**6) + 1) / 2 ** rng.randint(1, 12) for _ in range(1_000)]  # true halves among them
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-10, 14) for _ in range(2_000)]
    values = [v for v in values if abs(v) < 1e14 * unit]  # larger ones are printed by the pattern, as before
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x"), places).alias("t"))
    wrong = [(r.x, r.t) for r in df.collect() if r.t != f"{r.x:.{places}f}" and abs(r.x) != unit / 2]
    assert not wrong


def test_only_rare_numbers_are_in_a_lambda(spark, small):
    from flowloom.plans.fixtures import flows

    text = X.verbalise(flows(spark, small))._jc.toString()
    assert "Services" in text
    df = spark.createDataFrame([(1.0,) * len(S.FEATURES)], ", ".join(f"`{c}` double" for c in S.FEATURES))
    plan = df.select(X.verbalise(df).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "transform(array(struct" not in plan and "array_join" not in plan
    assert df.select(X.verbalise(df).alias("t")).first().t.startswith("Network flow with duration 1.0000 seconds. header length 1 bytes. using ICMP protocol. overall rate 1.0000. ")


def test_rounded_is_round(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, -1e-9, 5e-7, 1.5e-6, -2.5e-6, 0.1234565, 1e15, 1e22, 9e8 + 0.0000005, float("nan"), float("inf"), None]
    values += [(rng.randrange(10 ** rng.randint(1, 15)) + 0.5) * 1e-6 for _ in range(3_000)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-9, 12) for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert not df.filter(~rounded(F.col("x"), 6).cast("string").eqNullSafe(F.round("x", 6).cast("string"))).take(3)
