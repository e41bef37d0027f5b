"""The confusion table reads what stands behind its counts once."""

from pyspark.sql import functions as F

from flowloom.operators import evaluation as EV


def test_predictions_are_counted_once(spark):
    scored = spark.range(90).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("true"), F.concat(F.lit("c"), F.floor(F.col("id") / 2) % 2).alias("predicted"))
    pairs = EV.pair_counts(scored)
    out = EV.confusion(pairs)
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(r["true"], r["predicted"]): r["n"] for r in pairs.collect()}
    assert {(r[0], r[1]): r[2] for r in out.collect()} == {(f"c{t}", f"c{p}"): want.get((f"c{t}", f"c{p}"), 0) for t in range(3) for p in range(3)}
