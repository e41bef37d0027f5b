"""Mixing sources to target weights by Pareto order sampling.

Per source, every document gets an expected number of copies, the same
multiple of its weight, at most ``MAX_COPIES``. The whole part of it is certain.
For the rest, documents are ordered by random odds divided by inclusion odds
and taken in that order until the source's words are used up, which gives a
sample of fixed size with unequal probabilities. A histogram of the order finds
the place of the cut, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import ranked
from flowloom.session import materialise

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 65_536  # parts of the Pareto order per source
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, place``: places from 0 in code point order, NULL last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    keyed = totals.withColumn("missing", F.col("source").isNull())
    return ranked(keyed, ["missing", "source"]).drop("missing")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``max_copies`` times its source.

    What the capped sources can't take is shared again, by weight, among the
    others, until no target is above its cap. Each round is one aggregate.
    """
    table = F.array(*[F.lit(w) for w in weights])
    s = materialise(sources.select(
        "source", "source_size", F.get(table, (F.col("place") % len(weights)).cast("int")).cast("bigint").alias("w")),
        "mix-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    n_capped = 0
    while True:
        row = s.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("size"), F.sum(F.when(~capped, F.col("w"))).alias("w"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        left, w_left = total - max_copies * (row["size"] or 0), row["w"] or 1
        share = F.lit(left).cast("double") * F.col("w") / F.lit(w_left)
        now = capped | (share > max_copies * F.col("source_size"))
        more = s.filter(now).count()
        if more == row["n"]:
            break
        if more <= n_capped:  # cannot happen: a capped source stays capped
            raise RuntimeError("the shares do not settle")
        capped, n_capped = now, more
    cap = (max_copies * F.col("source_size")).cast("double")
    return s.select("source", "source_size", F.when(capped, cap).otherwise(share).alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, weight, copies, odds_left, rest`` for every weight in a source.

    ``copies`` is certain for each document of that weight, ``odds_left`` the probability of one more, and ``rest`` the
    words that the source still lacks when the certain copies are taken.
    """
    groups = sizes.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    groups = groups.alias("g").join(targets.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select(
        "g.*", "t.target")
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    heavier = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(0, Window.unboundedFollowing))
    factor = F.try_divide(F.col("target") - max_copies * heavier, lighter)
    fits = groups.withColumn("factor", factor).withColumn(
        "factor", F.when(F.col("factor") * F.col("weight") <= max_copies, F.col("factor")))
    all_of = Window.partitionBy("source")
    fits = fits.withColumn("chosen", F.max(F.when(F.col("factor").isNotNull(), F.col("weight"))).over(all_of))
    fits = fits.withColumn(
        "factor", F.max(F.when(F.col("weight") == F.col("chosen"), F.col("factor"))).over(all_of))
    expected = F.when(
        F.col("weight") <= F.col("chosen"), F.least(F.col("factor") * F.col("weight"), F.lit(float(max_copies)))
    ).otherwise(F.lit(float(max_copies)))
    parts = fits.withColumn("expected", expected).withColumn("copies", F.floor(F.col("expected") + 1e-9).cast("bigint"))
    parts = parts.withColumn("odds_left", F.greatest(F.col("expected") - F.col("copies"), F.lit(0.0)))
    return parts.select(
        "source", "weight", "target", "copies", "odds_left",
        (F.col("target") - F.sum(F.col("copies") * F.col("words")).over(all_of)).alias("rest"))


def pareto_place(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, brought into 0 to 1 in the same order; 1 where ``p`` is 0."""
    a, b = u * (F.lit(1.0) - p), p * (F.lit(1.0) - u)
    return F.when(p <= 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(a, a + b), F.lit(0.0)))


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1 (both excluded) that depends on the key only."""
    text = F.concat_ws(":", F.lit(seed), key)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def cuts(known: DataFrame) -> DataFrame:
    """``source, bucket, before``: the part of the order in which a source's rest runs out, the only one to be sorted.

    Documents with certain copies only have no place in the order; a source of nothing else has no cut.
    """
    # words per part of the order
    parts = known.filter("odds_left > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    return parts.filter("before <= rest and before + words > rest").select("source", "bucket", "before")


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs`` (``doc_id, text, source``).

    A document weighs as many as its size has digits: long texts are somewhat
    likelier. ``taken`` is whole copies times size, 0 for documents left out and for texts
    without words. NULL sources are one source, the last; NULL texts have size 0. Rows of
    one doc_id and size share the random number and so their order is by text hash; equal
    rows are told apart only where the cut falls between them, which their order may decide
    either way without changing the totals. An empty table gives an empty result.
    """
    sizes = materialise(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
    ).withColumn("weight", F.length(F.col("size").cast("string"))), "mix-sizes")
    targets = materialise(source_targets(ranked_sources(sizes), weights, max_copies), "mix-targets")
    copies = materialise(expected_copies(sizes, targets, max_copies), "mix-copies")
    known = sizes.alias("s").join(
        copies.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.weight") == F.col("c.weight")),
    ).select("s.doc_id", "s.source", "s.size", "s.tie", "c.target", "c.copies", "c.odds_left", "c.rest")
    known = known.withColumn("q", pareto_place(uniform(F.col("doc_id").cast("string"), seed), F.col("odds_left")))
    known = known.withColumn("bucket", F.least(F.floor(F.col("q") * buckets), F.lit(buckets - 1)).cast("int"))
    cut = cuts(known)
    cut = materialise(cut, "mix-cuts")  # one row per source
    known = known.alias("k").join(cut.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")), "left").select(
        "k.*", F.col("c.bucket").alias("cut"), "before")
    sure = known.filter("odds_left <= 0 or cut is null or bucket != cut").withColumn(
        "more", (F.col("cut").isNull() & (F.col("rest") > 0)) | (F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = known.filter("odds_left > 0 and bucket = cut").withColumn(
        "so_far", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    ).withColumn("more", F.col("so_far") + F.col("size") / 2.0 <= F.col("rest")).drop("so_far")
    taken = sure.unionByName(at_cut).withColumn(
        "taken", F.col("size") * (F.col("copies") + F.when(F.col("more") & (F.col("odds_left") > 0), 1).otherwise(0)))
    return taken.alias("t").join(targets.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source"))).select("doc_id", "size", "a.source_size", "a.target", "taken")
