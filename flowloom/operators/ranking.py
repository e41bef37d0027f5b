"""Deterministic random order, without sorting any class in one task.

A row's place in its class is the rank of ``md5(key:seed)`` (ties by key). The
operators here need either a *threshold* (the hash of the k-th row, after which
sampling and splitting are plain filters that move no rows) or the *rank*
itself. Both work from a histogram of hash prefixes: prefixes are uniform
whatever the class sizes are, so even a class that holds a third of all rows is
spread over as many tasks as there are prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.bounded import MAX_CLASSES, bounded_rows, small_copy

SEED = 42
ROWS_PER_BUCKET = 500_000
MAX_BITS = 24
PLACE, BUCKET, RANK = "_place", "_bucket", "_rank"
NOTHING, EVERYTHING = "", "~"  # sort before and after every hash


def place(key: str | Column, seed: int = SEED) -> Column:
    """Sortable text: the row's hash, then its key, so that no two rows tie."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.concat(F.md5(F.concat(text, F.lit(f":{seed}"))), text)


def bucket(place_column: Column, bits: int) -> Column:
    """The first ``bits`` bits of the hash, as a number."""
    if bits == 0:
        return F.lit(0)
    prefix = F.conv(F.substr(place_column, F.lit(1), F.lit(6)), 16, 10).cast("int")
    return F.shiftright(prefix, 24 - bits)


def bits_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Prefix length that leaves about ``rows_per_bucket`` rows of the largest class per prefix."""
    return min(MAX_BITS, max(0, ceil(log2(max(rows, 1) / rows_per_bucket))))


def class_counts(df: DataFrame, by: str | None) -> dict[str | None, int]:
    """Rows per class, on the driver; classes are checked to be few. Rows without a class do not count."""
    if by is None:
        return {None: df.count()}
    rows = bounded_rows(df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")))
    return {r[0]: r[1] for r in rows}


@dataclass(frozen=True)
class Cut:
    """The first ``rank`` rows of class ``group`` are those with ``place <= last``."""

    group: str | None
    rank: int
    last: str | int


@dataclass(frozen=True)
class Order:
    """A sortable ``place`` per row (no ties), and a number that never decreases along it."""

    place: Column
    bucket: Column


def random_order(key: str, largest_class: int, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> Order:
    where = place(key, seed)
    return Order(where, bucket(where, bits_for(largest_class, rows_per_bucket)).cast("bigint"))


def file_order(position: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Order:
    """By a whole-number position; a bucket is a run of consecutive positions."""
    return Order(F.col(position), F.floor(F.col(position) / F.lit(rows_per_bucket)).cast("bigint"))


def _grouped(df: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    if by is None:
        return df.withColumn("_all", F.lit("")), "_all"
    return df, by


def _cumulative(hashed: DataFrame, by: str) -> DataFrame:
    """Rows of the class in all earlier buckets, per (class, bucket). At most 2**bits rows per class."""
    histogram = hashed.groupBy(by, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def cuts(df: DataFrame, by: str | None, order: Order, ranks: dict[str | None, list[int]]) -> list[Cut]:
    """The exact place of the wanted ranks of each class; every rank must lie inside its class.

    Job 1 finds the bucket of each rank from the histogram; job 2 ranks the rows
    of just those buckets. Only the class and key columns are read, and only rows of
    classes with a wanted rank are hashed.
    """
    wanted = [(g, r) for g, rs in ranks.items() for r in sorted(set(rs))]
    if not wanted:
        return []
    spark = df.sparkSession
    rows, by = _grouped(df if by is None else df.filter(F.col(by).isin([g for g in ranks if ranks[g]])), by)
    hashed = rows.select(by, order.place.alias(PLACE), order.bucket.alias(BUCKET))
    group_type = hashed.schema[by].dataType
    schema = T.StructType([T.StructField("_group", group_type), T.StructField("_want", T.LongType())])
    targets = F.broadcast(  # classes x marks rows, made on the driver
        spark.createDataFrame([("" if g is None else g, r) for g, r in wanted], schema)
    )
    edges = _cumulative(hashed, by).join(targets, F.col(by) == F.col("_group")).filter(
        (F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n"))
    ).select("_group", BUCKET, "_want", (F.col("_want") - F.col("_before")).alias("_inside"))
    limit = MAX_CLASSES * 8
    found = bounded_rows(edges, limit, "cut points")
    edge_schema = T.StructType([
        T.StructField("_group", group_type), T.StructField("_edge", T.LongType()),
        T.StructField("_want", T.LongType()), T.StructField("_inside", T.LongType()),
    ])
    edge = spark.createDataFrame([tuple(r) for r in found], edge_schema)
    buckets = F.broadcast(edge.select("_group", "_edge").distinct())
    in_bucket = hashed.join(buckets, (F.col(by) == F.col("_group")) & (F.col(BUCKET) == F.col("_edge")))
    inside = Window.partitionBy("_group", "_edge").orderBy(PLACE)
    ranked = in_bucket.withColumn("_inside", F.row_number().over(inside).cast("bigint"))
    hits = bounded_rows(
        ranked.select("_group", "_edge", "_inside", PLACE).join(F.broadcast(edge), ["_group", "_edge", "_inside"])
        .select("_group", "_want", PLACE), limit, "cut points",
    )
    return [Cut(None if by == "_all" else r["_group"], r["_want"], r[PLACE]) for r in hits]


def _with_last(df: DataFrame, by: str | None, last: dict[str | None, str | int | None], name: str, kind) -> DataFrame:
    """``df`` with the class's last place as a column: a literal, or a broadcast of one row per class."""
    if by is None:
        return df.withColumn(name, F.lit(last.get(None)).cast(kind))
    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField(name, kind)])
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(last.items()), schema)), by, "inner")


def take_first(df: DataFrame, by: str | None, order: Order, quota: dict[str | None, int], counts: dict) -> DataFrame:
    """The first ``quota[class]`` rows of each class; classes without a quota are dropped.

    Once the places of the last kept rows are known this is a filter: the rows
    themselves are neither shuffled nor sorted.
    """
    kind = df.select(order.place.alias(PLACE)).schema[PLACE].dataType
    some = {g: [q] for g, q in quota.items() if 0 < q < counts.get(g, 0)}
    last = {c.group: c.last for c in cuts(df, by, order, some)}
    last |= {g: None for g, q in quota.items() if q >= counts.get(g, 0) and q > 0}
    if by is None and not last:
        return df.filter(F.lit(False))
    kept = _with_last(df, by, last, "_last", kind)
    return kept.filter(F.col("_last").isNull() | (order.place <= F.col("_last"))).drop("_last")


def take_random(
    df: DataFrame, by: str | None, key: str, quota: dict[str | None, int],
    counts: dict[str | None, int] | None = None, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``quota[class]`` random rows of each class, without replacement."""
    counts = class_counts(df, by) if counts is None else counts
    order = random_order(key, max(counts.values(), default=0), seed, rows_per_bucket)
    return take_first(df, by, order, quota, counts)


def assign_by_rank(
    df: DataFrame, by: str | None, key: str, parts: dict[str | None, list[tuple[str, int]]], name: str,
    counts: dict[str | None, int], seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Name each row after the part its random rank falls into.

    ``parts[class]`` lists (name, size) in rank order; the last part takes what is left.
    """
    if not parts:
        return df.withColumn(name, F.lit(None).cast("string"))
    names = [n for n, _ in next(iter(parts.values()))]
    order = random_order(key, max(counts.values(), default=0), seed, rows_per_bucket)
    ends = {}
    for group, sizes in parts.items():
        total, ends[group] = 0, []
        for _, size in sizes[:-1]:
            total += size
            ends[group].append(total)
    inner = {g: [e for e in es if 0 < e < counts[g]] for g, es in ends.items()}
    found = {(c.group, c.rank): c.last for c in cuts(df, by, order, inner)}
    out = df
    for i in range(len(names) - 1):
        last = {
            g: NOTHING if es[i] <= 0 else found.get((g, es[i]), EVERYTHING) for g, es in ends.items()
        }
        out = _with_last(out, by, last, f"_last{i}", T.StringType())
    out = out.withColumn(PLACE, order.place)
    part = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        part = F.when(F.col(PLACE) <= F.col(f"_last{i}"), F.lit(names[i])).otherwise(part)
    return out.withColumn(name, part).drop(PLACE, *[f"_last{i}" for i in range(len(names) - 1)])


def with_rank(
    df: DataFrame, by: str | None, key: str, counts: dict[str | None, int] | None = None,
    seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``_rank``: 1, 2, ... in random order inside the class.

    Ranks inside a hash bucket come from a window over (class, bucket); what
    the earlier buckets hold is added from the histogram. The rows cross the
    network once, in even portions.
    """
    counts = class_counts(df, by) if counts is None else counts
    rows, group = _grouped(df, by)
    bits = bits_for(max(counts.values(), default=0), rows_per_bucket)
    hashed = rows.withColumn(PLACE, place(key, seed)).withColumn(BUCKET, bucket(F.col(PLACE), bits))
    inside = Window.partitionBy(group, BUCKET).orderBy(PLACE)
    ranked = hashed.withColumn(RANK, F.row_number().over(inside).cast("bigint"))
    if bits > 0:
        before = _cumulative(hashed.select(group, BUCKET), group).select(group, BUCKET, "_before")
        before = small_copy(before, 100_000).withColumnsRenamed({group: "_group", BUCKET: "_part"})
        same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(BUCKET) == F.col("_part"))  # NULL is a class too
        ranked = ranked.join(before, same).withColumn(RANK, F.col(RANK) + F.col("_before")).drop(
            "_before", "_group", "_part")
    return ranked.drop(PLACE, BUCKET, "_all")
