"""Class balancing, sampling and splitting.

All choices are ranks of a hash of the row key, so every run and every cluster
layout picks the same rows. Class counts, quotas and cut points are small and
live on the driver, as one pass counts and a second one writes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.operators import ranking as R
from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

# Sizes of the balanced data set.
TOTAL_TARGET = 2_000_000
CAP_ATTACK = 54_545
MIN_SYNTHESIS_ROWS = 100
BENIGN, REFERENCE_CLASS = "Benign", "DDoS"


# ---- plan ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClassPlan:
    label: str
    available: int
    kept: int
    target: int
    way: str  # trim, synthesise, duplicate or fill

    @property
    def need(self) -> int:
        return max(self.target - self.kept, 0)


def balance_plan(counts: dict[str, int], cap: int = CAP_ATTACK, total: int = TOTAL_TARGET) -> list[ClassPlan]:
    """Target rows of every class: attacks level with each other, Benign fills up to ``total``."""
    if REFERENCE_CLASS not in counts:
        raise ValueError(f"no class {REFERENCE_CLASS} after label clean-up; check the labels")
    attacks = sorted(label for label in counts if label != BENIGN)
    target = min(counts[REFERENCE_CLASS], cap)
    plan = []
    for label in attacks:
        have = counts[label]
        way = "trim" if have >= target else "synthesise" if have >= MIN_SYNTHESIS_ROWS else "duplicate"
        plan.append(ClassPlan(label, have, min(have, target), target, way))
    needed = max(total - target * len(attacks), 0)
    have = counts.get(BENIGN, 0)
    # Without a single Benign row there is nothing to draw from.
    plan.append(ClassPlan(BENIGN, have, min(have, needed), needed if have else 0, "fill"))
    return plan


def plan_table(spark: SparkSession, plan: list[ClassPlan]) -> DataFrame:
    schema = "label string, available bigint, kept bigint, target bigint, need bigint, way string"
    return spark.createDataFrame(
        [(p.label, p.available, p.kept, p.target, p.need, p.way) for p in plan], schema
    )


# ---- draws with replacement --------------------------------------------------------------------

DRAW = "_draw"
DRAWS_PER_TASK = 100_000


def draw_index(label: Column, draw: Column, size: Column, seed: int, stream: int | Column = 0) -> Column:
    """Rank (1..size) that the draw picks; a hash, so any engine can repeat it."""
    stream = F.lit(stream) if isinstance(stream, int) else stream
    text = F.concat_ws(":", label, draw.cast("string"), stream.cast("string"), F.lit(str(seed)))
    number = F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
    return F.pmod(number, size) + 1


def draws(spark: SparkSession, need: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """``label, _draw, _size`` with draws 1..need per class, made by the executors."""
    parts = [
        spark.range(1, n + 1, 1, max(1, n // DRAWS_PER_TASK)).select(
            F.lit(label).alias(S.LABEL), F.col("id").alias(DRAW), F.lit(sizes[label]).cast("bigint").alias("_size")
        )
        for label, n in sorted(need.items()) if n > 0 and sizes.get(label, 0) > 0
    ]
    if not parts:
        return spark.createDataFrame([], f"{S.LABEL} string, {DRAW} bigint, _size bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _drawn_from(df: DataFrame, key: str, need: dict[str, int], counts: dict[str, int], seed: int, per: int):
    """Ranked rows of just the classes that something is drawn from."""
    labels = [label for label, n in need.items() if n > 0 and counts.get(label, 0) > 0]
    sizes = {label: counts[label] for label in labels}
    return R.with_rank(df.filter(F.col(S.LABEL).isin(labels)), S.LABEL, key, sizes or {"": 0}, seed, per), sizes


def oversample(
    df: DataFrame, key: str, need: dict[str, int], counts: dict[str, int],
    seed: int = R.SEED, rows_per_bucket: int = R.ROWS_PER_BUCKET,
) -> DataFrame:
    """``need[class]`` extra rows per class, drawn with replacement, with ``_draw``."""
    ranked, sizes = _drawn_from(df, key, need, counts, seed, rows_per_bucket)
    picks = draws(df.sparkSession, need, sizes)
    picks = picks.withColumn(R.RANK, draw_index(F.col(S.LABEL), F.col(DRAW), F.col("_size"), seed)).drop("_size")
    return picks.join(ranked, [R.RANK, S.LABEL]).drop(R.RANK)  # sorted by a number first, not by a few names


# Columns that are drawn together, so that a synthetic row keeps what belongs together.
COLUMN_GROUPS = [
    ["flow_duration", "Header_Length", "Protocol Type", "Duration"],
    ["Rate", "Srate", "Drate", "IAT"],
    [c for c in S.FEATURES if c.endswith(("_flag_number", "_count"))],
    S.FEATURES[S.FEATURES.index("HTTP"):S.FEATURES.index("Tot sum")],
    ["Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "Number"],
    ["Magnitue", "Radius", "Covariance", "Variance", "Weight"],
]


def synthesise(
    df: DataFrame, key: str, need: dict[str, int], counts: dict[str, int],
    groups: list[list[str]] | None = None, seed: int = R.SEED, rows_per_bucket: int = R.ROWS_PER_BUCKET,
) -> DataFrame:
    """``need[class]`` new rows per class: every column group is drawn on its own inside the class.

    Values always come from real rows of the class, so 0/1 columns stay 0/1. A ranked row is cut into its groups, each draw is repeated per
    group and meets just that group's values; a draw's groups are put together again. Columns are numbers; whole ones must fit a double.
    """
    groups = COLUMN_GROUPS if groups is None else groups
    groups = [[c for c in g if c in df.columns] for g in groups]
    groups = [g for g in groups if g]
    used = list(dict.fromkeys(c for g in groups for c in g))
    ranked, sizes = _drawn_from(df.select(key, S.LABEL, *[S.q(c) for c in used]), key, need, counts, seed, rows_per_bucket)
    values = F.array(*[F.array(*[F.col(S.q(c)).cast("double") for c in g]) for g in groups])
    parts = ranked.select(S.LABEL, R.RANK, F.posexplode(values).alias("_group", "_values"))
    picks = draws(df.sparkSession, need, sizes).withColumn(
        "_group", F.explode(F.array(*[F.lit(i) for i in range(len(groups))]))
    )
    picks = picks.withColumn(
        R.RANK, draw_index(F.col(S.LABEL), F.col(DRAW), F.col("_size"), seed, F.col("_group") + 1)
    ).drop("_size")
    joined = picks.join(parts, [R.RANK, "_group", S.LABEL])
    # Lists per draw would be sorted on both sides of the shuffle. Every draw has each group once, so the i-th row behind its first is group i.
    of_draw = Window.partitionBy(DRAW, S.LABEL).orderBy("_group")
    whole = joined.select(S.LABEL, DRAW, "_group", *[
        (F.lead("_values", i).over(of_draw) if i else F.col("_values")).alias(f"_values{i}") for i in range(len(groups))
    ]).filter(F.col("_group") == 0)
    return whole.select(S.LABEL, DRAW, *[
        F.col(f"_values{i}")[j].cast(df.schema[c].dataType).alias(c) for i, g in enumerate(groups) for j, c in enumerate(g)
    ])


def append_synthetic(real: DataFrame, *extra: DataFrame) -> DataFrame:
    """Real rows, then drawn ones, matched by column name, with ``is_synthetic``."""
    columns = real.columns
    out = real.withColumn("is_synthetic", F.lit(False))
    for more in extra:
        have = [F.col(S.q(c)) if c in more.columns else F.lit(None).cast(real.schema[c].dataType).alias(c) for c in columns]
        out = out.unionByName(more.select(*have, F.lit(True).alias("is_synthetic")))
    return out


def balanced_dataset(
    df: DataFrame, key: str, cap: int = CAP_ATTACK, total: int = TOTAL_TARGET, seed: int = R.SEED,
    rows_per_bucket: int = R.ROWS_PER_BUCKET, counts: dict[str, int] | None = None,
) -> DataFrame:
    """Level attack classes and Benign up to ``total`` rows; ``df`` has clean labels."""
    counts = R.class_counts(df, S.LABEL) if counts is None else counts
    plan = balance_plan(counts, cap, total)
    kept = R.take_random(df, S.LABEL, key, {p.label: p.kept for p in plan}, counts, seed, rows_per_bucket)
    copies = {p.label: p.need for p in plan if p.way in ("duplicate", "fill")}
    made = {p.label: p.need for p in plan if p.way == "synthesise"}
    extra = []
    if any(made.values()):
        extra.append(synthesise(df, key, made, counts, seed=seed, rows_per_bucket=rows_per_bucket))
    if any(copies.values()):
        extra.append(oversample(df, key, copies, counts, seed, rows_per_bucket))
    return append_synthetic(kept, *extra)


def kept_report(df: DataFrame, key: str, cap: int = CAP_ATTACK, total: int = TOTAL_TARGET, seed: int = R.SEED) -> DataFrame:
    """Per class: available, kept, target, written, way used, and the grand total written."""
    counts = R.class_counts(df, S.LABEL)
    written = balanced_dataset(df, key, cap, total, seed, counts=counts).groupBy(S.LABEL).agg(
        F.count(F.lit(1)).alias("written"),
        F.sum(F.col("is_synthetic").cast("bigint")).alias("synthetic"),
    )
    plan = F.broadcast(plan_table(df.sparkSession, balance_plan(counts, cap, total)))  # one row per class
    out = written.join(plan, S.LABEL)
    return out.select(S.LABEL, "available", "kept", "target", "written", "synthetic", "way")


# ---- samples and splits ------------------------------------------------------------------------


RANGE = "_range"
TOP_K_ROWS = 1_000     # rows that every task may send to one
MAX_RANGES = 1_000_000


def cap_per_class(df: DataFrame, key: str, cap: int, by: str = S.LABEL, seed: int = R.SEED, **kw) -> DataFrame:
    """At most ``cap`` random rows of every class."""
    counts = R.class_counts(df, by)
    return R.take_random(df, by, key, {g: min(n, cap) for g, n in counts.items()}, counts, seed, **kw)


def cap_first_come(df: DataFrame, position: str, cap: int, by: str = S.LABEL, rows_per_bucket: int = R.ROWS_PER_BUCKET) -> DataFrame:
    """The first ``cap`` rows of every class in file order: what a scan that stops when full would keep."""
    counts = R.class_counts(df, by)
    quota = {g: min(n, cap) for g, n in counts.items()}
    return R.take_first(df, by, R.file_order(position, rows_per_bucket), quota, counts)


def downsample_exact(df: DataFrame, key: str, n: int, seed: int = R.SEED, **kw) -> DataFrame:
    """Exactly ``n`` random rows (all, if there are fewer)."""
    return R.take_random(df, None, key, {None: n}, None, seed, **kw)


def stratified_quota(counts: dict[str, int], k: int) -> dict[str, int]:
    total = sum(counts.values())
    if k >= total:
        return dict(counts)
    return {g: min(n, max(1, k * n // total)) for g, n in counts.items()}


def stratified_sample(df: DataFrame, key: str, k: int, by: str = S.LABEL, seed: int = R.SEED, **kw) -> DataFrame:
    """About ``k`` rows in the class proportions, at least one of each class."""
    counts = R.class_counts(df, by)
    return R.take_random(df, by, key, stratified_quota(counts, k), counts, seed, **kw)


def random_split(df: DataFrame, key: str, seed: int = R.SEED, **kw) -> DataFrame:
    """``split`` = train / validation / test, 70/15/15, regardless of class."""
    n = df.count()
    rest = ceil(0.3 * n)
    test = ceil(0.5 * rest)
    parts = {None: [("train", n - rest), ("validation", rest - test), ("test", test)]}
    return R.assign_by_rank(df, None, key, parts, "split", {None: n}, seed, **kw)


def largest_remainder(counts: dict[str, int], total: int) -> dict[str, int]:
    """Share ``total`` out in proportion to the counts; whole numbers that add up exactly."""
    n = sum(counts.values())
    share = {g: c * total // n for g, c in counts.items()}
    left = total - sum(share.values())
    for g in sorted(counts, key=lambda g: (-(counts[g] * total % n), g))[:left]:
        share[g] += 1
    return share


def _check_strata(counts: dict[str, int]) -> None:
    small = [g for g, c in counts.items() if c < 2]
    if small:
        raise ValueError(f"classes with fewer than 2 rows cannot be split: {small}")


def stratified_split(
    df: DataFrame, key: str, by: str = S.LABEL, test_share: float | None = None, seed: int = R.SEED,
    counts: dict[str, int] | None = None, **kw
) -> DataFrame:
    """``split`` in the class proportions: 70/15/15, or train / test with ``test_share``."""
    counts = R.class_counts(df, by) if counts is None else counts
    _check_strata(counts)
    n = sum(counts.values())
    if test_share is not None:
        test = largest_remainder(counts, ceil(test_share * n))
        parts = {g: [("train", c - test[g]), ("test", test[g])] for g, c in counts.items()}
    else:
        rest = largest_remainder(counts, ceil(0.3 * n))
        test = largest_remainder(rest, ceil(0.5 * sum(rest.values())))
        parts = {
            g: [("train", c - rest[g]), ("validation", rest[g] - test[g]), ("test", test[g])]
            for g, c in counts.items()
        }
    return R.assign_by_rank(df, by, key, parts, "split", counts, seed, **kw)


def head(df: DataFrame, key: str, n: int, top_k_rows: int = TOP_K_ROWS, rows_per_range: int = R.ROWS_PER_BUCKET) -> DataFrame:
    """The first ``n`` rows in key order: a top-k for few, else whole ranges of keys and the beginning of the next one.

    A top-k brings ``n`` rows of every task to one task; a range is one of many tasks, and the table is written once in ranges.
    """
    if n <= top_k_rows:
        return df.orderBy(key).limit(n)
    ranges = -(-df.count() // rows_per_range)
    placed = materialise(df.repartitionByRange(max(ranges, 1), key).withColumn(RANGE, F.spark_partition_id()), "ranges")
    before, edge = 0, -1
    for r in sorted(bounded_rows(placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")), MAX_RANGES, "ranges")):
        edge = r[RANGE]
        if before + r["n"] >= n:
            break
        before += r["n"]
    last = placed.filter(F.col(RANGE) == edge).orderBy(key).limit(n - before)
    return placed.filter(F.col(RANGE) < edge).unionByName(last).drop(RANGE).orderBy(key)


def stratified_folds(df: DataFrame, key: str, k: int = 3, by: str = S.LABEL, seed: int = R.SEED, **kw) -> DataFrame:
    """``fold`` = 0..k-1; class counts differ by at most one between folds."""
    ranked = R.with_rank(df, by, key, None, seed, **kw)
    return ranked.withColumn("fold", ((F.col(R.RANK) - 1) % k).cast("int")).drop(R.RANK)


def stratified_parts(
    df: DataFrame, key: str, k: int = 3, by: str = S.LABEL, seed: int = R.SEED, counts: dict[str, int] | None = None, **kw
) -> DataFrame:
    """``fold`` = 0..k-1 as in :func:`stratified_folds`, but runs of the random order instead of every k-th row: thresholds, so no row moves."""
    counts = R.class_counts(df, by) if counts is None else counts
    parts = {g: [(str(i), n // k + (i < n % k)) for i in range(k)] for g, n in counts.items()}
    return R.assign_by_rank(df, by, key, parts, "fold", counts, seed, **kw).withColumn("fold", F.col("fold").cast("int"))
