"""Counts, column statistics and exact order statistics."""

from __future__ import annotations

from math import ceil, floor, sqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.schemas import q

# A single aggregate may hold this many values; beyond it values are found digit by digit.
EXACT_VALUES = 2_000_000
# Different values of a column that a task counts one by one.
FEW_VALUES = 4_096
# Approximate quantiles may be off by one in so many values.
SKETCH_ACCURACY = 10_000


# ---- counts ------------------------------------------------------------------------------------


def label_counts(df: DataFrame, by: str = S.LABEL, total: bool = False) -> DataFrame:
    """Rows per class, largest first; ``total`` adds a TOTAL row."""
    counts = (df.rollup(by) if total else df.groupBy(by)).agg(F.count(F.lit(1)).alias("n"))
    if total:
        counts = counts.withColumn(by, F.coalesce(by, F.lit("TOTAL")))
    return counts.orderBy(F.desc("n"), by)


def class_distribution(df: DataFrame, by: str = S.LABEL) -> DataFrame:
    """Rows and percentage per class. The window runs over one row per class."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", share)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


class StepCounts:
    """Rows and columns behind each step of a chain, counted while the chain runs: no job of its own.

    ``step`` wraps a table; after the one action that runs the chain (a write), ``table`` has a row per step. Steps that the plan
    passes over more than once (a table read by two branches) are counted by the first pass that ends.
    """

    def __init__(self):
        self._steps: list[tuple[str, int, Observation]] = []

    def step(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{name}-{uuid4().hex}")
        self._steps.append((name, len(df.columns), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, name, int(seen.get["n_rows"]), width) for i, (name, width, seen) in enumerate(self._steps)]
        return spark.createDataFrame(rows, "place int, step string, n_rows bigint, n_columns int")


# ---- one-pass statistics -----------------------------------------------------------------------


def finite(c: Column) -> Column:
    """NaN and infinities become NULL: in Spark NaN is larger than every number, infinity included."""
    return F.when(F.abs(c) < float("inf"), c)


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """``pos, x``: one row per value, ``pos`` being the place of its column.

    Aggregating many columns in one wide aggregate makes methods too long for
    the JIT compiler. This form exists only between the scan and the map-side
    aggregation in the same stage, so it adds nothing to the shuffle.
    """
    values = F.array(*[F.col(q(c)).cast("double") for c in columns])
    return df.select(*keep, F.posexplode(values).alias("pos", "x"))


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-null values per column."""
    rows = long_form(df, columns).groupBy("pos").agg(F.count("x").alias("n")).collect()  # one row per column
    found = {r["pos"]: r["n"] for r in rows}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """count, mean, population std and variance of all columns in one pass."""
    if not columns:
        return {}
    rows = long_form(df, columns).groupBy("pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
    ).collect()  # one row per column
    found = {
        r["pos"]: {"n": r["n"], "mean": r["mean"], "std": None if r["var"] is None else sqrt(r["var"]), "var": r["var"]}
        for r in rows
    }
    return {c: found.get(i, {"n": 0, "mean": None, "std": None, "var": None}) for i, c in enumerate(columns)}


def _limbs(x: Column) -> list[Column]:
    """``cast(x as decimal(28,9))`` as whole numbers: billions, what is left of the whole part, billionths.

    ``x * 1e9`` and the shortest text of x, which the cast reads, lie within 2**-52 of the billionths of each other. Unless half a billionth is
    that near, both round to the same number and the text is not needed. Values from a million on take the cast.
    """
    billionths = x * 1e9
    k = F.rint(billionths)
    sure = (F.abs(x) < 1e6) & (F.abs(billionths - k) + F.abs(billionths) * 2.3e-16 < 0.5)
    text, billion = x.cast("decimal(28,9)"), F.expr("1000000000BD")
    return [
        F.when(sure, F.lit(0)).otherwise((text / billion).cast("bigint")),
        F.when(sure, (k / 1e9).cast("bigint")).otherwise((text % billion).cast("bigint")),
        F.when(sure, k.cast("bigint") % 1_000_000_000).otherwise((text % F.expr("1BD") * billion).cast("bigint")),
    ]


def decimal_sums(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``by, n`` and the exact sum of every column, each value as ``decimal(28,9)``; decimals are made of the sums, not of the values."""
    limbs = {c: _limbs(F.col(q(c)).cast("double")) for c in columns}
    sums = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"_{i}_{j}") for i, c in enumerate(columns) for j, x in enumerate(limbs[c])])

    def total(i: int) -> Column:
        billions, whole, rest = (F.col(f"_{i}_{j}").cast("decimal(19,0)") for j in range(3))
        full = (billions * F.expr("1000000000BD") + whole).cast("decimal(28,0)")
        return (full + rest * F.expr("0.000000001BD")).cast("decimal(38,9)")

    return sums.select(by, "n", *[total(i).alias(c) for i, c in enumerate(columns)])


# ---- exact order statistics --------------------------------------------------------------------


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], exact_values: int = EXACT_VALUES,
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based sorted positions of numeric columns, at any size.

    Spark's exact percentiles keep every distinct value of a column in one
    task, so they are only used for as many columns at once as hold at most
    ``exact_values`` values together. Of the larger columns, those of few different
    values are counted in one pass; all others go through one search
    together, whose number of passes is bounded: see ``_by_digits``.
    """
    out: dict[tuple[str, int], float] = {}
    batch: list[str] = []
    for c in sorted((c for c in ranks if ranks[c] and counts[c] <= exact_values), key=lambda c: counts[c]):
        if batch and sum(counts[b] for b in batch) + counts[c] > exact_values:
            out |= _small_order_statistics(df, {b: ranks[b] for b in batch}, counts)
            batch = []
        batch.append(c)
    if batch:
        out |= _small_order_statistics(df, {b: ranks[b] for b in batch}, counts)
    large = {c: ranks[c] for c in ranks if ranks[c] and counts[c] > exact_values}
    if large:
        few = _of_few_values(df, large)
        out |= few
        large = {c: rs for c, rs in large.items() if (c, rs[0]) not in few}
    return out | _by_digits(df, large, exact_values) if large else out


# A double is read as a whole number of 64 bits in the same order, a digit of so many bits at a time: (bits below, bits).
DIGITS = ((53, 11), (42, 11), (31, 11), (20, 11), (9, 11), (0, 9))


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _keys_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return _ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))


def _signed(keys: np.ndarray) -> np.ndarray:
    """The same order as whole numbers with a sign, as Spark has them."""
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _at_ranks(found: DataFrame, wanted: list[tuple[int, int, int, int]]) -> list[Row]:
    """``i, r, v, n, rest``: the ``v`` of ``found`` (``grp, v, n``) that holds rank ``rest`` of its group, and the rank among its ``n``.

    ``wanted`` lists ``(grp, i, r, rest)``. A group of ``found`` is a bounded number of rows.
    """
    sought = found.sparkSession.createDataFrame(wanted, "grp bigint, i int, r bigint, rest bigint")
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("v"))
    return found.select("grp", "v", "n", upto.alias("upto")).join(F.broadcast(sought), "grp").filter(
        "upto - n <= rest and rest < upto").select(
        "i", "r", "v", "n", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect()  # one row per value sought


def _of_few_values(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Order statistics of the columns that hold few different values, by one pass that counts them.

    A task gives up on a column at its first value beyond ``FEW_VALUES``, so columns of many values cost little. They are left out.
    """
    columns = list(ranks)
    data = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def count(batches):
        known = {i: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i in range(len(columns))}
        for batch in batches:
            for i, (values, n) in list(known.items()):
                keys = _keys_of(batch, i)
                if len(values):
                    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
                    hit = values[at] == keys
                    n = n + np.bincount(at[hit], minlength=len(values))
                    keys = keys[~hit]
                if len(keys):
                    more, n_more = np.unique(keys, return_counts=True)
                    values, n = np.concatenate([values, more]), np.concatenate([n, n_more])
                    order = np.argsort(values)
                    values, n = values[order], n[order]
                if len(values) > FEW_VALUES:
                    del known[i]
                else:
                    known[i] = values, n
        for i in range(len(columns)):
            values, n = known.get(i, (None, None))
            cells = [pa.nulls(1, pa.int64())] * 2 if values is None else [pa.array(_signed(values)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), i, np.int64)), *cells], ["grp", "v", "n"])

    counted = data.mapInArrow(count, "grp bigint, v bigint, n bigint").groupBy("grp", "v").agg(F.sum("n").alias("n"))
    given_up = F.max(F.col("v").isNull()).over(Window.partitionBy("grp"))
    few = counted.withColumn("many", given_up).filter("not many").drop("many")
    rows = _at_ranks(few, [(i, i, r, r) for i, c in enumerate(columns) for r in set(ranks[c])])
    return {(columns[x["i"]], x["r"]): _double(x["v"] + (1 << 63)) for x in rows}


def _by_digits(df: DataFrame, ranks: dict[str, list[int]], exact_values: int = EXACT_VALUES) -> dict[tuple[str, int], float]:
    """Order statistics by radix search: every pass fixes one digit of all values sought, in all columns at once.

    A pass counts the values of each column that agree with the digits known so
    far by their next digit; the digit that holds the rank follows from the
    counts. Ties need no care, and there are at most ``len(DIGITS)`` passes whatever the data: as soon as
    at most ``exact_values`` values agree with what is sought, one last pass counts these by value.
    """
    columns = list(ranks)
    data = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sought = {(i, r): (0, r) for i, c in enumerate(columns) for r in set(ranks[c])}  # (digits so far, rank among those)
    left = None  # values that agree with the digits sought
    for below, bits in DIGITS:
        groups = sorted({(i, known) for (i, _), (known, _) in sought.items()})
        place = {g: k for k, g in enumerate(groups)}
        layout = {
            i: (place[(i, min(own))], np.array(sorted(own), np.uint64))
            for i in range(len(columns)) for own in [{k for j, k in groups if j == i}]
        }

        def agreeing(batch, i, above, layout):
            """Group and key of the values of a column whose digits ``above`` are sought."""
            first, known = layout[i]
            key = _keys_of(batch, i)
            if above == 64:  # nothing is known yet
                return np.full(len(key), first), key
            top = key >> np.uint64(above)
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            hit = known[at] == top
            return first + at[hit], key[hit]

        def count(batches, below=below, bits=bits, n_groups=len(groups), layout=layout, agreeing=agreeing):
            cells = np.zeros(n_groups << bits, np.int64)
            for batch in batches:
                for i in layout:
                    group, key = agreeing(batch, i, below + bits, layout)
                    digit = (key >> np.uint64(below)) & np.uint64((1 << bits) - 1)
                    np.add.at(cells, (group << bits) | digit.astype(np.int64), 1)
            used = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used >> bits), pa.array(used & ((1 << bits) - 1)), pa.array(cells[used])], ["grp", "v", "n"])

        def gather(batches, above=below + bits, layout=layout, agreeing=agreeing):
            for batch in batches:
                for i in layout:
                    group, key = agreeing(batch, i, above, layout)
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(_signed(key)), pa.array(np.ones(len(key), np.int64))], ["grp", "v", "n"])

        last = left is not None and left <= exact_values
        found = data.mapInArrow(gather if last else count, "grp bigint, v bigint, n bigint").groupBy("grp", "v").agg(F.sum("n").alias("n"))
        rows = _at_ranks(found, [(place[(i, known)], i, r, rest) for (i, r), (known, rest) in sought.items()])
        if last:
            return {(columns[x["i"]], x["r"]): _double(x["v"] + (1 << 63)) for x in rows}
        held = {}
        for x in rows:
            known = (sought[(x["i"], x["r"])][0] << bits) | x["v"]
            sought[(x["i"], x["r"])] = known, x["rest"]
            held[(x["i"], known)] = x["n"]
        left = sum(held.values())
    return {(columns[i], r): _double(key) for (i, r), (key, _) in sought.items()}


def _small_order_statistics(df, ranks, counts) -> dict[tuple[str, int], float]:
    """Exact aggregate whose state is bounded by the checked number of values."""
    wanted = {c: sorted(set(rs)) for c, rs in ranks.items()}
    exprs = []
    for i, (c, rs) in enumerate(wanted.items()):
        shares = ", ".join(f"{(r + 0.5) / counts[c]!r}D" for r in rs)
        exprs.append(F.expr(
            f"percentile_disc(array({shares})) within group (order by cast({q(c)} as double))"
        ).alias(f"p{i}"))
    row = df.agg(*exprs).first()
    return {(c, r): row[f"p{i}"][j] for i, (c, rs) in enumerate(wanted.items()) for j, r in enumerate(rs)}


def quantiles(
    df: DataFrame, shares: dict[str, list[float]], exact_values: int = EXACT_VALUES, counts: dict[str, int] | None = None,
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation between neighbours; None for an empty column. ``counts`` are the known values, if counted."""
    if not shares:
        return {}
    counts = value_counts(df, list(shares)) if counts is None else counts
    where = {(c, p): p * (counts[c] - 1) for c, ps in shares.items() for p in ps if counts[c]}
    ranks: dict[str, list[int]] = {}
    for (c, _), at in where.items():
        ranks.setdefault(c, []).extend([floor(at), ceil(at)])
    values = order_statistics(df, ranks, counts, exact_values)
    out: dict[tuple[str, float], float | None] = {(c, p): None for c, ps in shares.items() for p in ps}
    for (c, p), at in where.items():
        a, b = values[(c, floor(at))], values[(c, ceil(at))]
        out[(c, p)] = a + (b - a) * (at - floor(at))
    return out


def filled_quantiles(
    df: DataFrame, gaps: list[str], shares: dict[str, list[float]], counts: dict[str, int], rows: int, exact_values: int = EXACT_VALUES,
) -> tuple[dict[str, float | None], dict[tuple[str, float], float | None]]:
    """Medians of the columns with ``gaps``, and quantiles of columns once their gaps hold the median, by one search of the known values.

    A median lies between its two neighbours, so its copies stand right behind the lower one and move later ranks by their number.
    """
    middle = {c: 0.5 * (counts[c] - 1) for c in gaps if counts[c]}

    def place(c: str, r: int) -> int | None:
        """Rank among the known values; None where a copy of the median is."""
        lower = floor(middle[c]) if c in middle else rows
        copies = rows - counts[c]
        return r if r <= lower else None if r <= lower + copies else r - copies

    where = {(c, p): p * (rows - 1) for c, ps in shares.items() for p in ps if counts[c]}
    ranks: dict[str, list[int]] = {c: [floor(at), ceil(at)] for c, at in middle.items()}
    for (c, _), at in where.items():
        ranks.setdefault(c, []).extend(r for r in (place(c, floor(at)), place(c, ceil(at))) if r is not None)
    values = order_statistics(df, ranks, counts, exact_values)

    def between(a: float, b: float, at: float) -> float:
        return a + (b - a) * (at - floor(at))

    medians: dict[str, float | None] = {c: None for c in gaps}
    for c, at in middle.items():
        medians[c] = between(values[(c, floor(at))], values[(c, ceil(at))], at)

    def value(c: str, r: int) -> float:
        known = place(c, r)
        return medians[c] if known is None else values[(c, known)]

    out: dict[tuple[str, float], float | None] = {(c, p): None for c, ps in shares.items() for p in ps}
    for (c, p), at in where.items():
        out[(c, p)] = between(value(c, floor(at)), value(c, ceil(at)), at)
    return medians, out


def sketched_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], accuracy: int = SKETCH_ACCURACY,
) -> dict[tuple[str, float], float | None]:
    """Approximate quantiles of all columns in one pass, by mergeable quantile sketches.

    Each is a value of the column whose rank is off by at most one in ``accuracy`` of its values; where values tie, the tie covers it.
    """
    rows = long_form(df, columns).filter("x is not null").groupBy("pos").agg(
        F.percentile_approx("x", shares, accuracy).alias("values")).collect()  # one row per column
    found = {columns[r["pos"]]: r["values"] for r in rows}
    return {(c, s): found[c][i] if c in found else None for c in columns for i, s in enumerate(shares)}


def column_statistics(df: DataFrame, columns: list[str], approximate: bool = False, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """``feature, n, median, mean, q80, std, variance`` for all columns.

    ``approximate`` takes median and 80 % quantile from :func:`sketched_quantiles`: one pass instead of six on large tables, a rank that may be
    off by one in ``accuracy``, and no interpolation between two values.
    """
    m = moments(df, columns)
    p = sketched_quantiles(df, columns, [0.5, 0.8], accuracy) if approximate else quantiles(df, {c: [0.5, 0.8] for c in columns})
    return df.sparkSession.createDataFrame(
        [(c, m[c]["n"], p[(c, 0.5)], m[c]["mean"], p[(c, 0.8)], m[c]["std"], m[c]["var"]) for c in columns],
        "feature string, n bigint, median double, mean double, q80 double, std double, variance double",
    )


# ---- distributions of one column ----------------------------------------------------------------


def time_statistics(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, min, max, population std and rows per second of a duration column."""
    x = F.col(q(column))
    median = quantiles(df, {column: [0.5]})[(column, 0.5)]
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.stddev_pop(x).alias("std"), F.try_divide(F.count(x), F.sum(x)).alias("throughput"),
    ).withColumn("median", F.lit(median))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n`` for equal-width bins over the data range, the last bin closed."""
    x = F.col(q(column))
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    low, high = ends["a"], ends["b"]
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n bigint")
    if low == high:  # a single value gets a range of one around it
        low, high = low - 0.5, high + 0.5
    number = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    filled = df.filter(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(filled, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_statistics(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the quartile range clipped to the data, and outliers."""
    p = quantiles(df, {column: [0.25, 0.5, 0.75]})
    q1, median, q3 = (p[(column, s)] for s in (0.25, 0.5, 0.75))
    x = F.col(q(column))
    if q1 is None:
        q1 = median = q3 = float("nan")
    reach = 1.5 * (q3 - q1)
    near = x.between(q1 - reach, q3 + reach)
    return df.agg(
        F.min(F.when(near, x)).alias("whisker_low"), F.max(F.when(near, x)).alias("whisker_high"),
        F.count(F.when(~near, 1)).alias("n_outliers"),
    ).select(
        F.lit(q1).alias("q1"), F.lit(median).alias("median"), F.lit(q3).alias("q3"),
        "whisker_low", "whisker_high", "n_outliers",
    )


def first_rows_of(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """``by, first``: the columns of the row with the smallest ``order`` of each class, as a struct.

    Few classes: Spark keeps an aggregate of texts and structs in a table of groups only beside one that collects, else it sorts (and spills)
    all rows with all columns. The list collects nothing, as NULLs are no entries.
    """
    rows = F.struct(*[F.col(q(c)) for c in columns])
    out = df.groupBy(by).agg(F.min_by(rows, order).alias("first"), F.collect_list(F.lit(None).cast("int")).alias("_none"))
    return out.filter(F.size("_none") == 0).drop("_none")
