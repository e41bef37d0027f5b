"""Running aggregates over groups of any size.

A window over ``partitionBy(key).orderBy(position)`` puts a whole group into
one task. Captures and flows can be arbitrarily large (one flood can be a third
of all packets), so the running value is computed in two levels instead:

1. positions are cut into blocks of ``block_rows``; a window over (group, block)
   never sees more than ``block_rows`` rows;
2. each (group, block) is reduced to one partial row by a hash aggregate with
   map-side combine, and a window over those partials gives what came *before*
   every block. A group of n rows has n / block_rows partials.

The two parts are put together by a join on (group, block). When no group
reaches past one block, which one cheap aggregate over two columns finds out,
step 2 and the join are left out of the plan.

Several levels of groups (captures, flows inside them) share one carry table,
built in one more pass over the bare source: see :func:`running_levels`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
DEFAULT_BLOCK_ROWS = 250_000


@dataclass(frozen=True)
class Run:
    """One running value. ``fn``: count, sum, min, max, first or prev (the value one row before)."""

    name: str
    fn: str
    value: Column | None = None


@dataclass(frozen=True)
class Blocks:
    """A frame cut into blocks inside ``scope``; ``multi`` tells whether any scope has two blocks."""

    df: DataFrame
    scope: tuple[str, ...]
    order: str
    multi: bool


def cut_blocks(
    df: DataFrame, scope: list[str], order: str, block_rows: int = DEFAULT_BLOCK_ROWS, multi: bool | None = None
) -> Blocks:
    """Cut ``df`` into blocks of consecutive positions.

    ``order`` must be a whole number that is unique inside the scope, so that a
    block of ``block_rows`` positions holds at most that many rows.
    """
    cut = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_rows)).cast("bigint"))
    if multi is None:
        ends = cut.groupBy(*scope).agg(F.min(BLOCK).alias("lo"), F.max(BLOCK).alias("hi"))
        multi = not ends.filter("lo < hi").isEmpty()
    return Blocks(cut, tuple(scope), order, multi)


def _partial(run: Run, order: str) -> Column:
    if run.fn == "count":
        return F.count(run.value if run.value is not None else F.lit(1))
    if run.fn == "first":
        return F.min_by(run.value, F.col(order))
    if run.fn == "prev":
        return F.max_by(run.value, F.col(order))
    return getattr(F, run.fn)(run.value)


def _merge(run: Run, partial: Column) -> Column:
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "first": F.first, "prev": F.last}[run.fn](
        partial
    )


def _local(run: Run, ordered, upto) -> Column:
    if run.fn == "prev":
        return F.lag(run.value, 1).over(ordered)
    if run.fn == "count":
        return F.count(run.value if run.value is not None else F.lit(1)).over(upto)
    return getattr(F, run.fn)(run.value).over(upto)


def _combine(run: Run, local: Column, before: Column) -> Column:
    if run.fn in ("count", "sum"):
        return F.when(before.isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + before)
    if run.fn == "min":
        return F.least(local, before)
    if run.fn == "max":
        return F.greatest(local, before)
    if run.fn == "first":
        return F.coalesce(before, local)
    return F.coalesce(local, before)


def partials(df: DataFrame, keys: list[str], runs: list[Run], order: str) -> DataFrame:
    """One row per key with the reduced value of every run."""
    return df.groupBy(*keys).agg(*[_partial(r, order).alias(r.name) for r in runs])


def carries(part: DataFrame, by: list[str], runs: list[Run], block: str = BLOCK) -> DataFrame:
    """For every (by, block) partial, the merged value of all earlier blocks of the group."""
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    out = part.select(
        *by, block, F.count(F.lit(1)).over(earlier).alias("_n"),
        *[_merge(r, F.col(r.name)).over(earlier).alias(f"_before_{r.name}") for r in runs],
    )
    return out.filter("_n > 0").drop("_n")


def running(blocks: Blocks, by: list[str], runs: list[Run], carry: DataFrame | None = None) -> Blocks:
    """Add each run as a column: its value over the group up to and including the row.

    ``by`` must contain the scope of the blocks. Rows with a NULL in ``by`` get
    the value of their own block only; callers mask them. ``carry`` replaces
    the computed per-block starting values.
    """
    keys = [*by, BLOCK]
    ordered = Window.partitionBy(*blocks.scope, BLOCK, *[c for c in by if c not in blocks.scope]).orderBy(
        blocks.order
    )
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = blocks.df.withColumns({r.name: _local(r, ordered, upto) for r in runs})
    if carry is None and blocks.multi:
        known = blocks.df.dropna(subset=[c for c in by if c not in blocks.scope])
        carry = carries(partials(known, keys, runs, blocks.order), by, runs)
    if carry is not None:
        df = df.join(carry, keys, "left").withColumns(
            {r.name: _combine(r, F.col(r.name), F.col(f"_before_{r.name}")) for r in runs}
        ).drop(*[f"_before_{r.name}" for r in runs])
    return Blocks(df, blocks.scope, blocks.order, blocks.multi)


@dataclass(frozen=True)
class Level:
    """Runs over one kind of group: the scope of the blocks and the columns ``by``."""

    by: tuple[str, ...]
    runs: list[Run]


_LEVEL = "_level"


def level_carries(blocks: Blocks, levels: list[Level]) -> DataFrame:
    """One table of starting values for all levels: ``scope, by..., _block, _level, _before_<run>...``.

    Every source row counts once per level in one map-side aggregate, so that all levels cost one pass, one exchange of
    partials and one of their prefix sums. A row whose ``by`` holds a NULL belongs to no group of that level.
    """
    names = list(dict.fromkeys(c for lv in levels for c in lv.by))
    level = F.col(_LEVEL)
    rows = blocks.df.withColumn(_LEVEL, F.explode(F.array(*[F.lit(i) for i in range(len(levels))])))
    known = F.lit(False)
    for i, lv in enumerate(levels):
        whole = F.lit(True)
        for c in lv.by:
            whole = whole & F.col(c).isNotNull()
        known = known | ((level == i) & whole)

    def member(c: str) -> Column:
        return level.isin([i for i, lv in enumerate(levels) if c in lv.by])

    # Keys of their own: the runs may read the columns that other levels group by.
    rows = rows.filter(known).withColumns({f"_key_{c}": F.when(member(c), F.col(c)) for c in names})
    keys = [*blocks.scope, *[f"_key_{c}" for c in names], _LEVEL]
    runs = [
        Run(r.name, r.fn, F.when(level == i, r.value if r.value is not None else F.lit(1)))
        for i, lv in enumerate(levels) for r in lv.runs]
    part = partials(rows, [*keys, BLOCK], runs, blocks.order)
    return carries(part, keys, runs).withColumnsRenamed({f"_key_{c}": c for c in names})


def running_levels(blocks: Blocks, levels: list[Level]) -> Blocks:
    """:func:`running` for several levels at once.

    With several blocks, the starting values join the rows as rows of their own, in front of the block's: one exchange on (scope,
    block) takes both, and the windows of all levels are sorts inside it. A block gets at most one such row per group that occurs in
    it. Run names must differ.
    """
    if not blocks.multi:
        for lv in levels:
            blocks = running(blocks, [*blocks.scope, *lv.by], lv.runs)
        return blocks
    carry = level_carries(blocks, levels)
    befores = {f"_before_{r.name}": carry.schema[f"_before_{r.name}"].dataType for lv in levels for r in lv.runs}
    own = blocks.df.select("*", F.lit(None).cast("int").alias(_LEVEL), *[F.lit(None).cast(t).alias(c) for c, t in befores.items()])
    rows = own.unionByName(carry, allowMissingColumns=True).repartition(*blocks.scope, BLOCK)
    level, is_row = F.col(_LEVEL), F.col(_LEVEL).isNull()
    for i, lv in enumerate(levels):
        foreign = level.isNotNull() & (level != i)
        ordered = Window.partitionBy(*blocks.scope, BLOCK, *lv.by, F.coalesce(foreign, F.lit(False))).orderBy(is_row, blocks.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {}
        for r in lv.runs:
            counted = F.when(r.value.isNotNull(), F.lit(1)) if r.value is not None else F.lit(1)
            value = F.when(is_row, counted if r.fn == "count" else r.value).otherwise(F.col(f"_before_{r.name}"))
            if r.fn == "count":
                columns[r.name] = F.coalesce(F.sum(value).over(upto), F.lit(0)).cast("bigint")
            else:
                columns[r.name] = _local(Run(r.name, r.fn, value), ordered, upto)
        rows = rows.withColumns(columns)
    return Blocks(rows.filter(is_row).drop(_LEVEL, *befores), blocks.scope, blocks.order, blocks.multi)
