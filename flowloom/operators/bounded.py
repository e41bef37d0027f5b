"""Small tables that are brought to the driver or broadcast, each behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Labels, splits and features are dictionary-sized; more than this is a wrong input, not a big one.
MAX_CLASSES = 10_000


def bounded_rows(df: DataFrame, limit: int = MAX_CLASSES, what: str = "classes") -> list[Row]:
    """All rows of a table that must be small; never fetches more than ``limit + 1`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}; is this column really a class?")
    return rows


def small_side(df: DataFrame, limit: int = MAX_CLASSES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is.

    The check itself stops after ``limit + 1`` rows. Without the hint the join
    is a shuffle join that adaptive execution may split at skewed keys.
    """
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def small_copy(df: DataFrame, limit: int = MAX_CLASSES) -> DataFrame:
    """``small_side`` for a table that is costly to compute: its rows are fetched once, instead of counted and then computed again."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
