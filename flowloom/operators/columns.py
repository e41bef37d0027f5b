"""Column checks, label rows and 0/1 column detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.operators.statistics import long_form
from flowloom.schemas import q
from flowloom.sources.delimited import files_of, layouts


def column_check(columns: list[str], expected: list[str] | None = None) -> dict[str, list[str]]:
    """``missing`` and ``extra`` names against the expected ones."""
    expected = S.FLOW_COLUMNS if expected is None else expected
    return {
        "missing": [c for c in expected if c not in columns],
        "extra": [c for c in columns if c not in expected],
    }


def validate_columns(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """``column, status`` for every name that is missing or extra; empty when all is well."""
    check = column_check(df.columns, expected)
    rows = [(c, status) for status, names in check.items() for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def validate_files(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """``file, column, status`` for the files of a folder, by the header of each."""
    rows = [
        (file.rsplit("/", 1)[-1], c, status) for layout, files in layouts(spark, files_of(spark, path)).items()
        for status, names in column_check(list(layout.columns), expected).items() for c in names for file in files]
    return spark.createDataFrame(rows, "file string, column string, status string")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def label_column(df: DataFrame) -> str:
    """``label``, or the last column."""
    return S.LABEL if S.LABEL in df.columns else df.columns[-1]


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def detect_binary(df: DataFrame) -> list[str]:
    """Numeric columns whose values are all 0 or 1, with at least one value. One aggregate."""
    columns = numeric(df)
    if not columns:
        return []
    rows = long_form(df, columns).groupBy("pos").agg(F.bool_and(F.col("x").isin(0.0, 1.0)).alias("b")).collect()
    binary = {columns[r["pos"]] for r in rows if r["b"]}
    return [c for c in columns if c in binary]


def cast_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(q(c)).cast("boolean") for c in columns})


def uncast_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(q(c)).cast("int") for c in columns})


def detect_discrete(df: DataFrame) -> list[str]:
    """Text columns and 0/1 columns, in schema order."""
    binary = set(detect_binary(df))
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))}
    return [c for c in df.columns if c in binary or c in text]


def missing_features(df: DataFrame, selected: list[str]) -> tuple[list[str], list[str]]:
    """Selected features the table has, and those it does not."""
    return [c for c in selected if c in df.columns], [c for c in selected if c not in df.columns]
