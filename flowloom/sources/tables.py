"""Table sources and sinks of the dataset formats."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowloom import schemas as S
from flowloom.operators.bounded import bounded_rows, small_side
from flowloom.operators.columns import require_columns
from flowloom.operators.statistics import first_rows_of
from flowloom.sources.delimited import READERS, SEPARATORS, files_of, head_of, layout_of, literal, read_files, with_position
from flowloom.sources.versions import current

MAX_FILES = 100_000
# Records repeat one instruction and the feature names: written plain they are over ten times their table. A compressed file is one
# task to its readers, so it holds a bounded number of records.
COMPRESSION = "gzip"
RECORDS_PER_FILE = 250_000

# ---- delimited files -------------------------------------------------------------------------


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first file, by name, that has a line."""
    for file in files_of(spark, path):
        layout = layout_of(head_of(spark, file))
        if layout is not None:
            return layout.sep
    return SEPARATORS[0]


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, position: bool = False, where: bool = False,
) -> DataFrame:
    """Delimited files, each by its own header and, without ``sep``, its own separator; see ``delimited.read_files``."""
    rows = read_files(spark, path, schema, sep, where=position or where)
    return with_position(rows) if position else rows


def read_flow_csv(
    spark: SparkSession, folder: str, schema: T.StructType | None = S.FLOW_SCHEMA, position: bool = False,
) -> DataFrame:
    """All ``part-*.csv`` files of a folder, compressed or not; fails when there are none. ``position`` numbers the rows in file order."""
    path = f"{literal(folder.rstrip('/'))}/part-*.csv{{,.gz}}"
    try:
        return read_delimited(spark, path, schema, position=position)
    except AnalysisException as e:
        raise FileNotFoundError(f"no part-*.csv in {folder}") from e


def read_text_label(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that must have ``text`` and ``label``."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return require_columns(rows, ["text", "label"])


def write_csv(df: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "none") -> None:
    """Files of a bounded number of records, as a reader that knows lines inside values takes a file as one task.

    So nothing is lost to readers where they are compressed (``COMPRESSION``), and texts of flows become nine times smaller.
    """
    df.write.mode("overwrite").options(header=True, escape='"', compression=compression, maxRecordsPerFile=records_per_file).csv(path)


def merge_parts(spark: SparkSession, folder: str, schema: T.StructType, mode: str = "compat") -> DataFrame:
    """All part files of a folder as one table; unreadable files are skipped.

    Compat: columns are taken by position. Strict: by the name in each file's header, which is its first line. Columns
    that the schema doesn't name are left out, those that the file doesn't have are NULL, and lines that repeat the header
    are no rows. A file whose first line names no column of the schema is refused.
    """
    if mode == "compat":
        return spark.read.schema(schema).options(header=True, ignoreCorruptFiles=True, enforceSchema=True).csv(folder)
    lines = spark.read.option("ignoreCorruptFiles", True).text(folder).select(
        F.input_file_name().alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    headers = first_rows_of(lines, "file", "at", ["value"]).select("file", F.col("first.value").alias("header"))
    rows = lines.select("file", "value").join(small_side(headers), "file").filter("value != header")
    out = None
    for (header,) in bounded_rows(headers.select("header").distinct(), what="different headers"):
        names = [c.strip().strip('"') for c in header.split(",")]
        if not set(names) & set(schema.fieldNames()):
            raise ValueError(f"no header in a file that starts with {header!r}")
        fields = ", ".join(f"`{n}` string" for n in names)
        parsed = rows.filter(F.col("header") == header).select(F.from_csv("value", F.lit(fields)).alias("r"))
        table = parsed.select(*[
            (F.col(f"r.{S.q(f.name)}").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ])
        out = table if out is None else out.unionByName(table)
    return spark.createDataFrame([], schema) if out is None else out


# ---- partitioned and JSON tables ---------------------------------------------------------------


def write_by_label(df: DataFrame, path: str, label: str = S.LABEL) -> None:
    """One folder per label. Rows keep their tasks, so a huge class is written by many of them."""
    df.write.mode("overwrite").partitionBy(label).parquet(path)


def read_label_partition(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if label is None else rows.filter(F.col(S.LABEL) == label)


_SEPARATOR = re.compile(r"\}(\s*,\s*)\{")


def _array_separator(head: str) -> str | None:
    """None for a file of lines; for an array, what stands between its first two records ("" if the head holds one only)."""
    if not head.lstrip().startswith("["):
        return None
    found = _SEPARATOR.search(head)
    return found[0] if found else ""


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Instruction records from JSON, each file one array or one record per line; arrays are cut into records, so that a file can be many tasks.

    Files are told apart by their beginning. An array is split at the text that stands between its first two records, and every piece has to
    hold whole records: a file in which one does not (the separator is part of a value) is read as a whole. A file holds one array.
    """
    lines, arrays = [], {}
    files = files_of(spark, path)
    with ThreadPoolExecutor(READERS) as pool:
        for file, head in zip(files, pool.map(lambda f: head_of(spark, f), files), strict=True):
            separator = _array_separator(head)
            if separator is None:
                lines.append(file)
            else:
                arrays.setdefault(separator, []).append(file)
    parts, whole = [], arrays.pop("", [])
    for separator, own in arrays.items():
        pieces, odd = _array_records(spark, own, separator)
        whole += odd
        parts.append(pieces)
    for own, is_array in ((lines, False), (whole, True)):
        if own:
            parts.append(spark.read.schema(S.INSTRUCTION_SCHEMA).option("multiLine", is_array).json([literal(f) for f in own]))
    if not parts:
        return spark.createDataFrame([], S.INSTRUCTION_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def _array_records(spark: SparkSession, files: list[str], separator: str) -> tuple[DataFrame, list[str]]:
    """Records of the array files, and the files that can't be cut at ``separator``."""
    text = spark.read.option("lineSep", separator).text([literal(f) for f in files])
    piece = F.regexp_replace(F.regexp_replace("value", r"^\s*\[\s*\{", ""), r"\}\s*\]\s*$", "")
    # A piece is read as an array of its own: one record, or several where the file does not always separate them alike.
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.from_json(
        F.concat(F.lit("[{"), piece, F.lit("}]")), T.ArrayType(S.INSTRUCTION_SCHEMA)).alias("r"))
    bad = rows.filter(F.col("r").isNull()).select("file").distinct()
    odd = [unquote(r["file"]) for r in bounded_rows(bad, MAX_FILES, "files that can't be split")]
    names = {f.rsplit("/", 1)[-1] for f in odd}
    good = [f for f in files if f.rsplit("/", 1)[-1] not in names]
    odd = [f for f in files if f not in good]
    if odd:
        if not good:
            return spark.createDataFrame([], S.INSTRUCTION_SCHEMA), odd
        return _array_records(spark, good, separator)[0], odd
    return rows.select(F.explode("r").alias("r")).select("r.*"), []


def write_instructions(df: DataFrame, path: str, by: list[str] | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Compressed JSON lines, a folder per value of the ``by`` columns."""
    df.write.mode("overwrite").options(compression=COMPRESSION, maxRecordsPerFile=records_per_file).partitionBy(*by or []).json(path)


def write_instruction_arrays(
    df: DataFrame, path: str, before: str = "[", between: str = ",", behind: str = "]", end: str = "\n", records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Files added to a folder, each one JSON array of at most ``records_per_file`` records; ``end`` follows ``between`` and the array.

    A record is a line of its own to the writer, which begins a file after as many rows; the rows where that happens carry the brackets. So no
    array is ever held as a whole.
    """

    def marked(batches):
        at, kept = 0, None  # the last row waits until it is known whether the array ends with it
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if kept is not None:
                    out.append(kept + (behind if at % records_per_file == 0 else between))
                kept = text if at % records_per_file else before + text
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kept + behind], pa.string())], ["value"])

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(marked, "value string")
    lines.write.mode("append").options(lineSep=end, compression=COMPRESSION, maxRecordsPerFile=records_per_file).text(path)


def write_splits(df: DataFrame, folder: str) -> None:
    """``records/split=train`` (``validation``, ``test``) folders of JSON lines."""
    write_instructions(df, f"{folder}/records", ["split"])


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The records of a folder, or of its current version."""
    rows = spark.read.schema(
        T.StructType([*S.INSTRUCTION_SCHEMA.fields, T.StructField("split", T.StringType())])
    ).json(f"{current(spark, folder)}/records")
    return rows if split is None else rows.filter(F.col("split") == split)


def dataset_metadata(
    df: DataFrame, feature_names: list[str], source: str, engineered: bool, label: str = "output"
) -> DataFrame:
    """One row that describes a split data set. Counted per (split, class) first, so one pass is enough."""
    cells = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("class_distribution")
    )

    def rows_of(split: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("split") == split, F.col("n"))), F.lit(0))

    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), rows_of("train").alias("train_samples"),
        rows_of("validation").alias("validation_samples"), rows_of("test").alias("test_samples"),
    )
    constant = totals.withColumns({
        "n_features": F.lit(len(feature_names)).cast("bigint"),
        "feature_names": F.array(*[F.lit(c) for c in feature_names]) if feature_names else F.array().cast("array<string>"),
        "csv_source": F.lit(source),
        "feature_engineering_applied": F.lit(engineered),
        "_one": F.lit(1),
    })
    return constant.join(F.broadcast(classes.withColumn("_one", F.lit(1))), "_one").select(  # one row each
        "total_samples", "train_samples", "validation_samples", "test_samples", "n_features", "feature_names",
        "class_distribution", "csv_source", "feature_engineering_applied",
    )


METADATA_SCHEMA = T.StructType([
    T.StructField("total_samples", T.LongType()), T.StructField("train_samples", T.LongType()),
    T.StructField("validation_samples", T.LongType()), T.StructField("test_samples", T.LongType()),
    T.StructField("n_features", T.LongType()), T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())),
    T.StructField("csv_source", T.StringType()), T.StructField("feature_engineering_applied", T.BooleanType()),
])


def write_metadata(metadata: DataFrame, folder: str) -> None:
    metadata.write.mode("overwrite").json(f"{folder}/dataset_metadata")


def replace_folder(spark: SparkSession, fresh: str, folder: str) -> None:
    """Puts a finished folder in the place of another one. In between there is no folder, never a mixed one."""
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, folder))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{fresh} can't take the place of {folder}")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{current(spark, folder)}/dataset_metadata")


def completeness(inputs: DataFrame, outputs: DataFrame, key: str = "capture_id") -> DataFrame:
    """``key, converted``: every input part, and whether any output row came from it."""
    done = outputs.select(key).distinct().withColumn("converted", F.lit(True))
    return inputs.select(key).distinct().join(done, key, "left").withColumn(
        "converted", F.coalesce("converted", F.lit(False))
    )
