"""Folders of delimited files that need not look alike: every file by its own header and separator, in file order.

Only the first lines of each file are looked at on the driver. Files of one header and separator are one Spark reader; the
readers are put together by column name.
"""

from __future__ import annotations

import csv
import io
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

SEPARATORS = [",", ";", "\t", "|", " "]
BAD = "_corrupt_record"
HEAD_BYTES, HEAD_LINES = 1 << 16, 20
READERS = 32            # heads that are read at a time
MAX_LAYOUTS = 1_000     # different (separator, header) in one folder
MAX_SPLITS = 1_000_000  # rows of the table of split offsets: one per 128 MB of input
POSITION = "position"


@dataclass(frozen=True)
class Layout:
    """What a file's first lines say."""

    sep: str
    columns: tuple[str, ...]


# ---- layouts of files ----------------------------------------------------------------------------


def literal(path: str) -> str:
    """A path without wildcards: characters that a pattern would read are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """All files that a path or pattern stands for, sorted by name."""
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def head_of(spark: SparkSession, file: str) -> str:
    """The first lines of a file, as whole lines unless the first alone is longer than ``HEAD_BYTES``."""
    hadoop = spark._jvm.org.apache.hadoop
    path, conf = hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    try:
        stream = codec.createInputStream(stream) if codec is not None else stream
        data = bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    return text[:text.rfind("\n") + 1] or text if len(data) == HEAD_BYTES else text


def layout_of(head: str) -> Layout | None:
    """Separator and column names; None for a file without a line.

    The separator is the one by which most lines have as many fields as the header, separators inside quotes not counted. It
    must give the header more than one field; a comma wins ties, then the separator with more fields. A header of one field is comma-separated.
    """
    if not head.strip():
        return None
    best, best_score = None, None
    for sep in SEPARATORS:
        rows = [r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r][:HEAD_LINES]
        fields = len(rows[0])
        score = (sum(len(r) == fields for r in rows), sep == ",", fields)
        if fields > 1 and (best is None or score > best_score):
            best, best_score = Layout(sep, _distinct(rows[0])), score
    if best is None:
        first = next(r for r in csv.reader(io.StringIO(head, newline="")) if r)
        best = Layout(",", _distinct(first))
    return best


def _distinct(names: list[str]) -> tuple[str, ...]:
    """Column names; a name that comes again gets a number, as table readers do."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return tuple(out)


def layouts(spark: SparkSession, files: list[str]) -> dict[Layout, list[str]]:
    """Files by layout, in the order of their names. Empty files have none."""
    with ThreadPoolExecutor(READERS) as pool:
        found = list(pool.map(lambda f: layout_of(head_of(spark, f)), files))
    out: dict[Layout, list[str]] = {}
    for file, layout in zip(files, found, strict=True):
        if layout is not None:
            out.setdefault(layout, []).append(file)
    if len(out) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers; are these tables?")
    return out


# ---- reading ---------------------------------------------------------------------------------------


def field_count(line: Column, sep: str) -> Column:
    """Number of fields of a line; separators inside double quotes do not count."""
    unquoted = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.regexp_replace(unquoted, re.escape(sep), "")) + 1


def _own_type(name: str) -> T.DataType:
    return T.StringType() if name == S.LABEL else T.DoubleType()


def _read_layout(spark: SparkSession, paths: list[str], layout: Layout, schema: T.StructType, where: bool) -> DataFrame:
    """Files of one layout with the columns of ``schema``: short rows are filled up with NULL, rows with too many fields go.

    The permissive reader hands over every line that does not fit; only those with too many fields are dropped.
    """
    types = {f.name: f.dataType for f in schema.fields}
    own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in layout.columns] + [T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(own).options(
        header=True, sep=layout.sep, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True, escape='"').csv(paths)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")] if where else []
    columns = [
        (F.col(S.q(f.name)) if f.name in layout.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    fits = F.col(BAD).isNull() | (field_count(F.col(BAD), layout.sep) <= len(layout.columns))
    return rows.filter(fits).select(*columns, *place)


def read_files(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, where: bool = False,
) -> DataFrame:
    """Delimited files with a header, each read by its own separator (unless ``sep`` says) and its own column names.

    Columns of ``schema`` that a file does not have are NULL in its rows, columns that ``schema`` does not have are left out. Without a
    schema the columns of all files are taken in the order in which they first appear: ``label`` as text, others as numbers.
    ``where`` adds the file and the begin of the split a row came from, for ``with_position``.
    """
    files = files_of(spark, path)
    if sep is None:
        groups = layouts(spark, files)
    else:
        groups = {}
        with ThreadPoolExecutor(READERS) as pool:
            for file, head in zip(files, pool.map(lambda f: head_of(spark, f), files), strict=True):
                first = next((r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r), None)
                if first:
                    groups.setdefault(Layout(sep, _distinct(first)), []).append(file)
    if schema is None:
        names = dict.fromkeys(c for layout in groups for c in layout.columns)
        schema = T.StructType([T.StructField(c, _own_type(c)) for c in names])
    out = None
    for layout, own in groups.items():
        paths = [path] if len(groups) == 1 else [literal(f) for f in own]
        part = _read_layout(spark, paths, layout, schema, where)
        out = part if out is None else out.unionByName(part)
    if out is None:
        extra = [T.StructField("_file", T.StringType()), T.StructField("_block", T.LongType())] if where else []
        out = spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
    return out


# ---- file order --------------------------------------------------------------------------------------


def with_position(rows: DataFrame) -> DataFrame:
    """``position``, from 0, as one reader would count that takes the files by name, one after another.

    ``rows`` come from ``read_files(..., where=True)``. Inside a split Spark keeps the order of lines, so a row's place is the number
    of rows in all splits before (one row per split) and its distance from the first row of its own: no sort and no shuffle
    of the rows. They are written once, as another reading could cut files in another way.
    """
    numbered = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    splits = numbered.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = bounded_rows(splits, MAX_SPLITS, "splits")
    splits.sort(key=lambda r: (unquote(r["_file"]), r["_block"]))
    offsets, before = [], 0
    for r in splits:
        offsets.append((r["_file"], r["_block"], before - r["_first"]))
        before += r["_n"]
    table = rows.sparkSession.createDataFrame(offsets, "_file string, _block bigint, _offset bigint")
    names = [c for c in rows.columns if c not in ("_file", "_block")]
    return numbered.join(F.broadcast(table), ["_file", "_block"]).select(  # at most MAX_SPLITS rows
        *(F.col(S.q(c)) for c in names), (F.col("_at") + F.col("_offset")).alias(POSITION))


def first_rows(rows: DataFrame, n: int, position: str = POSITION) -> DataFrame:
    """The first ``n`` rows in file order: a filter, as positions have no gaps."""
    return rows.filter(F.col(position) < n)
