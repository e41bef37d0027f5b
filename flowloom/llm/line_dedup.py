"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a document are one window, named by two
64-bit hashes. Windows that occur again anywhere in the corpus are found by one
aggregate that keeps the first place; the lines of all later places are merged
per document and removed. Only places of repeated windows are moved again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import small_batches, text_key

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, k, pos, h1, h2``: one row per window that has any visible character."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("k"), lines.alias("lines")).filter(
        F.size("lines") >= size)

    def window(i: Column) -> Column:
        whole = F.array_join(F.slice("lines", i, size), "\n")
        return F.when(whole.rlike(r"[^\x20\x09-\x0D]"), F.struct(
            (i - 1).alias("pos"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(size), whole).alias("h2")))

    places = F.transform(F.sequence(F.lit(1), F.size("lines") - (size - 1)), window)
    return keyed.select("doc_id", "k", F.explode(places).alias("w")).filter("w is not null").select(
        "doc_id", "k", "w.pos", "w.h1", "w.h2")


def later_windows(found: DataFrame) -> DataFrame:
    """``doc_id, k, at``: per document, the places of windows that occur earlier. Rows of one (doc_id, k) count once."""
    place = F.struct("doc_id", "k", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        "first != last").drop("last")
    again = found.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return again.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("at"))  # bounded by the document's lines


def kept_lines(size: int):
    """Arrow function: the text without the lines of the given windows, and how many went."""

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def keep(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, places, strict=True):
            if text is None:
                out.append((None, 0, 0))
                continue
            n = text.count("\n") + 1
            if at is None or not len(at):
                out.append((text, n, 0))
                continue
            gone = np.zeros(n + 1, np.int64)
            starts = np.asarray(at, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + size, -1)
            stays = np.cumsum(gone[:n]) == 0
            lines = text.split("\n")
            out.append(("\n".join([lines[i] for i in np.flatnonzero(stays)]), n, int(n - stays.sum())))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    return keep


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text`` and any other columns): ``row`` (the row as it was), ``text, n_lines, n_removed``.

    A window's first occurrence, by doc_id, then text hash, then place, stays;
    the lines of every later one go, also those that it shares with the first.
    Lines are compared as they are; windows without a visible character do not
    count. Documents of fewer lines, empty and NULL texts stay as they are
    (NULL: 0 lines). Rows with the same doc_id and text count as one document and are cut alike;
    a NULL doc_id comes first. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    later = later_windows(windows(docs, size)).alias("later")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), text_key(F.col("row.text")).alias("k")).alias("rows")
    same = F.col("rows.doc_id").eqNullSafe(F.col("later.doc_id")) & (F.col("rows.k") == F.col("later.k"))
    joined = rows.join(later, same, "left").select("row", "at")
    return joined.withColumn("cut", kept_lines(size)(F.col("row.text"), F.col("at"))).select("row", "cut.*")
