"""Exact deduplication by a keyed stream state on disk.

The table is read as a stream. A stateful aggregation without watermark, so
without expiry, keeps one entry per digest in RocksDB: the identifier and the
content locator (file and row) of the row that stays, and how many rows had the
digest. Rows are combined before the shuffle, so a group of any size sends one
row per task. The state is then read back as a table.

A digest that was hit again is only a claim: every such row is compared, byte
by byte, with the text at the locator. Should texts of one digest differ, that
digest is grouped anew by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import ascii_lower
from flowloom.session import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # No preallocated files: they take 4 MB per partition, however small its state is.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Input of one micro-batch; the state carries over between batches.
TRIGGER_BYTES = 64 << 30
# Groups of several rows that are broadcast to find their texts; more are joined by shuffle.
BROADCAST_GROUPS = 50_000
# Rows of a group that one task compares with the kept text.
GROUP_ROWS = 2_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(df: DataFrame) -> DataFrame:
    """``doc_id, norm, loc``; the locator orders rows of one doc_id."""
    path = F.regexp_replace(F.col("_metadata.file_path"), ":/+", ":/")
    return df.select(
        "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"),
        F.struct("doc_id", path.alias("path"), F.col("_metadata.row_index").alias("row")).alias("loc"),
    )


def _stream(spark: SparkSession, path: str, digest: Callable[[Column], Column], trigger_bytes: int) -> DataFrame:
    """Run the stream over the files that are there; the state as ``digest, keep, group_size``."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # A pattern lists one file and a folder alike; a plain path to a file is refused by the stream.
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(
        f"{path[:-1]}[{path[-1]}]")
    grouped = _located(source).select(digest(F.col("norm")).alias("digest"), "loc").groupBy("digest").agg(
        F.max("loc").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    folder = new_folder(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for key, value in STATE_SETTINGS.items():
            spark.conf.set(key, value)
        grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    state = spark.read.format("statestore").load(folder)
    return state.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("group_size"))


def _differing(rows: DataFrame, group_rows: int) -> DataFrame:
    """Digests under which some text differs from the kept one. Large groups are compared in parts."""
    parts = F.ceil(F.col("group_size") / F.lit(group_rows)).cast("int")
    part = F.pmod(F.xxhash64("loc"), parts).cast("int")
    kept = rows.filter("loc = keep").select(
        "digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    others = rows.filter("loc != keep").select("digest", "norm", part.alias("part"))
    return others.join(kept, ["digest", "part"]).filter("norm != kept_norm").select("digest").distinct()


def exact_dedup(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, trigger_bytes: int = TRIGGER_BYTES,
    broadcast_groups: int = BROADCAST_GROUPS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per row of the Parquet table at ``path`` (file or folder) with columns ``doc_id`` and ``text``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as
    empty. Of equal texts the largest ``doc_id`` stays; among rows of one
    doc_id, the last by file and place; a NULL doc_id comes before all others.
    Columns: ``doc_id, keep_id, group_size, kept, text_sha256``. Other columns
    of the table are not read. An empty table gives an empty result.
    """
    state = _stream(spark, path, digest, trigger_bytes)
    rows = _located(spark.read.parquet(path)).withColumn("digest", digest(F.col("norm")))
    groups = state.filter("group_size > 1")
    if groups.limit(broadcast_groups + 1).count() <= broadcast_groups:
        groups = F.broadcast(groups)
    hits = rows.join(groups, "digest")
    differing_at = new_folder(spark, "dedup-differing")
    _differing(hits, group_rows).write.parquet(differing_at)
    differing = spark.read.parquet(differing_at)
    result = rows.select("doc_id", "loc", "digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    if differing.isEmpty():
        result = result.join(state, "digest")
    else:  # the digest lied: the texts themselves are the keys of these groups
        exact = rows.join(differing, "digest", "left_semi").groupBy("digest", "norm").agg(
            F.max("loc").alias("keep"), F.count(F.lit(1)).alias("group_size"),
        ).select("digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep", "group_size")
        result = result.join(state.join(differing, "digest", "left_anti"), "digest").select(
            *result.columns, "keep", "group_size",
        ).unionByName(result.join(exact, ["digest", "text_sha256"]).select(*result.columns, "keep", "group_size"))
    return result.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("loc") == F.col("keep")).alias("kept"),
        "text_sha256",
    )
