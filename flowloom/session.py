"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the operators count on beyond Spark's defaults. Sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_TEST_FOLDERS: dict[str, str] = {}


def local_session(app: str = "flowloom", cores: str = "*", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": os.cpu_count() or 8,
        "spark.driver.memory": "12g",
        **extra,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` where the cluster names one.

    Only a session on one machine without that setting (a test) gets a new
    folder of its own; on a cluster, executors could not reach it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _TEST_FOLDERS:
            _TEST_FOLDERS[application] = tempfile.mkdtemp(prefix="run-")
        folder = _TEST_FOLDERS[application]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a table that several aggregates read: it is computed once, survives the
    loss of executors, and every later pass reads only the columns it needs.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# HotSpot leaves longer methods to its interpreter.
JIT_METHOD_BYTES = 8_000


def materialise_wide(df: DataFrame, purpose: str) -> DataFrame:
    """``materialise`` for a table of many formulas: a stage whose method the JIT compiler would refuse is run operator by operator."""
    conf, name = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    before = conf.get(name)
    conf.set(name, JIT_METHOD_BYTES)
    try:
        return materialise(df, purpose)
    finally:
        conf.set(name, before)


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files go with the query that wrote them: for many queries one after another, none of which is run twice."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)
