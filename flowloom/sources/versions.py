"""Folders whose content changes as a whole: versions beside a small pointer file that is switched last.

``folder/v-<id>/...`` holds a version, ``folder/CURRENT`` its name. A version is written in full before the pointer names it, so a crash at
any point leaves the version that readers follow as it is, and at most an unfinished version that nobody reads. The version before the
current one stays until the next publication, for readers that are still on it.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

POINTER = "CURRENT"
PREVIOUS = "PREVIOUS"
_PREFIX = "v-"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _read_name(spark: SparkSession, folder: str, pointer: str) -> str | None:
    files, path = _files(spark, folder)
    at = path(f"{folder}/{pointer}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readNBytes(1_000)).decode().strip() or None
    finally:
        stream.close()


def _write_name(spark: SparkSession, folder: str, pointer: str, name: str) -> None:
    """Written beside the pointer, which it then replaces in one step."""
    files, path = _files(spark, folder)
    fresh = path(f"{folder}/.{pointer}-{uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    full = files.makeQualified(fresh)
    hadoop.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()).rename(
        full, files.makeQualified(path(f"{folder}/{pointer}")), options)


def new_version(folder: str) -> str:
    """A folder of its own for the next version."""
    return f"{folder.rstrip('/')}/{_PREFIX}{uuid4().hex}"


def switch_to(spark: SparkSession, version: str) -> None:
    """Readers follow ``version`` from now on; versions before the one that was current are removed, the last step of all."""
    folder, name = version.rsplit("/", 1)
    before = _read_name(spark, folder, POINTER)
    if before is not None:
        _write_name(spark, folder, PREVIOUS, before)
    _write_name(spark, folder, POINTER, name)
    remove_others(spark, folder, {name, before})


def remove_others(spark: SparkSession, folder: str, keep: set[str | None]) -> None:
    """Versions that are not to be kept, unfinished ones included."""
    files, path = _files(spark, folder)
    for status in files.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith(_PREFIX) and name not in keep:
            files.delete(status.getPath(), True)


def current(spark: SparkSession, folder: str) -> str:
    """The folder to read: the current version, or ``folder`` itself where nothing has been published by version."""
    name = _read_name(spark, folder.rstrip("/"), POINTER)
    return folder.rstrip("/") if name is None else f"{folder.rstrip('/')}/{name}"
