"""What the corpus operators share: table access, row keys, batch limits and hashing of words in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Arrow batches that go to Python: bounded by bytes, so that a batch of long texts stays small.
BATCH_BYTES = 2 << 20
# Texts are hashed in blocks of about this many bytes.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch for this session; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may learn from: crc32 of the id as text, remainder 1 of 3. A NULL id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_digest(text: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


# ---- words of many texts at once ----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # \x09-\x0D and \x20


def _byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit number per byte; A-Z share those of a-z, white space counts nothing."""
    values = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


_LOWER, _EXACT = _byte_values(True), _byte_values(False)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column end to end, and where each begins; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and how many each text has."""
    n, values = len(data), _LOWER if lower else _EXACT
    border = np.zeros(n + 1, bool)
    border[at] = True
    hashes, starts_at, begin = [], [], 0
    while begin < n:
        end = min(n, begin + BLOCK_BYTES)
        while end < n and not (border[end] or _SPACE[data[end]]):  # a block ends between words
            step = data[end:end + BLOCK_BYTES]
            stop = np.flatnonzero(_SPACE[step] | border[end:end + len(step)])
            end += int(stop[0]) if len(stop) else len(step)
        block = data[begin:end]
        word = ~_SPACE[block]
        first = word.copy()
        first[1:] &= ~word[:-1] | border[begin + 1:end]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(len(block)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
            np.maximum(place, 0, out=place)
            terms = values[block] * powers(int(place.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(terms, starts)))
            starts_at.append(starts + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    where = np.concatenate(starts_at)
    return np.concatenate(hashes), np.diff(np.searchsorted(where, at))


def shingle_sets(column: pa.Array, words: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``words`` words.

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    hashes, counts = word_hashes(*as_bytes(column), lower)
    wide = hashes.copy()
    for j in range(1, words):
        m = max(0, len(hashes) - j)
        wide[:m] = wide[:m] * _BASE + hashes[j:]
    wide = mix(wide)
    begin = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(wide[begin:begin + n - words + 1])
        elif n:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[begin:begin + n]:
                    value = value * _BASE + h
            yield mix(np.array([value]))
        else:
            yield np.zeros(0, np.uint64)
        begin += n


# ---- places and counts over a whole table -------------------------------------------------------

RANGES = 16  # tasks that rank a table


def ranked(df: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with ``place``, from 0, in the order of ``by``, NULL first; rows must differ in ``by``.

    Range partitions are ranked on their own and moved by the count of those before.
    """
    dealt = materialise(
        df.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(  # one row per range
        "range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    return dealt.withColumn("within", within).join(F.broadcast(before), "range").select(
        *df.columns, (F.col("before") + F.col("within")).alias("place"))


# Hashes are counted by their first 32 bits and looked up by their first LEVEL_BITS.
LEVEL_BITS = 24
_PARTS = 256          # first 8 bits
_FLUSH = 1 << 22      # hashes that a task sorts at once


class HashCounts:
    """Packs the first 32 bits of many 64-bit hashes into rows ``part, packed``, two bytes per hash.

    A row holds, for one value of the first 8 bits, how many hashes have each value of the next 8, and the last 16
    bits of all of them in that order.
    """

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> pa.RecordBatch | None:
        self.held.append((hashes >> np.uint64(32)).astype(np.uint32))
        self.size += len(hashes)
        return self.flush() if self.size >= _FLUSH else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        keys = np.sort(np.concatenate(self.held))
        self.held, self.size = [], 0
        counts = np.bincount(keys >> np.uint32(16), minlength=1 << 16).astype(np.uint32).reshape(_PARTS, 256)
        ends = np.concatenate([[0], np.cumsum(counts.sum(1, dtype=np.int64))])
        low = keys.astype(np.uint16)
        rows = [(p, counts[p].tobytes() + low[ends[p]:ends[p + 1]].tobytes()) for p in range(_PARTS) if counts[p].any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "packed"])


def hash_levels(packed: DataFrame) -> np.ndarray:
    """Per value of the first ``LEVEL_BITS`` bits, the logarithm of the largest count of a 32-bit value under it.

    Rows of one part are added up in a table of fixed size, whatever their number; the result is one byte per value.
    """
    under = 1 << (LEVEL_BITS - 8)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = np.zeros(1 << 24, np.uint32), -1

        def levels():
            most = table.reshape(under, -1).max(1)
            packed = np.floor(np.log2(np.maximum(most, 1))).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "levels"])

        for batch in batches:
            for p, row in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if p != part:
                    if part >= 0:
                        yield levels()
                        table[:] = 0
                    part = p
                counts = np.frombuffer(row, np.uint32, 256)
                low = np.frombuffer(row, np.uint16, offset=1024).astype(np.uint32)
                np.add.at(table, (np.repeat(np.arange(256, dtype=np.uint32), counts) << np.uint32(16)) | low, np.uint32(1))
        if part >= 0:
            yield levels()

    rows = packed.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, levels binary")
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in bounded_rows(rows, _PARTS, "parts"):
        out[r["part"] * under:(r["part"] + 1) * under] = np.frombuffer(r["levels"], np.uint8)
    return out


def level_of(levels: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return levels[(hashes >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
