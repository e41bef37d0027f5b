"""Token counts of whole texts; huge texts by overlapping chunks that are spliced at proven boundaries.

A text of up to ``HUGE_BYTES`` is counted in one go: its units (see ``subwords``) are tokenised once per batch.
A longer text is cut into chunks that overlap; chunks go to all tasks, each is encoded with the byte offsets of its
tokens, and two neighbours are spliced at a place in their overlap where both have a token boundary and which no
piece of the vocabulary can cross. What a chunk counts beyond its splices is dropped, so its first space and its cut
ends do no harm. Neighbours without such a place get a wider overlap in the next round, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import subwords
from flowloom.llm.common import small_batches, text_digest
from flowloom.session import materialise

HUGE_BYTES = 1 << 16
CHUNK_BYTES = 1 << 15
OVERLAP_BYTES = 1 << 9
WIDEN = 16          # how much wider the overlaps of the next round are
SPLICES = 16        # boundaries of an overlap that a chunk names
CACHED_UNITS = 300_000
LIMIT_TOKENS = 4_096


def load(path: str) -> subwords.PieceModel | subwords.ByteModel:
    return subwords.piece_model(path) if path.endswith(".model") else subwords.byte_model(path)


class UnitCounter:
    """Token counts of texts by their units; remembers the counts of ``CACHED_UNITS`` units and a batch more."""

    def __init__(self, path: str):
        self.model = load(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        filled = [i for i, t in enumerate(texts) if t]
        if not isinstance(self.model, subwords.PieceModel) or not self.model.cuts_at_spaces:
            for i in filled:
                out[i] = len(self.model.encode(texts[i]))
        elif filled:
            order, begins, index, units = subwords.split_units([texts[i] for i in filled])
            out[np.array(filled)[order]] = np.add.reduceat(self._units(units)[index], begins[:-1])
        return out

    def _units(self, units: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_UNITS:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        blocks, alone = subwords.blocks_of(new)
        for block in blocks:
            own = [new[i] for i in block.tolist()]
            ends = np.cumsum([len(u.encode()) + 1 for u in own])
            tokens = np.cumsum(self.model.sizes[self.model.encode(" ".join(own))])
            self.known.update(zip(own, np.diff(np.searchsorted(tokens, ends, side="right"), prepend=0).tolist(), strict=True))
        for i in alone.tolist():
            self.known[new[i]] = len(self.model.encode(new[i]))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


def chunks(data: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk, between characters: all but the last end ``overlap`` bytes behind the begin of the next."""
    def whole(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))

    begins = range(0, max(len(data) - overlap, 1), chunk - overlap)
    return [(whole(b), whole(b + chunk)) for b in begins]


def boundaries(model, data: bytes, ends: np.ndarray, low: int, high: int) -> list[dict[str, int]]:
    """Up to ``SPLICES`` stable places strictly inside ``data[low:high]`` and the number of tokens up to there.

    Which places these are follows from the bytes between ``low`` and ``high`` alone, so two chunks that share them name the same.
    """
    text = data[low:high].decode()
    found, at, done = [], low, 0
    for place in model.stable_places(text):
        at += len(text[done:place].encode())
        done = place
        n = int(np.searchsorted(ends, at, side="right"))
        if n and ends[n - 1] == at:  # a token ends here, as it must
            found.append({"at": at, "n": n})
            if len(found) == SPLICES:
                break
    return found


_CHUNK = "key binary, seq int, begin bigint, head int, tail int, data binary"
_PLACES = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _chunk_rows(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """All chunks of all texts of ``key, text``; ``head`` and ``tail`` bytes are shared with the neighbours."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = model.shown(text.as_py()).encode()
                places = chunks(data, chunk, overlap)
                for seq, (begin, end) in enumerate(places):
                    head = places[seq - 1][1] - begin if seq else 0
                    tail = end - places[seq + 1][0] if seq + 1 < len(places) else 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.binary()), pa.array([seq], pa.int32()), pa.array([begin], pa.int64()),
                         pa.array([head], pa.int32()), pa.array([tail], pa.int32()), pa.array([data[begin:end]], pa.binary())],
                        ["key", "seq", "begin", "head", "tail", "data"])

    # Copies of a text have the same chunks: one of each stays, and they are spread over all tasks.
    return texts.mapInArrow(cut, _CHUNK).groupBy("key", "seq").agg(
        *(F.first(c).alias(c) for c in ("begin", "head", "tail", "data")))


def _encoded(rows: DataFrame, path: str) -> DataFrame:
    """``key, seq, total, head, tail``: the tokens of a chunk, and its boundaries in either overlap by their place in the text."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                data, heads, tails = row["data"], [], []
                tokens = model.encode(data.decode())
                if model.plain:
                    ends = np.cumsum(model.sizes[tokens]) - model.lead
                    heads = boundaries(model, data, ends, 0, row["head"])
                    tails = boundaries(model, data, ends, len(data) - row["tail"], len(data))
                for place in (*heads, *tails):
                    place["at"] += row["begin"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]], pa.binary()), pa.array([row["seq"]], pa.int32()), pa.array([row["tail"] == 0]),
                     pa.array([len(tokens)], pa.int64()), pa.array([heads], _PLACES), pa.array([tails], _PLACES)],
                    ["key", "seq", "last", "total", "head", "tail"])

    places = "array<struct<at:bigint,n:bigint>>"
    return rows.mapInArrow(encode, f"key binary, seq int, last boolean, total bigint, head {places}, tail {places}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """``key, n_tokens`` per text; NULL where two neighbours have no boundary in common."""
    left = encoded.select("key", "seq", "last", "total", "tail")
    right = encoded.select("key", (F.col("seq") - 1).alias("seq"), F.col("head"))
    common = F.filter("tail", lambda t: F.exists("head", lambda h: h["at"] == t["at"]))
    pairs = left.join(right, ["key", "seq"], "left").withColumn("cut", F.get(common, F.lit(0)))
    behind = F.get(F.filter("head", lambda h: h["at"] == F.col("cut.at")), F.lit(0))["n"]
    # Tokens up to the cut are the left chunk's, those behind it the right chunk's.
    own = F.when(F.col("last"), F.col("total")).otherwise(F.col("cut.n") - behind)
    return pairs.groupBy("key").agg(
        F.when(F.count(F.when(own.isNull(), 1)) == 0, F.sum(own)).alias("n_tokens"))


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``key, n_tokens`` for the distinct texts of ``key, text``, in rounds of ever wider overlaps.

    The overlap grows ``WIDEN`` times a round and only texts that could not be spliced take part again, so a text has at most
    log(size / overlap) / log(WIDEN) rounds; in the last one it is a single chunk.
    """
    if chunk < 2 * overlap or overlap < 1:
        raise ValueError("a chunk holds at least two overlaps")
    done = None
    while True:
        counted = materialise(_spliced(_encoded(_chunk_rows(texts, path, chunk, overlap), path)), "spliced")
        good = counted.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counted.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT_TOKENS, huge: int = HUGE_BYTES,
    chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    ``path`` is a ``.model`` of sentencepiece or a ``.json`` of tokenizers, by default piece_bpe_32k.model. Nothing is
    added, cut off or padded; special strings inside texts are plain text. NULL and empty texts have 0 bytes and 0 tokens; repeated rows
    and a NULL doc_id get rows of their own; other columns are not read.
    """
    path = path or subwords.default_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("bigint"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnitCounter(path)
        for batch in batches:
            n = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    small = rows.filter(F.col("n_bytes") <= huge).mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    large = rows.filter(F.col("n_bytes") > huge).withColumn("key", text_digest(F.col("text")))
    counts = count_huge(large.select("key", "text"), path, chunk, overlap)
    joined = large.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
