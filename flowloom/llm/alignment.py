"""How the tokens of two tokenizers share the bytes of a text, and how often two tokens are linked in a corpus.

Equal texts meet by a shuffle on the full text; each distinct text is tokenised and aligned once, its links count as
often as the text occurs, and its measures are joined to all doc_ids that have it.

A task collects distinct texts up to ``PART_BYTES`` as a *part*. Its units (see ``subwords``) are tokenised by both models and
aligned; the part keeps each text as a sequence of units, each unit's links as places in the part's list of id pairs, and how often
each pair is linked. Pairs are counted over all parts, what a part has to know of them comes back as one row, and its texts add it up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import subwords
from flowloom.llm.common import small_batches, text_digest
from flowloom.session import materialise

PART_BYTES = 8 << 20    # texts of one part; a longer text is a part of its own
HOT_SHARE = 1_000       # texts that make up more than one in HOT_SHARE of all rows are joined by broadcast

_SEPARATORS = np.frombuffer(b",|;", np.uint8)


@dataclass(frozen=True)
class Aligned:
    """Alignment of many units, one after another."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray       # number of links per unit
    pairs: np.ndarray       # all links: A id << 32 | B id
    groups: list[bytes]     # 'a1,a2|b1;' per group
    valid: np.ndarray       # both models spell the unit


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, and how many each has."""
    text = [str(i).encode() for i in range(size)]
    width = max(map(len, text))
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(size, width), np.array(list(map(len, text)))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = subwords.byte_model(path_a), subwords.piece_model(path_b)
        if self.a.fast is None or not self.b.cuts_at_spaces:
            raise ValueError("needs a byte-level vocabulary in the order of its merges and a piece model whose pieces end before spaces")
        self.digits, self.width = _digits(max(len(self.a.bytes), len(self.b.bytes)))

    def align(self, units: list[str]) -> Aligned:
        """Units, each without the space that stands before it."""
        blocks, alone = subwords.blocks_of(units)
        parts = [self._block([units[i] for i in block.tolist()]) for block in blocks] + [self._block([units[i]]) for i in alone.tolist()]
        order = np.argsort(np.concatenate([*blocks, alone]), kind="stable")
        links = np.concatenate([p.links for p in parts])
        pairs = np.concatenate([p.pairs for p in parts])
        if (order[:-1] > order[1:]).any():  # links follow their units
            begins = np.cumsum(links) - links
            at = np.repeat(begins[order] - (np.cumsum(links[order]) - links[order]), links[order])
            pairs = pairs[at + np.arange(len(pairs))]
        groups = [g for p in parts for g in p.groups]
        return Aligned(*(np.concatenate([getattr(p, f) for p in parts])[order] for f in ("n_a", "n_b", "n_groups")), links[order], pairs,
                       [groups[i] for i in order.tolist()], np.concatenate([p.valid for p in parts])[order])

    def _block(self, units: list[str]) -> Aligned:
        """Units that may be tokenised end to end, or one unit."""
        text = " ".join(units)
        encode = self.a.encode_block if len(units) > 1 else self.a.encode
        a, b = np.array(encode(" " + text), np.int64), np.array(self.b.encode(text), np.int64)
        spelled = " ".join(units).encode()
        if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != b" " + spelled:
            if len(units) > 1:
                return self._joined([self._block([u]) for u in units])
            zero = np.zeros(1, np.int64)
            return Aligned(zero, zero, zero, zero, np.zeros(0, np.int64), [b""], np.zeros(1, bool))
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        is_a, is_b = np.zeros(len(spelled) + 2, bool), np.zeros(len(spelled) + 2, bool)
        is_a[ends_a] = True
        is_b[ends_b] = True
        upto_a, upto_b, upto = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(is_a & is_b)
        # Between two neighbouring ends, of either model, one A token and one B token overlap: that is one link.
        either = np.flatnonzero(is_a | is_b)
        pairs = a[upto_a[either] - is_a[either]] << 32 | b[upto_b[either] - is_b[either]]
        links = np.searchsorted(either, ends, side="right")
        # In writing, A tokens of a group come before its B tokens.
        in_a, in_b = upto[ends_a] - (is_a & is_b)[ends_a], upto[ends_b] - (is_a & is_b)[ends_b]  # number of the group
        last_a, last_b = np.searchsorted(in_a, np.arange(upto[-1]), side="right"), np.searchsorted(in_b, np.arange(upto[-1]), side="right")
        before_b = np.concatenate([[0], last_b])[in_a]
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + last_a[in_b]
        ids, sep = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        sep[place_a], sep[place_b] = is_b[ends_a] * 1, is_a[ends_b] * 2
        width = self.width[ids]
        chars = np.empty((len(ids), self.digits.shape[1] + 1), np.uint8)
        chars[:, :-1] = self.digits[ids]
        chars[np.arange(len(ids)), width] = _SEPARATORS[sep]
        written = chars[np.arange(chars.shape[1]) <= width[:, None]].tobytes()
        upto_tokens = upto_a[ends] + upto_b[ends]
        cut = np.cumsum(width + 1)[upto_tokens - 1]
        groups = [written[i:j] for i, j in zip(np.concatenate([[0], cut[:-1]]).tolist(), cut.tolist(), strict=True)]
        first = {"prepend": 0}
        return Aligned(np.diff(upto_a[ends], **first), np.diff(upto_b[ends], **first), np.diff(upto[ends], **first),
                       np.diff(links, **first), pairs, groups, np.ones(len(units), bool))

    @staticmethod
    def _joined(parts: list[Aligned]) -> Aligned:
        def whole(f: str) -> np.ndarray:
            return np.concatenate([getattr(p, f) for p in parts])

        return Aligned(whole("n_a"), whole("n_b"), whole("n_groups"), whole("links"), whole("pairs"),
                       [g for p in parts for g in p.groups], whole("valid"))


def _pack(values: np.ndarray) -> bytes:
    """Small numbers, byte by byte of equal weight, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpack(data: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int64)
    planes = pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, size).T).view("<u4").ravel().astype(np.int64)


_TEXT = pa.struct([("key", pa.binary()), ("n", pa.int64()), ("units", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_PART = ("part binary, texts array<struct<key:binary,n:bigint,units:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,"
         "groups_sha256:string>>, sequence binary, n_units bigint, links binary, places binary, pairs array<bigint>, counts array<bigint>")


def align_part(aligner: Aligner, keys: list[bytes], texts: list[str], times: np.ndarray) -> pa.RecordBatch:
    """One row for some distinct texts, none of them empty, each of which occurs ``times``."""
    order, begins, index, units = subwords.split_units(texts)
    keys, times = [keys[i] for i in order.tolist()], times[order]
    found = aligner.align(units)
    valid = np.logical_and.reduceat(found.valid[index], begins[:-1])
    sums = {f: np.add.reduceat(getattr(found, f)[index], begins[:-1]) * valid for f in ("n_a", "n_b", "n_groups", "links")}
    sequence = index.tolist()
    digests = []
    for good, i, j in zip(valid.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        written = b"".join(map(found.groups.__getitem__, sequence[i:j])) if good else b""
        digests.append(hashlib.sha256(written[:-1]).hexdigest() if good else "")
    weight = np.zeros(len(units), np.int64)
    np.add.at(weight, index, np.repeat(times * valid, np.diff(begins)))
    pairs, places = np.unique(found.pairs, return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, places, np.repeat(weight, found.links))
    texts_of = [
        dict(zip(("key", "n", "units", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row, strict=True))
        for row in zip(keys, times.tolist(), np.diff(begins).tolist(), *(sums[f].tolist() for f in ("n_a", "n_b", "n_groups", "links")),
                       digests, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([min(keys)], pa.binary()), pa.array([texts_of], pa.list_(_TEXT)), pa.array([_pack(index)], pa.binary()),
         pa.array([len(units)], pa.int64()), pa.array([_pack(found.links)], pa.binary()), pa.array([_pack(places)], pa.binary()),
         pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
        ["part", "texts", "sequence", "n_units", "links", "places", "pairs", "counts"])


def aligned_parts(distinct: DataFrame, path_a: str, path_b: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of the distinct texts ``key, text, n``. A part is named by its smallest key, which no other part has."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, keys, texts, times, held = Aligner(path_a, path_b), [], [], [], 0
        for batch in batches:
            for key, text, n in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "n")), strict=True):
                if texts and held + len(text) > part_bytes:
                    yield align_part(aligner, keys, texts, np.array(times, np.int64))
                    keys, texts, times, held = [], [], [], 0
                keys.append(key)
                texts.append(text)
                times.append(n)
                held += len(text)
        if texts:
            yield align_part(aligner, keys, texts, np.array(times, np.int64))

    return distinct.mapInArrow(align, _PART)


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links hold a pair, and whether no pair with its B id is in more."""
    counts = materialise(
        parts.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.counts").alias("count")), "pairs")
    id_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(id_b.alias("id_b")).agg(F.max("count").alias("most"))  # one row per id of B's vocabulary
    return counts.join(F.broadcast(most), id_b == F.col("id_b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


_MEASURES = "key binary, n bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def text_measures(parts: DataFrame) -> DataFrame:
    """The measures of each distinct text."""
    asked = parts.select("part", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(parts), "pair").groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))  # bounded by the links of a part
    rows = parts.select("part", "texts", "sequence", "n_units", "links", "places").join(answers, "part", "left").select(
        "texts", "sequence", "n_units", "links", "places", F.col("known.count").alias("counts"),
        F.transform("known.best", lambda b: b.cast("int")).alias("best"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, n_units = row["texts"], row["n_units"]
                sequence = _unpack(row["sequence"], sum(t["units"] for t in texts))
                links = _unpack(row["links"], n_units)
                places = _unpack(row["places"], int(links.sum()))
                ends = np.cumsum(links)
                begins = np.concatenate([[0], np.cumsum([t["units"] for t in texts])[:-1]]).astype(np.int64)
                for name, values in (("n_best", row["best"]), ("count_sum", row["counts"])):
                    upto = np.concatenate([[0], np.cumsum(np.array(values or [], np.int64)[places])])
                    per_unit = upto[ends] - upto[ends - links]
                    for t, v in zip(texts, np.add.reduceat(per_unit[sequence], begins).tolist(), strict=True):
                        t[name] = v if t["n_links"] else 0
                names = [c.split()[0] for c in _MEASURES.split(", ")]
                types = [pa.binary(), *[pa.int64()] * 7, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t[c] for t in texts], kind) for c, kind in zip(names, types, strict=True)], names)

    return rows.mapInArrow(measure, _MEASURES)


def join_copies(rows: DataFrame, measures: DataFrame, key: str = "key", copies: str = "n") -> DataFrame:
    """``rows`` left join ``measures``, which has one row per key and says in ``copies`` how many rows have it.

    Keys with more than one in ``HOT_SHARE`` of all rows, which fewer than ``HOT_SHARE`` keys can have, are joined by broadcast; their rows and
    those with a NULL key then go to no common place in the shuffle that joins the rest.
    """
    names = [c for c in measures.columns if c not in (key, copies)]
    total = measures.agg(F.sum(copies)).first()[0] or 0
    is_hot = F.col(copies) * HOT_SHARE > total
    hot = measures.filter(is_hot).select(F.col(key).alias("hot"), *(F.col(c).alias(f"hot_{c}") for c in names))
    rest = measures.filter(~is_hot).select(F.col(key).alias("cold"), *names)
    spread = F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))  # shorter than any key
    first = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("hot")) & F.col(key).isNotNull(), "left").withColumn(
        "cold_key", F.when(F.col("hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    return first.join(rest, F.col("cold_key") == F.col("cold"), "left").select(
        *rows.columns, *(F.coalesce(f"hot_{c}", c).alias(c) for c in names))


def align_tokens(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A space and the text are encoded by the byte-level vocabulary ``path_a`` and the piece model ``path_b`` (which adds that space), by
    default byte_bpe_50k.json and piece_bpe_32k.model; special strings are plain text. NULL and empty texts, and texts
    that a model does not spell byte for byte (those with U+2581), have no tokens: zeros and ''. Repeated rows and a NULL doc_id get rows of
    their own, and each counts in the corpus; other columns are not read.
    """
    path_a = path_a or subwords.default_path("byte_bpe_50k.json")
    path_b = path_b or subwords.default_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    distinct = docs.select("text").filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(
        text_digest(F.col("text")).alias("key"), "text", "n")
    parts = materialise(aligned_parts(distinct, path_a, path_b, part_bytes), "aligned")
    measures = materialise(text_measures(parts), "measures")
    rows = docs.select("doc_id", text_digest(F.when(F.col("text") != "", F.col("text"))).alias("key"))
    out = join_copies(rows, measures)
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers),
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
