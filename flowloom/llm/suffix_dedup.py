"""Removal of repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in
the corpus. The corpus is cut so that equal strings meet in one block, and each
block is solved exactly:

1. Every string of ``LENGTH`` bytes holds an anchor, the K bytes whose hash is
   smallest in it. Equal strings have equal anchors, so only occurrences of one
   anchor can hold equal strings. Around an anchor, the segment of all strings
   that contain it is hashed as well.
2. Occurrences are grouped by anchor. Those with one and the same segment are
   repeats as a whole: all but the first are covered without reading a text again.
   Only anchors with different segments go on, one occurrence per segment.
3. Their segments are gathered by anchor into blocks of bounded size. In a block,
   common prefixes of neighbouring suffixes are derived from the Burrows-Wheeler
   transform by backward extension, breadth first, by increasing value, and
   stop at ``LENGTH``: boundaries without a value by then lie inside groups of equal strings.

Very frequent anchors are split into salts first,
and anchors with very many different segments are compared string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import (
    HashCounts,
    as_bytes,
    hash_levels,
    level_of,
    mix,
    powers,
    ranked,
    small_batches,
    text_key,
)
from flowloom.session import materialise

LENGTH = 100
ANCHOR = 32
HOT_LEVEL = 15              # anchors with about 2 ** HOT_LEVEL occurrences are split into salts
BLOCK_TEXT = 1 << 17        # bytes of segments that are sorted at once, so that the tables fit a cache; more if an anchor needs it
MANY_SEGMENTS = 32_768      # different segments of one anchor beyond which its strings are compared one by one
BROADCAST_DOCS = 2_000_000  # ids of documents that are sent to every task to pick texts; more are picked by a join
PIECE = 1 << 20             # bytes whose anchors are searched at once

_VALUES = np.random.default_rng(9_2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, _INVERSE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the hash base, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(n), _inverse_powers(n)


def _sliding(x: np.ndarray, width: int, fn) -> np.ndarray:
    """``fn`` (minimum or maximum) over x[i:i + width]; shorter by width - 1."""
    reach = 1
    while 2 * reach <= width:
        x = fn(x[:-reach], x[reach:])
        reach *= 2
    return fn(x[:len(x) - (width - reach)], x[width - reach:]) if width > reach else x


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int, tables: _Tables, names_only: bool = False):
    """Place in ``data``, hash, and hash of the segment of every anchor of the texts that begin at ``at``.

    The segment of an anchor reaches ``length - k`` bytes to the left of it and to the right, as far as its text does.
    """
    n = len(data)
    owner_end = np.repeat(at[1:], np.diff(at))
    owner_start = np.repeat(at[:-1], np.diff(at))
    width = length - k + 1
    places, names, around = [], [], []
    for begin in range(0, n, PIECE):
        lo, hi = max(0, begin - 2 * length), min(n, begin + PIECE + 2 * length)
        if hi - lo < length:
            continue
        tables.reach(hi - lo + 1)
        value = _VALUES[data[lo:hi]] * tables.up[:hi - lo]
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value, out=prefix[1:])
        m = hi - lo - k + 1
        h = mix((prefix[k:] - prefix[:-k]) * tables.down[:m])
        h[np.arange(lo, lo + m) + k > owner_end[lo:lo + m]] = np.uint64(2**64 - 1)  # not inside one text
        least = _sliding(h, width, np.minimum)  # of the string that begins here
        starts = np.arange(lo, lo + len(least))
        least[starts + length > owner_end[starts]] = 0
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero((_sliding(padded, width, np.maximum) == h) & (h != np.uint64(2**64 - 1)))
        where = chosen + lo
        inside = (where >= begin) & (where < begin + PIECE)
        chosen, where = chosen[inside], where[inside]
        names.append(h[chosen])
        if names_only:
            continue
        left = np.maximum(owner_start[where], where - (width - 1))
        right = np.minimum(owner_end[where], where + length)
        whole = (prefix[right - lo] - prefix[left - lo]) * tables.down[left - lo]
        shape = (where - left).astype(np.uint64) * np.uint64(length * 4) + (right - left).astype(np.uint64)
        places.append(where)
        around.append(mix(whole ^ mix(shape)))
    if names_only or not places:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.concatenate([none, *names]), none
    return np.concatenate(places), np.concatenate(names), np.concatenate(around)


def numbered(docs: DataFrame) -> DataFrame:
    """``ord, text`` and ``doc_id``: documents in order of doc_id. Rows of one doc_id and text have one number.

    Unique whole numbers are their own order. Otherwise the places of (doc_id, text hash), NULL first, are the numbers.
    """
    rows = docs.select("doc_id", "text")
    whole = rows.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and rows.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return rows.withColumn("ord", F.col("doc_id").cast("bigint"))
    rows = rows.withColumn("k", text_key(F.col("text"))).alias("r")
    places = ranked(docs.select("doc_id", text_key(F.col("text")).alias("k")).distinct(), ["doc_id", "k"]).alias("p")
    same = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.k") == F.col("p.k"))
    return rows.join(places, same).select("r.doc_id", "text", F.col("place").alias("ord"))


def anchor_levels(docs: DataFrame, length: int, k: int) -> np.ndarray:
    """How frequent anchors are, by hash, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tables = HashCounts(), _Tables()
        for batch in batches:
            _, names, _ = anchors(*as_bytes(batch.column("text")), length, k, tables, names_only=True)
            full = counts.add(names)
            if full is not None:
                yield full
        rest = counts.flush()
        if rest is not None:
            yield rest

    return hash_levels(docs.select("text").mapInArrow(count, "part int, packed binary"))


def occurrences(docs: DataFrame, length: int, k: int, levels: np.ndarray, hot_level: int) -> DataFrame:
    """``fp, salt, seg, ord, pos``: all anchors. ``salt`` is -1 unless the anchor is split."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** LEVEL_BITS bytes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            where, names, around = anchors(data, at, length, k, tables)
            if not len(where):
                continue
            row = np.searchsorted(at, where, side="right") - 1
            ord_ = batch.column("ord").to_numpy(zero_copy_only=False)[row]
            level = level_of(sent.value, names).astype(np.int64)
            salts = np.left_shift(1, np.maximum(level - hot_level, 0))
            salt = np.where(salts > 1, (mix(ord_.view(np.uint64)).view(np.int64) & (salts - 1)), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(salt), pa.array(around.view(np.int64)), pa.array(ord_),
                 pa.array((where - at[row]).astype(np.int64))], ["fp", "salt", "seg", "ord", "pos"])

    return docs.select("ord", "text").mapInArrow(find, "fp bigint, salt int, seg bigint, ord bigint, pos bigint")


def first_segments(found: DataFrame) -> DataFrame:
    """``first, fp, salt, seg, ord, pos``: rows that repeat a whole segment, and the first row of every segment.

    First rows are left out where the anchor has one segment only; those of salted anchors stay. The rows
    of an anchor pass by in order; nothing of a group is held but its last row.
    """

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "salt", "seg", "ord", "pos"]
        last: np.ndarray | None = None     # the row before
        waiting: np.ndarray | None = None  # the latest first row
        out_already = False                # whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            before = np.concatenate([(rows[:, :1] - 1) if last is None else last[:, None], rows[:, :-1]], 1)
            last = rows[:, -1]
            group = (rows[0] == before[0]) & (rows[1] == before[1])
            again = group & (rows[2] == before[2])
            firsts = rows[:, ~again]
            if waiting is not None:
                firsts = np.concatenate([waiting[:, None], firsts], 1)
            out = [rows[:, again]]
            n = firsts.shape[1]
            if n:
                several = np.zeros(n, bool)  # the anchor has another segment
                pair = (firsts[0, 1:] == firsts[0, :-1]) & (firsts[1, 1:] == firsts[1, :-1])
                several[1:] |= pair
                several[:-1] |= pair
                keep = several | (firsts[1] >= 0)
                given = keep.copy()
                if out_already:
                    keep[0], given[0] = False, True
                waiting, out_already = firsts[:, -1], bool(given[-1])
                out.append(firsts[:, keep])
            marks = np.repeat([False, True], [out[0].shape[1], out[1].shape[1] if n else 0])
            both = np.concatenate(out, 1)
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks), *[pa.array(c) for c in (both[0], both[1].astype(np.int32), *both[2:])]],
                    ["first", *names])

    dealt = found.repartition("fp", "salt").sortWithinPartitions("fp", "salt", "seg", "ord", "pos")
    return dealt.mapInArrow(
        pass_by, "first boolean, fp bigint, salt int, seg bigint, ord bigint, pos bigint")


# ---- one block ----------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols, and up to how many symbols each was compared when it first differed from the one
    before it (0: never); 0 ends a segment and differs from any other 0.

    Seven symbols of nine bits are compared at once, then twice as many each round; a round sorts only suffixes that are still equal
    to a neighbour, inside their group. A suffix's rank is the place of its group's first member.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j:j + n]
    ends = np.flatnonzero(symbols == 0)
    to_end = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    ended = to_end[order] < 7  # within the symbols compared: a suffix of its own
    new |= ended
    new[1:] |= ended[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    head, reach = head[open_], 7
    differs = np.where(new, 7, 0).astype(np.int16)
    while reach < depth and len(open_):
        own = order[open_]
        key = (head << 32) | rank[own + reach]
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[open_] = own
        reach *= 2
        split = open_[1:][key[1:] != key[:-1]]
        differs[split[~new[split]]] = reach
        new[split] = True
        starts = new[open_]
        head = np.maximum.accumulate(np.where(starts, open_, 0))
        rank[own] = head
        alone = starts & np.append(new, True)[open_ + 1]
        open_, head = open_[~alone], head[~alone]
    return order, differs


def equal_strings(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in order, and for each the number of its group of equal strings of ``length`` symbols.

    The common prefix of a suffix and the one before it is one more than the
    smallest common prefix between the places to which the two go when their
    first symbol is dropped; the transform's last-to-first mapping is that step
    backwards. So, level by level, a boundary gets the value l + 1 as soon as a boundary with at most l lies
    between its two places, and never needs another look.
    """
    n = len(symbols)
    order, differs = suffix_order(symbols, length + 1)
    order = order.astype(np.int32)
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    first = symbols[order].astype(np.int16)
    bound = np.ones(n, bool)  # boundaries whose value is known so far
    bound[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    before = np.empty(n, np.int32)
    low = 1
    for high in sorted(set(np.unique(differs).tolist()) - {0}):
        # Neighbours that first differed in this round of the order have a value from ``low`` up to ``high``, those of no round pass the threshold.
        open_ = np.flatnonzero(~bound & (differs == high)).astype(np.int32)
        here, there = place[order[open_] + 1], place[order[open_ - 1] + 1]
        for _ in range(low, min(high, length)):
            if not len(open_):
                break
            np.cumsum(bound, out=before)
            apart = before[here] != before[there]
            found = np.flatnonzero(apart)
            bound[open_[found]] = True
            if 8 * len(found) > len(open_):  # until then, those that are known stay in the list
                rest = ~apart
                open_, here, there = open_[rest], here[rest], there[rest]
        low = max(low, high)
    return order, np.cumsum(bound) - 1


def covered_in_block(segments: list[bytes], ords: np.ndarray, starts: np.ndarray, length: int):
    """(ord, start) of every string of ``length`` bytes of the segments that equals one with an earlier start."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    order, group = equal_strings(text, length)
    size = np.bincount(group)
    many = size[group] > 1
    order, group = order[many], group[many]
    owner = np.searchsorted(ends, order)
    fits = order + length <= ends[owner]
    order, group, owner = order[fits], group[fits], owner[fits]
    ord_, start = ords[owner], starts[owner] + order - (ends[owner] - sizes[owner])
    by = np.lexsort((start, ord_, group))
    group, ord_, start = group[by], ord_[by], start[by]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.zeros(0, np.int64)
    later = (ord_ != ord_[head]) | (start != start[head])
    return ord_[later], start[later]


def _runs(ord_: np.ndarray, start: np.ndarray, length: int):
    """Merge the strings that begin at (ord, start) into runs (ord, from, to)."""
    by = np.lexsort((start, ord_))
    ord_, start = ord_[by], start[by]
    new = np.ones(len(ord_), bool)
    new[1:] = (ord_[1:] != ord_[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(ord_))[:len(at)] - 1
    return ord_[at], start[at], start[end] + length


def segments_of(docs: DataFrame, firsts: DataFrame, length: int, k: int) -> DataFrame:
    """``fp, ord, start, bytes`` of the segments around the rows of ``firsts``."""
    wanted = firsts.groupBy("ord").agg(F.collect_list(F.struct("fp", "pos")).alias("at"))  # bounded by the text
    rows = _only(docs.select("ord", "text"), firsts.select("ord").distinct()).join(wanted, "ord")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            whole = data.tobytes()
            fps, ords, starts, out = [], [], [], []
            for i, (ord_, found) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("at").to_pylist(),
                                                  strict=True)):
                lo, hi = int(at[i]), int(at[i + 1])
                for x in found:
                    start = max(0, x["pos"] - (length - k))
                    fps.append(x["fp"])
                    ords.append(ord_)
                    starts.append(start)
                    out.append(whole[lo + start:min(hi, lo + x["pos"] + length)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps, pa.int64()), pa.array(ords, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(out, pa.binary())], ["fp", "ord", "start", "bytes"])

    return rows.mapInArrow(cut, "fp bigint, ord bigint, start bigint, bytes binary")


def _only(rows: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose ``ord`` is (not) among ``ids``; the ids are sent to every task only if they are few."""
    if ids.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        ids = F.broadcast(ids)
    return rows.join(ids, "ord", "left_semi" if keep else "left_anti")


def solve_blocks(segments: DataFrame, length: int, block_text: int = BLOCK_TEXT) -> DataFrame:
    """``ord, lo, hi``: covered runs, from blocks of whole anchors."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def answer():
            ord_, start = covered_in_block(
                [r[3] for r in held], np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64),
                length)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _runs(ord_, start, length)], ["ord", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "ord", "start", "bytes")), strict=True):
                if size >= block_text and held[-1][0] != row[0]:
                    yield answer()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield answer()

    return segments.repartition("fp").sortWithinPartitions("fp").mapInArrow(solve, "ord bigint, lo bigint, hi bigint")


def solve_strings(segments: DataFrame, length: int) -> DataFrame:
    """``ord, lo, hi`` from segments of anchors that have very many: their strings are grouped by 128-bit hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, start, b in zip(*(batch.column(c).to_pylist() for c in ("ord", "start", "bytes")), strict=True):
                n = max(0, len(b) - length + 1)
                names = [hashlib.md5(b[i:i + length]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array([ord_] * n, pa.int64()),
                     pa.array(np.arange(start, start + n, dtype=np.int64))], ["name", "ord", "lo"])

    strings = segments.mapInArrow(cut, "name binary, ord bigint, lo bigint")
    place = F.struct("ord", "lo")
    first = strings.groupBy("name").agg(F.min(place).alias("first"))
    return strings.join(first, "name").filter(place > F.col("first")).select(
        "ord", "lo", (F.col("lo") + length).alias("hi"))


def covered_runs(
    docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot_level: int = HOT_LEVEL,
    block_text: int = BLOCK_TEXT, many_segments: int = MANY_SEGMENTS,
) -> DataFrame:
    """``ord, runs`` (array of ``lo, hi``; overlaps possible, ``hi`` may pass the end) of numbered ``docs``."""
    levels = anchor_levels(docs, length, k)
    seen = materialise(first_segments(occurrences(docs, length, k, levels, hot_level)), "suffix-seen")
    whole = seen.filter("not first")
    firsts = seen.filter("first and salt < 0")
    salted = seen.filter("first and salt >= 0")
    if not salted.isEmpty():  # the first rows of all salts meet once more
        again = materialise(first_segments(salted.select("fp", F.lit(-1).alias("salt"), "seg", "ord", "pos")), "suffix-seen")
        whole, firsts = whole.unionByName(again.filter("not first")), firsts.unionByName(again.filter("first"))
    firsts = firsts.select("fp", "ord", "pos")
    large = materialise(firsts.groupBy("fp").count().filter(F.col("count") > many_segments).select("fp"), "suffix-large")
    runs = whole.select(
        "ord", F.greatest(F.col("pos") - (length - k), F.lit(0)).alias("lo"), (F.col("pos") + length).alias("hi"))
    if not large.isEmpty():
        runs = runs.unionByName(solve_strings(
            segments_of(docs, firsts.join(large, "fp", "left_semi"), length, k), length))
        firsts = firsts.join(large, "fp", "left_anti")
    runs = runs.unionByName(solve_blocks(segments_of(docs, firsts, length, k), length, block_text))
    return runs.groupBy("ord").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # bounded by the text


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left) per row of ``docs`` (``doc_id, text``).

    Texts are UTF-8 bytes; NULL counts as empty. Strings are judged on the input and never cross documents;
    "earlier" is by doc_id, then place. A NULL doc_id comes first; texts of one doc_id are ordered by their hash, and rows with the same
    doc_id and text count as one document and are cut alike. Texts shorter than ``length`` lose nothing.
    """
    small_batches(docs.sparkSession)
    rows = numbered(docs)
    found = materialise(covered_runs(rows, length, **options), "suffix-runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                own = data[at[i]:at[i + 1]]
                step = np.zeros(len(own) + 1, np.int64)
                lo = np.array([r["lo"] for r in runs], np.int64)
                hi = np.minimum(np.array([r["hi"] for r in runs], np.int64), len(own))
                np.add.at(step, lo, 1)
                np.add.at(step, hi, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ids = found.select("ord")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    changed = _only(rows, ids).join(found, "ord").select("doc_id", "text", "runs").mapInArrow(
        cut, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    bytes_ = F.coalesce("text", F.lit("")).cast("binary")
    same = _only(rows, ids, keep=False).select(
        "doc_id", F.octet_length(bytes_).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), bytes_.alias("kept"))
    return changed.unionByName(same)
