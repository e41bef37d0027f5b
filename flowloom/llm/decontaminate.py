"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders, so that a
benchmark question with other numbers or names keeps its template. Windows of
consecutive template words are joined by hash with those of the benchmark. A
window counts only if its slots agree: within one aligned stretch, a value of
the benchmark always stands for the same value of the document, and the other
way round. Windows of plain words have no slots and must be the same words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import mix, small_batches, text_key
from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

WINDOW = 8
# Share of an item's windows that a document must hold for a leak.
MIN_SHARE = 0.3
# So many template words in a row are a leak whatever their share of the item.
MIN_RUN = 13
# Texts whose templates are made at once; their tables are some fifty times as large.
SLICE_BYTES = 1 << 19
# Windows of the benchmark that are sent to every task to sort out others early; beyond it, all windows are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000

# Units, lower case.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hours minutes seconds days weeks months years "
    "meter meters metre metres kilometer kilometers miles inches feet yards grams kilograms pounds ounces liters litres "
    "gallons dollars euros cents usd eur gbp mph kmh kph hz khz mhz ghz v kv w kw mw j kj cal kcal pa kpa bar c f k".split()
)
_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = frozenset(
    "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen dozen hundred thousand million billion".split()
    + _ONES + _TENS + [f"{t}-{o}" for t in _TENS for o in _ONES])
_INSIDE_NAME = str.maketrans("", "", "'’-.")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%$€£]?")
_UNIT_BEHIND = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°]+)")
_EDGE = "\"'`´“”„‘’«»()[]{}<>.,;:!?¡¿*_|-–—…"
_ENDS = ".!?:"


def _base(word: str) -> int:
    """A fixed 64-bit number for a word."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


NUMBER, NAME, UNIT = (np.uint64(_base(x)) for x in ("<number>", "<name>", "<unit>"))
_STEP = 0x9E3779B97F4A7C15
_PLAIN, _NUMBER_SLOT, _NAME_SLOT, _UNIT_WORD, _QUANTITY, _NOTHING = range(6)


class Words(dict):
    """Raw word to twice the number of its row, plus one where it ends a sentence; forgets all when full.

    A row says what is known of the word without its punctuation, so that words that differ in it alone share one.
    """

    def __init__(self, bound: int = 150_000, names: bool = True):
        super().__init__()
        self.bound, self.names = bound, names
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows: dict[str, int] = {}
        self.words: list[str] = []
        self.kind = array("b")
        self.hash = array("Q")  # of the word
        self.held = array("Q")  # of the value of a slot

    def _learn(self, word: str) -> int:
        low = word.lower()
        held = None
        if word.isalpha():
            name = word[0].isupper() and (word[1:].islower() or word != word.upper())
            kind = _NUMBER_SLOT if low in NUMBER_WORDS else _UNIT_WORD if low in UNITS else _NAME_SLOT if name and self.names else _PLAIN
        elif not word:
            kind = _NOTHING
        elif _NUMBER.fullmatch(word) or low in NUMBER_WORDS:
            kind = _NUMBER_SLOT
        elif m := _UNIT_BEHIND.fullmatch(low):
            kind, held = (_QUANTITY, _base(m[1])) if m[2] in UNITS else (_PLAIN, None)
        elif low in UNITS:
            kind = _UNIT_WORD
        elif self.names and word[0].isupper() and (
                word[1:].islower() or word != word.upper() and word.translate(_INSIDE_NAME).isalpha()):
            kind = _NAME_SLOT
        else:
            kind = _PLAIN
        self.kind.append(kind)
        self.hash.append(_base(low))
        self.held.append(self.hash[-1] if held is None else held)
        self.rows[word] = at = len(self.words)
        self.words.append(word)
        return at

    def value(self, row: int, part: int) -> str:
        """What a slot holds; a quantity has a number (part 0) and a unit (part 1)."""
        low = self.words[row].lower()
        return low if self.kind[row] != _QUANTITY else _UNIT_BEHIND.fullmatch(low)[part + 1]

    def __missing__(self, raw: str) -> int:
        word = raw.strip(_EDGE)
        at = self.rows.get(word)
        self[raw] = code = 2 * (self._learn(word) if at is None else at) + (raw[-1] in _ENDS)
        return code


class Templates:
    """Template words of many texts end to end.

    ``hash`` per template word, ``owner`` the text it belongs to, and where a
    slot's value is found. A capitalised word is a name; where it begins a
    sentence or the text (``opener``), it may be a plain word as well, and
    windows are cut for both readings. A unit is one only behind a number; a
    number with its unit attached is two template words.
    """

    def __init__(self, texts: list[str | None], known: Words):
        if len(known) >= known.bound:
            known.forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = (text or "").split()
            words += own
            counts[i] = len(own)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids, ends = codes >> 1, (codes & 1).astype(bool)
        owner = np.repeat(np.arange(len(texts)), counts)
        kinds = np.array(known.kind)[ids]
        kept = np.flatnonzero(kinds != _NOTHING)
        ended = np.concatenate([[0], np.cumsum(ends)])
        before = np.concatenate([[-1], kept[:-1]]) if len(kept) else kept  # the template word before, of whatever text
        begins = np.zeros(len(kept), bool)
        if len(kept):
            begins = ended[kept] > ended[np.maximum(before, 0)]
            begins[0] = True
            begins[1:] |= owner[kept[1:]] != owner[kept[:-1]]
        ids, owner, kinds = ids[kept], owner[kept], kinds[kept]
        after_number = np.zeros(len(kept), bool)
        after_number[1:] = (kinds[:-1] == _NUMBER_SLOT) & (owner[1:] == owner[:-1])
        twice = kinds == _QUANTITY
        opener = (kinds == _NAME_SLOT) & begins
        slot = (kinds == _NUMBER_SLOT) | twice | ((kinds == _NAME_SLOT) & ~begins) | ((kinds == _UNIT_WORD) & after_number)
        value = np.array(known.hash)[ids]
        value[slot & ((kinds == _NUMBER_SLOT) | twice)] = NUMBER
        value[slot & (kinds == _NAME_SLOT)] = NAME
        value[slot & (kinds == _UNIT_WORD)] = UNIT
        times = 1 + twice.astype(np.int64)
        self.part = np.zeros(int(times.sum()), np.int8)  # 1: the unit of a quantity
        self.part[np.cumsum(times)[twice] - 1] = 1
        self.hash, self.owner = np.repeat(value, times), np.repeat(owner, times)
        self.hash[self.part == 1] = UNIT
        self.slot, self.ids, self.known = np.repeat(slot, times), np.repeat(ids, times), known
        self.opener = np.repeat(opener, times)
        # What a slot holds, for windows of nothing else.
        held = np.array(known.held)[self.ids]
        held[self.part == 1] = np.array([_base(known.value(i, 1)) for i in self.ids[self.part == 1].tolist()], np.uint64)
        self.held = mix(held)

    def windows(self, size: int, shorter: tuple[int, ...] | None = None) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """First words, length, reading and hashes of all windows, one part after the other.

        Besides windows of ``size`` words, windows of each length in ``shorter``; with None, a text of fewer words is one
        window, its whole length. Bit t of a reading: the window's t-th opener is a name. A window of nothing but slots has the hash of
        its values; one that is its whole text has that of its template as well.
        """
        n = len(self.hash)
        if not n:
            return
        mixed = mix(self.hash)
        counts = np.bincount(self.owner)
        starts = np.cumsum(counts) - counts
        openers = np.flatnonzero(self.opener)
        change = mix(np.array([NAME]))[0] - mixed[openers]
        seen = np.concatenate([[0], np.cumsum(self.opener)])
        maybe_slots = np.concatenate([[0], np.cumsum(self.slot | self.opener)])
        lengths = sorted({size, *(range(1, size) if shorter is None else shorter)})
        sums = np.zeros(n, np.uint64)  # of the words read so far
        for m in range(1, size + 1):
            sums = sums[:max(0, n - m + 1)] * np.uint64(_STEP) + mixed[m - 1:]
            if m not in lengths or not len(sums):
                continue
            if m < size and shorter is None:
                begin = starts[counts == m]
            else:
                begin = np.flatnonzero(self.owner[:n - m + 1] == self.owner[m - 1:])
            if not len(begin):
                continue
            h = sums[begin] + np.uint64(m * pow(_STEP, m, 1 << 64) & (1 << 64) - 1)
            full = maybe_slots[begin + m] - maybe_slots[begin] == m  # slots, or openers, which the last reading takes as names
            n_openers = seen[begin + m] - seen[begin]
            yield from self._readings(begin, m, h, 0, full & (n_openers == 0))
            power = np.array([pow(_STEP, m - 1 - j, 1 << 64) for j in range(m)], np.uint64)
            with_openers = np.flatnonzero(n_openers)
            for reading in range(1, 1 << int(n_openers.max())):
                if reading & (reading - 1) == 0:  # one opener more
                    with_openers = with_openers[n_openers[with_openers] >= reading.bit_length()]
                has = with_openers
                at, other = begin[has], h[has]
                for t in range(reading.bit_length()):
                    if reading >> t & 1:
                        which = seen[at] + t
                        other = other + change[which] * power[openers[which] - at]
                yield from self._readings(at, m, other, reading, full[has] & (reading == (1 << n_openers[has]) - 1))

    def _readings(self, at: np.ndarray, m: int, h: np.ndarray, reading: int, slots_only: np.ndarray):
        h = mix(h)
        if slots_only.any():
            plain = ~slots_only | self.is_whole(at, m)
            if plain.any():
                yield at[plain], m, reading, h[plain].view(np.int64)
            at, h = at[slots_only], h[slots_only]
            for j in range(m):
                h = h * np.uint64(_STEP) + self.held[at + j]
            h = mix(h)
        yield at, m, reading, h.view(np.int64)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Place of a template word in its own text."""
        return at - np.searchsorted(self.owner, self.owner[at])

    def is_whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether the window is all of its text."""
        return np.bincount(self.owner)[self.owner[at]] == length

    def slots(self, at: int, length: int, reading: int) -> list[str]:
        """Values in a window, an empty string for a plain word."""
        out = []
        for i in range(at, at + length):
            name = self.slot[i]
            if self.opener[i]:
                name, reading = reading & 1, reading >> 1
            out.append(self.known.value(self.ids[i], self.part[i]) if name else "")
        return out


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def windows(
    df: DataFrame, key: list[str], size: int = WINDOW, wanted: np.ndarray | None = None,
    shorter: tuple[int, ...] | None = None, names: bool = True,
) -> DataFrame:
    """``*key, pos, h, slots, whole`` of the column ``text``; only windows whose hash is in the sorted ``wanted``, if given.

    ``whole``: the window is all of its text. For ``shorter`` see ``Templates.windows``. Without ``names``, names are plain words.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    schema += ", pos bigint, h bigint, slots array<string>, whole boolean"
    spread = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(names=names)
        only = spread.value if spread is not None else None
        if only is not None:  # few hashes pass the first look, by their last bits
            seen = np.zeros(1 << 22, bool)
            seen[only & (len(seen) - 1)] = True
        for batch in slices(batches):
            made = Templates(batch.column("text").to_pylist(), known)
            for at, length, reading, hashes in made.windows(size, shorter):
                if only is not None:
                    hit = np.flatnonzero(seen[hashes & (len(seen) - 1)])
                    if len(hit):
                        hit = hit[only[np.minimum(np.searchsorted(only, hashes[hit]), len(only) - 1)] == hashes[hit]]
                    at, hashes = at[hit], hashes[hit]
                if not len(at):
                    continue
                picked = [batch.column(k).take(pa.array(made.owner[at])) for k in key]
                slots = [made.slots(a, length, reading) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*picked, pa.array(made.place(at)), pa.array(hashes), pa.array(slots, pa.list_(pa.string())),
                     pa.array(made.is_whole(at, length))],
                    [*key, "pos", "h", "slots", "whole"])

    return df.select(*key, "text").mapInArrow(cut, schema)


_PLACES = pa.list_(pa.struct([("pos", pa.int64()), ("solid", pa.bool_())]))


def agreeing(aligned: DataFrame) -> DataFrame:
    """Column ``held`` of alignments becomes ``run, places``: what is left without the windows whose slots disagree.

    ``run`` is the longest run of windows that are ``told``. Work is linear in the slots of an alignment.
    """
    keys = [c for c in aligned.columns if c != "held"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, places = [], []
            for held in batch.column("held").to_pylist():
                stands: tuple[dict, dict] = ({}, {})  # values on either side, with all that they stand for
                for x in held:
                    for pair in x["pairs"]:
                        stands[0].setdefault(pair["b"], set()).add(pair["d"])
                        stands[1].setdefault(pair["d"], set()).add(pair["b"])
                good = [x for x in held if all(
                    len(stands[0][p["b"]]) == 1 and len(stands[1][p["d"]]) == 1 for p in x["pairs"])]
                run = best = 0
                last = -2
                for pos in sorted({x["pos"] for x in good if x["told"]}):
                    run = run + 1 if pos == last + 1 else 1
                    last, best = pos, max(best, run)
                runs.append(best)
                places.append([{"pos": p, "solid": b} for p, b in sorted({(x["pos"], x["solid"]) for x in good})])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(runs, pa.int64()), pa.array(places, _PLACES)],
                [*keys, "run", "places"])

    schema = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in keys)
    return aligned.mapInArrow(check, f"{schema}, run bigint, places array<struct<pos:bigint,solid:boolean>>")


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_share: float = MIN_SHARE,
    broadcast_windows: int = BROADCAST_WINDOWS, min_run: int = MIN_RUN,
) -> DataFrame:
    """``doc_id, k, item_id, share, n_windows``: which documents hold which items; ``k`` is the key of the document's text.

    ``n_windows`` is the number of different windows of an item that the document holds, over all alignments, and
    ``share`` their share; windows of nothing but slots are held only with their very values, and count in the share only where they are.
    Names of an item are read as plain words too, so that copies in lower or upper case are found. Of an alignment whose slots disagree, the windows with a value that stands for several others, or
    for which several stand, are left out and the rest counts. Pairs below ``min_share`` are left out unless one alignment
    holds ``min_run`` template words in a row. Windows of nothing but slots begin no such run and, inside a longer
    document, are no short item, unless their values are the same. Items of fewer words than a window are one
    window of their length; empty and NULL texts match nothing. Repeated documents or items
    count once; a NULL id is an id like any other. Empty tables give no pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", text_key(F.col("text")).alias("item_k"), "text").dropDuplicates(["item_id", "item_k"])
    known = windows(items, ["item_id", "item_k"], size).unionByName(windows(items, ["item_id", "item_k"], size, names=False))
    known = known.dropDuplicates(["item_id", "item_k", "pos", "h"]).withColumn("length", F.size("slots")).drop("whole")
    known = materialise(known.withColumns({
        "solid": F.max(F.array_contains("slots", "")).over(Window.partitionBy("item_id", "item_k", "pos"))}), "leak-items")
    solid = known.groupBy("item_id", "item_k").agg(F.count_distinct(F.when(F.col("solid"), F.col("pos"))).alias("item_solid"))
    known = known.join(solid, ["item_id", "item_k"])  # both are the size of the benchmark
    shorter = tuple(r["length"] for r in bounded_rows(
        known.filter(F.col("length") < size).select("length").distinct(), size, "lengths of short items"))
    wanted = None
    if known.count() <= broadcast_windows:  # else all windows of the documents go into the join
        wanted = np.sort(np.array([r["h"] for r in bounded_rows(
            known.select("h").distinct(), broadcast_windows, "benchmark windows")], np.int64))
    # Repeated documents are cut once: the key goes ahead of the join only as far as its hits.
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("k"), "text")
    hits = windows(keyed, ["doc_id", "k"], size, wanted, shorter).withColumnsRenamed({"pos": "doc_pos", "slots": "doc_slots"})
    pairs = F.arrays_zip(F.col("slots").alias("b"), F.col("doc_slots").alias("d"))
    pairs = F.filter(pairs, lambda x: (x["b"] != "") | (x["d"] != ""))
    told = F.array_contains("slots", "") | (F.col("slots") == F.col("doc_slots"))  # by a plain word or its very values
    joined = hits.join(known, "h").filter(told | F.col("whole") | (F.col("length") == size))
    aligned = joined.groupBy(
        "doc_id", "k", "item_id", "item_k", "item_solid", (F.col("doc_pos") - F.col("pos")).alias("shift"),
    ).agg(F.collect_set(F.struct("pos", told.alias("told"), "solid", pairs.alias("pairs"))).alias("held"))  # bounded by the windows of an item
    aligned = agreeing(aligned.drop("shift"))
    found = aligned.select("doc_id", "k", "item_id", "item_k", "item_solid", "run", F.explode("places").alias("place")).groupBy(
        "doc_id", "k", "item_id", "item_k", "item_solid").agg(
        F.count_distinct("place.pos").alias("n_windows"), F.max("run").alias("run"),
        F.count_distinct(F.when(~F.col("place.solid"), F.col("place.pos"))).alias("n_values"))
    found = found.withColumn("share", F.col("n_windows") / (F.col("item_solid") + F.col("n_values")))
    return found.filter((F.col("share") >= min_share) | (F.col("run") + (size - 1) >= min_run)).groupBy("doc_id", "k", "item_id").agg(
        F.max("share").alias("share"), F.max("n_windows").alias("n_windows"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item."""
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), text_key(F.col("row.text")).alias("k")).alias("r")
    bad = leaks(docs, benchmark, **options).select("doc_id", "k").distinct().alias("bad")
    same = F.col("r.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.col("r.k") == F.col("bad.k"))
    return rows.join(bad, same, "left_anti").select("row.*")
