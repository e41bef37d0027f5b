"""N-gram Jaccard join by rare-first prefix filtering.

A text's set of word n-grams is ordered by how rare they are in the corpus. Two
sets that are similar enough share one of their first, rarest n-grams, so only
those prefixes are joined. Length, positional and suffix filters drop pairs that
can't reach the similarity, and each pair left is verified once on whole sets.

* Rarity comes from counts of all n-grams of all documents by the first 32 bits
  of their hash, in a table of fixed size. Any order that all documents share
  gives the same links; a better count only leaves fewer pairs to verify.
* Texts with one and the same set are one node (``sid``) from the start.
* Groups of thousands of near copies are never paired off. First every member
  of a prefix group is compared with the pivots of its length class and the two beside it only. What these
  links connect is a component; the second step compares only members of
  different components, all of them, so no link between components is lost.
* A prefix n-gram that is very frequent is split into salts, so
  that a group stays bounded; pairs across salts are dealt out by pairs of salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowloom.llm.common import HashCounts, hash_levels, level_of, shingle_sets, small_batches
from flowloom.llm.components import components
from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

HOT_LEVEL = 20            # groups of about 2 ** HOT_LEVEL rows are split into salts
BROADCAST_SETS = 2_000_000  # ids that are sent to every task to pick sets; more are picked by a join
PAIRS_AT_ONCE = 500_000
MARK_BITS = 512           # of the suffix filter: sets may differ in about half as many n-grams for it to tell them apart

ROW = {"token": "bigint", "salt": "int", "salts": "int", "sid": "bigint", "n": "int", "before": "int", "total": "int"}
PREFIX = {**ROW, "core": "int"}
_PIVOT = {"": "bigint", "_n": "int", "_before": "int", "_total": "int"}
PIVOTS = ("pivot", "above", "below")  # of the own length class, the next and the one before
PIVOTED = {**ROW, "class": "int", **{f"{p}{c}": t for p in PIVOTS for c, t in _PIVOT.items()}}


def _sid(values: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63)


def _mark(values: np.ndarray) -> bytes:
    """For each of ``MARK_BITS`` classes of n-grams, whether the set holds an odd number of them.

    Two marks differ in no more bits than their sets in n-grams.
    """
    return np.packbits(np.bincount((values % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1).tobytes()


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def members_and_levels(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, sid, n, mark`` per row of ``docs`` (sid NULL for empty sets), and how frequent n-grams are, by hash.

    One pass over the texts gives both.
    """
    pa_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "sid", "n", "mark", "part", "packed"]

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *batch.columns],
            names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = HashCounts()
        for batch in batches:
            sids, sizes, marks = [], [], []
            for s in shingle_sets(batch.column("text"), words):
                sids.append(_sid(s) if len(s) else None)
                sizes.append(len(s))
                marks.append(_mark(s))
                full = counts.add(s)
                if full is not None:
                    yield counted(full)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        rest = counts.flush()
        if rest is not None:
            yield counted(rest)

    both = materialise(docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {_id_type(docs)}, sid bigint, n int, mark binary, part int, packed binary"), "jaccard-scan")
    levels = hash_levels(both.filter("part is not null").select("part", "packed"))
    return both.filter("part is null").select("doc_id", "sid", "n", "mark"), levels


def prefixes(docs: DataFrame, words: int, percent: int, levels: np.ndarray, hot_level: int = HOT_LEVEL) -> DataFrame:
    """``token, salt, salts, sid, n, before, total, core``: the rarest n-grams of every set, enough to share one with any similar set.

    ``before`` and ``total`` count the n-grams in front of the token and in the whole set
    that occur more than once in the corpus: no others can be shared. Sets with too few of those are left
    out. ``core`` is by how many the n-grams about as frequent as the token, or more so, outnumber the rarer ones: it is highest
    for the set that adds least to what the token's sets have in common and leaves least of it out.
    ``salt`` is -1 unless the token is split into ``salts`` parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** LEVEL_BITS bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sids, sizes, marks, ahead, totals, cores = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                n = len(s)
                if not n:
                    continue
                own = level_of(sent.value, s)
                total = int(np.count_nonzero(own))
                if total * 100 < percent * n:
                    continue
                ranked = np.argsort(own, kind="stable")
                order = ranked[:n - (percent * n + 99) // 100 + 1]
                tokens.append(s[order].view(np.int64))
                marks.append(own[order])
                sids.append(np.full(len(order), _sid(s)))
                sizes.append(np.full(len(order), n, np.int32))
                ahead.append(np.cumsum(own[order] > 0, dtype=np.int32) - (own[order] > 0))
                totals.append(np.full(len(order), total, np.int32))
                rarer = np.searchsorted(own[ranked], np.maximum(own[order].astype(np.int64) - 1, 1))
                cores.append(n - 2 * rarer)
            if not tokens:
                continue
            token, sid, mark = np.concatenate(tokens), np.concatenate(sids), np.concatenate(marks).astype(np.int64)
            salts = np.left_shift(1, np.maximum(mark - hot_level, 0))
            salt = np.where(salts > 1, sid % salts, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(salt.astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(sid),
                 *[pa.array(np.concatenate(c).astype(np.int32)) for c in (sizes, ahead, totals, cores)]], list(PREFIX))

    return docs.select("text").mapInArrow(cut, ", ".join(f"{c} {t}" for c, t in PREFIX.items()))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that a group never falls apart."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if held is not None:
            own = {k: np.concatenate([held[k], v]) for k, v in own.items()}
        same = np.ones(len(own[keys[0]]), bool)
        for k in keys:
            same &= own[k] == own[k][-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = {k: v[cut:] for k, v in own.items()}
        if cut:
            yield {k: v[:cut] for k, v in own.items()}
    if held is not None:
        yield held


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def shared_prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows whose token some other set has too, each with the pivots of its token in its length class and both neighbours.

    ``class`` is the length class: sets of one class may be similar as far as their lengths tell, and so may those of
    neighbouring classes. The pivot is the set of highest ``core``: among near copies, one close to what they were copied from.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, ["token", "salt"]):
            once = _changes([g["token"], g["salt"], g["sid"]])  # copies have the same set
            g = {k: v[once] for k, v in g.items()}
            new = _changes([g["token"], g["salt"]])
            number = np.cumsum(new) - 1
            several = np.bincount(number)[number] > 1
            keep = several | (g["salt"] >= 0)
            if not keep.any():
                continue
            g, number = {k: v[keep] for k, v in g.items()}, number[keep]
            length = np.floor(np.log(g["n"]) / np.log(100 / percent)).astype(np.int32) if percent < 100 else g["n"]
            by = np.lexsort((g["sid"], -g["core"], length, number))
            g, number, length = {k: v[by] for k, v in g.items()}, number[by], length[by]
            first = _changes([number, length])
            heads = np.flatnonzero(first)
            above = np.arange(len(heads))  # the class above, where the token has one
            below = above.copy()
            next_to = (number[heads[1:]] == number[heads[:-1]]) & (length[heads[1:]] == length[heads[:-1]] + 1)
            above[:-1] += next_to
            below[1:] -= next_to
            part = np.cumsum(first) - 1
            pivots = [pa.array(g[k][heads[of[part]]]) for of in (np.arange(len(heads)), above, below)
                      for k in ("sid", "n", "before", "total")]
            yield pa.RecordBatch.from_arrays([*[pa.array(g[k]) for k in ROW], pa.array(length), *pivots], list(PIVOTED))

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "sid")
    return dealt.mapInArrow(group, ", ".join(f"{c} {t}" for c, t in PIVOTED.items()))


def _need(percent: int, size):
    """The n-grams that two similar sets of ``size`` n-grams in all share at least."""
    return (percent * size + 99 + percent) // (100 + percent)


def _may_link(percent: int, n, before, total, m, ahead, whole, least, greatest):
    """Length filter, and positional filter: what both can still share around a common n-gram. Columns or arrays."""
    most = least(before, ahead) + 1 + least(total - before, whole - ahead) - 1
    return (least(n, m) * 100 >= greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)


def pivot_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members with the pivots of their groups, and the pivots of one token's salts with the first of them."""
    parts = []
    for p in PIVOTS:
        wide = [F.col(c).cast("bigint") for c in ("n", "before", "total", f"{p}_n", f"{p}_before", f"{p}_total")]
        parts.append(shared.filter(f"sid != {p}").filter(_may_link(percent, *wide, F.least, F.greatest)).select(
            F.greatest("sid", p).alias("a"), F.least("sid", p).alias("b")))
    direct = reduce(DataFrame.unionByName, parts)
    salted = shared.filter("salt >= 0 and sid = pivot").select("token", "class", "sid")
    first = salted.groupBy("token", "class").agg(F.min("sid").alias("b"))
    across = salted.join(first, ["token", "class"]).filter("sid != b").select(F.col("sid").alias("a"), "b")
    return direct.unionByName(across).distinct()


def cross_pairs(shared: DataFrame, roots: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of one token whose sets lie in different components and pass the filters.

    The suffix filter compares the marks of both sets (``members``): sets whose marks differ in more bits than similar
    sets may differ in n-grams are no pair.
    """
    named = shared.select("token", "salt", "salts", "sid", "n", "before", "total").join(
        roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = materialise(named, "jaccard-named")
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    marks = members.filter("sid is not null").groupBy("sid").agg(F.first("mark").alias("mark"))
    rows = named.join(mixed.select("token"), "token", "left_semi").join(marks, "sid")
    own = F.greatest("salt", F.lit(0))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own",
                       "root", "sid", "n", "before", "total", "mark")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, ["token", "lo", "hi"]):
            starts = np.append(np.flatnonzero(_changes([g["token"], g["lo"], g["hi"]])), len(g["sid"]))
            runs = np.flatnonzero(_changes([g["token"], g["lo"], g["hi"], g["root"]]))
            ends = np.append(runs[1:], len(g["sid"]))
            group_end = starts[np.searchsorted(starts, runs, side="right")]
            mark = np.frombuffer(b"".join(g["mark"]), np.uint64).reshape(len(g["sid"]), -1)
            # each row with all rows of later components in its group
            left_ends = np.repeat(ends, ends - runs)
            count = np.repeat(group_end, ends - runs) - left_ends
            total = np.cumsum(count)
            begin = 0
            while begin < len(count):
                stop = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right"))
                stop = max(stop, begin + 1)
                part = count[begin:stop]
                left = np.repeat(np.arange(begin, stop), part)
                offset = np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
                right = left_ends[left] + offset
                begin = stop
                wide = [g[c][side].astype(np.int64) for side in (left, right) for c in ("n", "before", "total")]
                ok = _may_link(percent, *wide, np.minimum, np.maximum)
                ok &= (g["lo"][left] == g["hi"][left]) | (g["own"][left] != g["own"][right])
                left, right = left[ok], right[ok]
                size = g["n"][left].astype(np.int64) + g["n"][right]
                apart = np.bitwise_count(mark[left] ^ mark[right]).sum(1, dtype=np.int64)
                ok = apart <= size - 2 * _need(percent, size)
                if ok.any():
                    a, b = g["sid"][left[ok]], g["sid"][right[ok]]
                    found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    dealt = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "root", "sid")
    return dealt.mapInArrow(pair, "a bigint, b bigint").distinct()


def sets_of(docs: DataFrame, members: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``sid, grams`` (sorted 64-bit numbers as bytes) of the sets that occur in ``pairs``."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "jaccard-ids")
    wanted = None
    if ids.count() <= BROADCAST_SETS:
        wanted = np.sort(np.array([r["sid"] for r in bounded_rows(ids, BROADCAST_SETS, "sets")], np.int64))
    else:  # too many to send: only documents that have one of them go on
        having = members.join(ids, "sid", "left_semi").select("doc_id").distinct().alias("m")
        docs = docs.select("doc_id", "text").alias("d").join(
            having, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, done = sent.value, set()
        for batch in batches:
            sids, grams = [], []
            for s in shingle_sets(batch.column("text"), words):
                if not len(s):
                    continue
                sid = _sid(s)
                if sid in done:
                    continue
                if only is not None:
                    at = int(np.searchsorted(only, sid))
                    if at == len(only) or only[at] != sid:
                        continue
                    done.add(sid)  # one copy per task
                sids.append(sid)
                grams.append(s.tobytes())
            if sids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids, pa.int64()), pa.array(grams, pa.large_binary()).cast(pa.binary())], ["sid", "grams"])

    found = docs.select("text").mapInArrow(pick, "sid bigint, grams binary")
    return found.groupBy("sid").agg(F.first("grams").alias("grams"))


def similar(x: np.ndarray, y: np.ndarray, percent: int, steps: int = 8) -> bool:
    """Whether two sorted sets reach the similarity; the suffix filter first compares how many values lie in each range."""
    n, m = len(x), len(y)
    need = _need(percent, n + m)
    if m > 4 * steps:
        bounds = y[m // steps::max(1, m // steps)]
        apart = np.abs(np.diff(np.concatenate([[0], np.searchsorted(x, bounds), [n]])) -
                       np.diff(np.concatenate([[0], np.searchsorted(y, bounds), [m]]))).sum()
        if n + m - 2 * need < apart:
            return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in
                    zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
    return with_a.join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b").select(
        "a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def jaccard_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, hot_level: int = HOT_LEVEL,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id, text``).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A set holds the distinct runs of
    ``words`` words; a text of fewer words has its whole sequence. Rows link when 100 * intersection >= percent * union;
    rows of equal sets are linked. ``component_id`` is the smallest doc_id reachable by links. Texts
    without words, empty or NULL, have size 0 and are linked with nothing. A NULL doc_id never is the smallest unless all
    of its component are NULL. Repeated rows each get their row. n-grams are compared by 64-bit hash.
    """
    small_batches(docs.sparkSession)
    members, levels = members_and_levels(docs, words)
    shared = materialise(shared_prefixes(prefixes(docs, words, percent, levels, hot_level), percent), "jaccard-shared")
    near = materialise(pivot_pairs(shared, percent), "jaccard-pivots")
    links = materialise(verified(near, sets_of(docs, members, near, words), percent), "jaccard-links")
    roots = components(links)
    rest = materialise(cross_pairs(shared, roots, members, percent).join(near, ["a", "b"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        more = materialise(verified(rest, sets_of(docs, members, rest, words), percent), "jaccard-more")
        roots = components(more.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    named = members.join(roots.withColumnRenamed("id", "sid"), "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "sid").alias("root"))
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "root", "left").select(
        "doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"),
        F.coalesce("smallest", "doc_id").alias("component_id"))
