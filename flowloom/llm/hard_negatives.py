"""Hard negatives by inner product, with coordinate pruning inside length buckets.

All rows are dealt out by length into blocks, and a block's rows into *length buckets*. For each coordinate a bucket holds
its rows sorted by that coordinate of their unit vectors. An anchor that looks for scores of at least t needs a cosine
of at least t / (its length x the bucket's length); with that bound, each of the anchor's largest coordinates (its *focus*)
leaves a range of feasible values, which is a stretch of the sorted list. Rows in the stretches of all focus coordinates
are verified by exact integer products, and what they score raises the anchor's bound for the buckets that follow.

Anchors are a stated query set and meet all rows block by block. Two rounds: the best rows of the anchor's own label
(its positives), then the best rows of other labels in a window below each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import small_batches
from flowloom.operators.bounded import bounded_rows
from flowloom.session import materialise

SCALE = 256
ANCHOR_EVERY = 100
SHIFT_EVERY, LABELS = 7, 10     # rows whose label is moved on by one
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90        # a negative's score in per cent of the positive's
BUCKET_ROWS = 2_048
BLOCK_ROWS = (4_096, 65_536)    # rows of a block: least, most
ANCHOR_ROWS = 8_192             # anchors of a block, at most
FOCUS = 4                       # coordinates that prune
START_ROWS = 2_048              # rows that give every anchor its first bound; the results don't depend on them
MOST_SCORE = 1 << 56            # larger scores, either way, count as this
NO_ID = np.iinfo(np.int64).max  # in place of a NULL vec_id, which comes last among equals
SLACK = 1e-9


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, with integer components; a moved label where the contract moves it."""
    number = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (number + 1) % LABELS).otherwise(number)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Rows of one width; shorter ones are filled up with zeros."""
    wide = max(map(len, rows), default=0)
    if all(len(r) == wide for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), wide)
    return np.array([r + [0] * (wide - len(r)) for r in rows], np.int64)


def _packed(ids: list, labels: list, q: np.ndarray) -> dict:
    kind = np.int32 if q.size == 0 or np.abs(q.astype(np.float64)).max() < 2**31 - 1 else np.int64
    return {"ids": np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(),
            "known": np.array([i is not None for i in ids], bool).tobytes(),
            "labels": np.array(labels, np.int64).tobytes(), "n": len(ids), "q": q.astype(kind).tobytes(),
            "bytes": np.dtype(kind).itemsize}


@dataclass
class Rows:
    """Rows of a block as arrays."""

    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    q: np.ndarray

    @classmethod
    def unpacked(cls, row: dict) -> Rows:
        q = np.frombuffer(row["q"], f"<i{row['bytes']}").astype(np.int64)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["labels"], np.int64),
                   q.reshape(row["n"], len(q) // row["n"] if row["n"] else 0))

    def widened(self, dims: int) -> Rows:
        return Rows(self.ids, self.known, self.labels, np.pad(self.q, ((0, 0), (0, dims - self.q.shape[1]))))


_PACKED = "ids binary, known binary, labels binary, n int, q binary, bytes int"
_PACKED_TYPES = {"ids": pa.binary(), "known": pa.binary(), "labels": pa.binary(), "n": pa.int32(), "q": pa.binary(), "bytes": pa.int32()}


def _batch(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


def length_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``p, block`` and packed rows: ranges of length, longest first; equal lengths are split by hash."""
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("length", length).withColumn("h", F.xxhash64("vec_id", "label", "q"))
    n = max(1, -(-rows.count() // block_rows))
    order = [F.desc("length"), F.asc("h"), F.asc("vec_id")]
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "label", "q")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        types = {"p": pa.int32(), "block": pa.int32()} | _PACKED_TYPES
        ids, labels, vectors = [], [], []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal block
            row = {"p": part, "block": block} | _packed(ids[:n], labels[:n], _matrix(vectors[:n]))
            del ids[:n], labels[:n], vectors[:n]
            block += 1
            return _batch([row], types)

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            labels += batch.column("label").to_pylist()
            vectors += batch.column("q").to_pylist()
            while len(ids) >= 2 * block_rows:
                yield cut(block_rows)
        while ids:
            yield cut(block_rows)

    return dealt.mapInArrow(pack, f"p int, block int, {_PACKED}")


_ANCHOR = "p int, block int, row int, anchor_id bigint, label bigint, q array<bigint>"


def anchors_of(blocks: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """The rows whose id is divisible by ``every``, with their place in the blocks."""
    types = {"p": pa.int32(), "block": pa.int32(), "row": pa.int32(), "anchor_id": pa.int64(), "label": pa.int64(), "q": pa.list_(pa.int64())}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Rows.unpacked(row)
                yield _batch([
                    {"p": row["p"], "block": row["block"], "row": i, "anchor_id": int(own.ids[i]), "label": int(own.labels[i]), "q": own.q[i].tolist()}
                    for i in np.flatnonzero(own.known & (own.ids % every == 0)).tolist()], types)

    return blocks.mapInArrow(pick, _ANCHOR)


_KEY = ("a_p", "a_block", "a_row")
_ANCHOR_BLOCK_TYPES = {"a": pa.int32(), "places": pa.binary(), "windows": pa.binary()} | {f"a_{c}": t for c, t in _PACKED_TYPES.items()}


def anchor_blocks(anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Anchors packed by ``a``; ``windows`` holds low and high of up to ``POSITIVES`` score windows per anchor, none is low over high."""
    def packed(rows: list[dict]) -> pa.RecordBatch:
        windows = np.tile(np.array([1, 0], np.int64), (len(rows), POSITIVES, 1))
        for w, r in zip(windows, rows, strict=True):
            for i, score in enumerate(r["scores"] or []):
                w[i] = -(-LOWEST * score // 100), HIGHEST * score // 100
        places = np.array([[r["p"], r["block"], r["row"]] for r in rows], np.int32)
        own = _packed([r["anchor_id"] for r in rows], [r["label"] for r in rows], _matrix([r["q"] for r in rows]))
        return _batch([{"a": rows[0]["a"], "places": places.tobytes(), "windows": windows.tobytes()} | {f"a_{c}": v for c, v in own.items()}],
                      _ANCHOR_BLOCK_TYPES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["a"] != row["a"]:
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    number = F.pmod(F.xxhash64("p", "block", "row"), F.lit(n_blocks)).cast("int")
    schema = "a int, places binary, windows binary, " + ", ".join(f"a_{c}" for c in _PACKED.split(", "))
    return anchors.withColumn("a", number).repartition("a").sortWithinPartitions("a").mapInArrow(pack, schema)


class Bucket:
    """Rows of similar length with their coordinate lists."""

    def __init__(self, q: np.ndarray, first: int):
        self.first, self.q = first, q.astype(np.float64)
        lengths = np.linalg.norm(self.q, axis=1)
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        unit = self.q / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)       # per coordinate, rows by value
        self.values = np.ascontiguousarray(np.take_along_axis(unit, self.order.T, 0).T)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(q), dtype=np.int32)[None, :], 1)

    def feasible(self, unit: np.ndarray, lengths: np.ndarray, focus: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per anchor: whether any row can reach its bound, and begin and end of the stretch of each focus coordinate."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = bounds / (lengths * np.where(bounds > 0, self.longest, self.shortest))
        least = np.where(np.isnan(least) | (bounds <= 0) & (lengths == 0), -1.0, least)
        possible = least <= 1 + SLACK
        least = np.clip(least, -1, 1)[:, None]
        own = np.take_along_axis(unit, focus, 1)
        spread = np.sqrt(np.maximum((1 - own * own) * (1 - least * least), 0))
        high = np.where(own >= least, 1.0, own * least + spread) + SLACK
        low = np.where(own <= -least, -1.0, own * least - spread) - SLACK
        begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus).tolist():
            at = focus == f
            begin[at] = np.searchsorted(self.values[f], low[at], side="left")
            end[at] = np.searchsorted(self.values[f], high[at], side="right")
        return possible & (end > begin).all(1), begin, end

    def candidates(self, focus: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows in the stretches of all focus coordinates, the shortest stretch first."""
        by = np.argsort(end - begin, kind="stable")
        rows = self.order[focus[by[0]], begin[by[0]]:end[by[0]]]
        for i in by[1:].tolist():
            if end[i] - begin[i] < len(self.q):
                rank = self.rank[focus[i], rows]
                rows = rows[(rank >= begin[i]) & (rank < end[i])]
        return rows


def exact(rows: np.ndarray, anchor: np.ndarray, safe: bool) -> np.ndarray:
    """Integer products. Sums below 2^53 are exact in floating point; others are taken as Python numbers and limited."""
    if safe:
        return (rows @ anchor).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape) @ np.array([int(x) for x in anchor], object)
    return np.array([max(-MOST_SCORE, min(MOST_SCORE, int(s))) for s in np.atleast_1d(whole)], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: higher score, then smaller id, then the earlier row."""
    return np.lexsort((rows, ids, -scores))[:k]


class Search:
    """The first ``k`` rows in each score window of each anchor, over the buckets of a block."""

    def __init__(self, anchors: Rows, windows: np.ndarray, k: int, same_label: bool):
        self.anchors, self.windows, self.k, self.same = anchors, windows, k, same_label
        q = anchors.q.astype(np.float64)
        self.q, self.lengths = q, np.linalg.norm(q, axis=1)
        self.unit = q / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.bound = windows[:, :, 0].copy()    # only scores from here on can still count
        self.open = windows[:, :, 0] <= windows[:, :, 1]
        self.held: list[list[tuple]] = [[None] * windows.shape[1] for _ in range(len(q))]
        self.verified = 0

    def _fits(self, labels: np.ndarray, anchor: int) -> np.ndarray:
        return (labels == self.anchors.labels[anchor]) == self.same

    def start(self, rows: Rows) -> None:
        """First bounds: the ``k``-th score in a window over a few rows of the table, without those that may be the anchor."""
        largest = np.abs(rows.q.astype(np.float64)).max(initial=0) * np.abs(self.q).max(initial=0) * max(1, self.q.shape[1])
        if not len(rows.ids) or largest >= 2**53:
            return
        table = self.q @ rows.q.T.astype(np.float64)
        for i in range(len(self.q)):
            scores = table[i][self._fits(rows.labels, i) & (rows.ids != self.anchors.ids[i])].astype(np.int64)
            for w, (low, high) in enumerate(self.windows[i].tolist()):
                inside = scores[(scores >= low) & (scores <= high)]
                if len(inside) >= self.k:
                    self.bound[i, w] = max(low, int(np.partition(inside, -self.k)[-self.k]))

    def read(self, bucket: Bucket, rows: Rows, own: dict[int, set[int]]) -> None:
        """``own`` says which rows of the block are which anchor."""
        safe = np.abs(bucket.q).max(initial=0) * np.abs(self.q).max(initial=0) * max(1, self.q.shape[1]) < 2**53
        least = np.where(self.open, self.bound, NO_ID).min(1)
        possible, begin, end = bucket.feasible(self.unit, self.lengths, self.focus, least.astype(np.float64))
        for i in np.flatnonzero(possible & self.open.any(1)).tolist():
            at = bucket.candidates(self.focus[i], begin[i], end[i]) if self.focus.shape[1] else np.arange(len(bucket.q))
            at = at[self._fits(rows.labels[bucket.first + at], i)]
            self.verified += len(at)
            scores = exact(bucket.q[at], self.q[i], safe)
            at = at + bucket.first
            for w in np.flatnonzero(self.open[i]).tolist():
                keep = (scores >= self.bound[i, w]) & (scores <= self.windows[i, w, 1])
                if not keep.any():
                    continue
                new, found = at[keep], scores[keep]
                if i in own:
                    other = ~np.isin(new, list(own[i]))
                    new, found = new[other], found[other]
                if self.held[i][w] is not None:
                    new, found = np.concatenate([self.held[i][w][0], new]), np.concatenate([self.held[i][w][1], found])
                first = _best(found, rows.ids[new], new, self.k)
                self.held[i][w] = new[first], found[first]
                if len(first) == self.k:
                    self.bound[i, w] = max(self.bound[i, w], found[first[-1]])

    def results(self) -> Iterator[tuple[int, int, int]]:
        """Anchor, row and score; a row that several windows hold comes once."""
        for i, windows in enumerate(self.held):
            yield from sorted({(i, r, s) for held in windows if held is not None for r, s in zip(held[0].tolist(), held[1].tolist(), strict=True)})


_FOUND_TYPES = {"a_p": pa.int32(), "a_block": pa.int32(), "a_row": pa.int32(), "found_id": pa.int64(), "f_p": pa.int32(),
                "f_block": pa.int32(), "f_row": pa.int32(), "score": pa.int64()}


def searched(blocks: DataFrame, anchors: DataFrame, n_parts: int, n_blocks: int, start: Rows, k: int, same_label: bool) -> DataFrame:
    """Candidates of all anchors: from each block at most the first ``k`` of each window."""
    sent = blocks.sparkSession.sparkContext.broadcast(start)  # START_ROWS rows
    pairs = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(
        anchors.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))), ["a", "p"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows.unpacked(row)
                asking = Rows.unpacked({c: row[f"a_{c}"] for c in _PACKED_TYPES})
                first = sent.value
                dims = max(rows.q.shape[1], asking.q.shape[1], first.q.shape[1])
                rows, asking, first = (r.widened(dims) for r in (rows, asking, first))
                windows = np.frombuffer(row["windows"], np.int64).reshape(len(asking.ids), POSITIVES, 2)
                if same_label:  # one window without limits
                    windows = np.tile(np.array([-NO_ID, NO_ID], np.int64), (len(asking.ids), 1, 1))
                places = np.frombuffer(row["places"], np.int32).reshape(-1, 3)
                own: dict[int, set[int]] = {}
                for i in np.flatnonzero((places[:, 0] == row["p"]) & (places[:, 1] == row["block"])).tolist():
                    own.setdefault(i, set()).add(int(places[i, 2]))
                search = Search(asking, windows, k, same_label)
                search.start(first)
                for low in range(0, len(rows.ids), BUCKET_ROWS):
                    search.read(Bucket(rows.q[low:low + BUCKET_ROWS], low), rows, own)
                yield _batch([
                    {"a_p": int(places[i, 0]), "a_block": int(places[i, 1]), "a_row": int(places[i, 2]),
                     "found_id": int(rows.ids[r]) if rows.known[r] else None, "f_p": row["p"], "f_block": row["block"], "f_row": r, "score": s}
                    for i, r, s in search.results()], _FOUND_TYPES)

    return pairs.mapInArrow(search, ", ".join(f"{c} {'bigint' if t == pa.int64() else 'int'}" for c, t in _FOUND_TYPES.items()))


def _first(df: DataFrame, by: list[str | Column], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "f_p", "f_block", "f_row")
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(
    vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    block_rows: int | None = None, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the table ``vec_id, embedding, label``.

    Rows with a NULL label, a NULL vector or a component that is NULL or not finite take no part; a NULL vec_id does, is no
    anchor and comes last among equals. Vectors of fewer components count as filled up with zeros (an empty one scores 0 with all). Repeated
    rows are rows of their own: a copy of an anchor is its positive, and repeated anchors repeat their results. Other columns are not
    read; no rows give no rows. Scores beyond 2^56, either way, count as 2^56.
    """
    spark = vectors.sparkSession
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    small_batches(spark)
    rows = prepared(vectors)
    if block_rows is None:
        least, most = BLOCK_ROWS
        block_rows = min(most, max(least, rows.count() // spark.sparkContext.defaultParallelism))
    blocks = materialise(length_blocks(rows, block_rows), "length-blocks")
    anchors = materialise(anchors_of(blocks, every), "anchors")
    n_parts = (blocks.agg(F.max("p")).first()[0] or 0) + 1
    n_blocks = max(1, -(-anchors.count() // anchor_rows))
    chosen = bounded_rows(rows.orderBy(F.xxhash64("q", "label"), "vec_id").limit(START_ROWS), START_ROWS, "start rows")
    start = Rows.unpacked(_packed([r["vec_id"] for r in chosen], [r["label"] for r in chosen], _matrix([list(r["q"]) for r in chosen])))

    empty = F.array().cast("array<bigint>")
    near = searched(blocks, anchor_blocks(anchors.withColumn("scores", empty), n_blocks), n_parts, n_blocks, start, positives, True)
    near = materialise(_first(near, list(_KEY), positives, "k").select(
        *_KEY, "k", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy(*_KEY).agg(F.collect_list("positive_score").alias("scores"))  # at most POSITIVES
    keyed = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ("p", "block", "row")), "anchor_id", "label", "q")
    asking = keyed.join(scores, list(_KEY)).select(*(F.col(f"a_{c}").alias(c) for c in ("p", "block", "row")), "anchor_id", "label", "q", "scores")
    below = searched(blocks, anchor_blocks(asking, n_blocks), n_parts, n_blocks, start, negatives, False)
    fits = (LOWEST * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= HIGHEST * F.col("positive_score"))
    pairs = near.join(below, list(_KEY)).filter(fits)
    return _first(pairs, [*_KEY, "k"], negatives, "rank").join(keyed.select(*_KEY, "anchor_id"), list(_KEY)).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
