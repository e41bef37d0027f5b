"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are pairs of neighbouring byte classes and a few counts of word
habits, so that words never seen before still say something. Their logarithmic
frequencies, weighted by rarity over the whole corpus, are projected by a
singular value decomposition of a bounded sample of labelled texts. The
labelled vectors are sent to every task; each document's cosines with all of
them are computed in blocks, and its nearest neighbours vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import as_bytes, held_out, small_batches

# The classifier is fitted on at most so many labelled rows per label; scoring covers every row.
SAMPLE_PER_LABEL = 2_000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0       # power of the cosine in a vote
BLOCK = 256           # documents whose cosines are computed at once
CLASSES = 48
PAIRS = CLASSES * CLASSES
HABITS = 16           # terms behind the byte pairs
TERMS = PAIRS + HABITS


def _byte_classes() -> np.ndarray:
    """Letters keep their identity, cases apart only as 'upper'; other bytes fall into a few classes."""
    table = np.full(256, 47, np.uint8)
    table[128:192] = 40 + (np.arange(64) % 4)  # later bytes of a character
    table[192:256] = 44 + (np.arange(64) % 2)  # first bytes of a character
    for i in range(26):
        table[97 + i] = i
    table[65:91] = 26
    table[48:58] = 27
    table[[9, 32]] = 28
    table[[10, 13]] = 29
    for i, c in enumerate(b".,!?#%$*&|"):
        table[c] = 30 + i
    return table


_CLASS = _byte_classes()


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of all terms per text. NULL and empty texts have none."""
    data, at = as_bytes(column)
    classes = _CLASS[data].astype(np.int64)
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = classes[begin:end]
        counts = np.zeros(TERMS, np.float32)
        if len(own) > 1:
            counts[:PAIRS] = np.bincount(own[:-1] * CLASSES + own[1:], minlength=PAIRS)
        if len(own):
            words = data[begin:end].tobytes().split()
            n = max(len(words), 1)
            distinct = len(set(words))
            again = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
            lines = np.count_nonzero(data[begin:end] == 10) + 1
            # Shares in steps: one term per quarter, with the length of the text as its count.
            for slot, share in enumerate((again, 1 - distinct / n, min(1.0, lines / n), min(1.0, len(own) / n / 16))):
                counts[PAIRS + 4 * slot + min(3, int(4 * share))] = len(own)
        yield counts


def weigh(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of unit length: logarithms of relative frequencies, weighted."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    rows = np.log1p(counts / total * 1000) * rarity
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over the whole table, and how many documents there are.

    Every task sends one row of ``TERMS`` counts; they are added up by term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for counts in term_counts(batch.column("text")):
                seen += counts > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([np.append(seen, n).tolist()])], ["counts"])

    parts = docs.select("text").mapInArrow(count, "counts array<bigint>")
    rows = parts.select(F.posexplode("counts").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TERMS + 1, np.int64)  # TERMS + 1 rows
    for r in rows:
        counts[r["term"]] = r["n"]
    return counts[:TERMS], int(counts[TERMS])


@dataclass(frozen=True)
class Model:
    rarity: np.ndarray       # weight per term
    project: np.ndarray      # terms x dimensions
    vectors: np.ndarray      # labelled documents x dimensions, unit length
    labels: np.ndarray       # their labels
    prior: float             # score of a text without any neighbour


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """``text, quality`` of at most ``per_label`` rows per label, none of them held out, chosen by hash of the id."""
    known = labels.filter("quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    parts = [
        known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_label)
        for q in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most twice per_label ids
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS) -> Model:
    """Learn the space and the labelled vectors. Repeated doc_ids may add a few rows to the sample."""
    seen, n = document_frequencies(docs)
    rarity = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c.tobytes() for c in term_counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("quality")], ["terms", "quality"])

    sample = labelled_sample(docs, labels, per_label).mapInArrow(features, "terms binary, quality int").orderBy(
        F.xxhash64("terms"), "quality").limit(2 * per_label).collect()
    if not sample:
        return Model(rarity, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = weigh(np.stack([np.frombuffer(r["terms"], np.float32) for r in sample]), rarity)
    y = np.array([r["quality"] for r in sample], np.float64)
    values, basis = np.linalg.eigh((x.T @ x).astype(np.float64))
    project = basis[:, np.argsort(-values)[:dimensions]].astype(np.float32)
    vectors = x @ project
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(rarity, project, vectors.astype(np.float32), y, float(y.mean()))


def vote(model: Model, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of documents: exact cosines with all labelled vectors, the nearest ones vote."""
    n = len(model.vectors)
    if not n:
        return np.full(len(counts), model.prior)
    rows = weigh(counts, model.rarity) @ model.project
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    cosine = rows @ model.vectors.T
    k = min(neighbours, n)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    score = (weight * model.labels[near]).sum(1) / np.maximum(total, 1e-12)
    return np.where((total > 1e-9) & (counts.sum(1) > 0), np.clip(score, 0, 1), model.prior)


def score_quality(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Empty and NULL texts, like all texts when there is no label to learn from, get the share of label 1 in the sample
    (0.5 without any). Repeated rows get the same score; a NULL doc_id counts as held out.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_PER_LABEL, TERMS and DIMENSIONS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((BLOCK, TERMS), np.float32)
            scores, filled = [], 0
            for row in term_counts(batch.column("text")):
                counts[filled] = row
                filled += 1
                if filled == BLOCK:
                    scores.append(vote(sent.value, counts, neighbours))
                    filled = 0
            if filled:
                scores.append(vote(sent.value, counts[:filled], neighbours))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(scores or [np.zeros(0)]))],
                ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
