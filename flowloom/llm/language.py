"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two small gated recurrent networks read a stretch of bytes forwards and
backwards; from both states a softmax labels every byte position, and the mean
over all positions of a text is its probability per language. The network is
trained in numpy by backpropagation through time on stretches of a bounded
sample of labelled texts. Every byte of every text is read; long texts are
read in stretches of ``SPAN`` bytes that begin with fresh states.

Gates use the piecewise linear sigmoid, clip(x / 4 + 1/2, 0, 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import as_bytes, held_out, small_batches
from flowloom.operators.bounded import bounded_rows

UNKNOWN = "und"
# Bounds of the fit: languages, documents per language, stretches per document.
MAX_LANGUAGES = 500
DOCS_PER_LANGUAGE = 400
STRETCHES = 4
HIDDEN = 6
SPAN = 128      # bytes of a stretch when scoring
LANES = 6_144   # stretches that are read side by side
TRAIN_SPAN = 48
STEPS = 500
TRAIN_LANES = 256
SEED = 7
NOTHING = 256   # in place of a byte where a stretch has ended

F4 = np.float32


@dataclass
class Net:
    """Weights; ``table[d]`` holds what a byte adds to the three gates of direction d, gates being rows."""

    table: list[np.ndarray]    # (3H, 257): byte NOTHING stands for none
    inner: list[np.ndarray]    # (3H, H)
    bias: list[np.ndarray]     # (H, 1): of the candidate's recurrent part
    out: np.ndarray            # (C, 2H)
    out_bias: np.ndarray       # (C, 1)

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, *self.bias, self.out, self.out_bias]


def new_net(classes: int, hidden: int = HIDDEN, seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(F4)

    return Net(
        [draw(3 * hidden, 257, scale=0.5) for _ in range(2)], [draw(3 * hidden, hidden, scale=0.4) for _ in range(2)],
        [np.zeros((hidden, 1), F4) for _ in range(2)], draw(classes, 2 * hidden, scale=0.5), np.zeros((classes, 1), F4))


def _read(net: Net, d: int, steps: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States (T, H, B) of direction ``d`` over ``steps`` (T, B), in the order of the text.

    Where there is no byte the state is zero, so that a text reads the same however long those beside it are.
    """
    t_all, lanes = steps.shape
    nothing = steps == NOTHING
    padded = nothing.any(axis=1)
    table, inner, bias = net.table[d], net.inner[d], net.bias[d]
    hidden = inner.shape[1]
    states = np.empty((t_all, hidden, lanes), F4)
    h = np.zeros((hidden, lanes), F4)
    given, own, cand = np.empty((3 * hidden, lanes), F4), np.empty((3 * hidden, lanes), F4), np.empty((hidden, lanes), F4)
    for t in range(t_all) if d == 0 else range(t_all - 1, -1, -1):
        if keep is not None:
            given, own, cand = np.empty_like(given), np.empty_like(own), np.empty_like(cand)
        np.take(table, steps[t], axis=1, out=given, mode="clip")
        np.matmul(inner, h, out=own)
        own[2 * hidden:] += bias
        gates = given[:2 * hidden]  # reset, update
        gates += own[:2 * hidden]
        gates *= F4(0.25)
        gates += F4(0.5)
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[:hidden], own[2 * hidden:], out=cand)
        cand += given[2 * hidden:]
        np.tanh(cand, out=cand)
        new = states[t]
        np.subtract(h, cand, out=new)
        new *= gates[hidden:]
        new += cand
        if padded[t]:
            new[:, nothing[t]] = 0
        if keep is not None:
            keep[t] = (h, gates, own[2 * hidden:], cand)
        h = new
    return states


def label_positions(net: Net, steps: np.ndarray, states: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Probabilities (T, C, B) of every position."""
    forward, backward = states or (_read(net, 0, steps), _read(net, 1, steps))
    hidden = forward.shape[1]
    score = np.matmul(net.out[:, :hidden], forward)
    score += np.matmul(net.out[:, hidden:], backward)
    score += net.out_bias
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score


def gradients(net: Net, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions that hold a byte and its gradients, by backpropagation through time."""
    keep: tuple[dict, dict] = ({}, {})
    states = tuple(_read(net, d, steps, keep[d]) for d in range(2))
    p = label_positions(net, steps, states)
    t_all, classes, lanes = p.shape
    hidden = states[0].shape[1]
    inside = steps != NOTHING
    count = max(int(inside.sum()), 1)
    loss = float(-np.log(np.maximum(p[:, labels, np.arange(lanes)], 1e-9))[inside].sum() / count)
    error = p
    error[:, labels, np.arange(lanes)] -= 1
    error *= inside[:, None, :]
    error /= F4(count)
    g_out = np.concatenate([np.einsum("tcb,thb->ch", error, s) for s in states], 1)
    g_out_bias = error.sum(axis=(0, 2))[:, None]
    g_table, g_inner, g_bias = [], [], []
    for d in range(2):
        gt, gi = np.zeros_like(net.table[d]), np.zeros_like(net.inner[d])
        gb = np.zeros_like(net.bias[d])
        back = np.zeros((hidden, lanes), F4)
        from_out = np.matmul(net.out[:, d * hidden:(d + 1) * hidden].T, error)
        for t in range(t_all - 1, -1, -1) if d == 0 else range(t_all):
            before, gates, own, cand = keep[d][t]
            reset, update = gates[:hidden], gates[hidden:]
            g = (back + from_out[t]) * inside[t]
            g_cand = g * (1 - update) * (1 - cand * cand)
            open_ = ((gates > 0) & (gates < 1)) * F4(0.25)
            g_update = g * (before - cand) * open_[hidden:]
            g_reset = g_cand * own * open_[:hidden]
            g_own = g_cand * reset
            into = np.concatenate([g_reset, g_update, g_own])
            gi += into @ before.T
            gb += g_own.sum(1, keepdims=True)
            back = net.inner[d].T @ into + g * update
            given = np.concatenate([g_reset, g_update, g_cand])
            order = np.argsort(steps[t], kind="stable")
            first = np.flatnonzero(np.diff(steps[t][order], prepend=-1))
            gt[:, steps[t][order][first]] += np.add.reduceat(given[:, order], first, axis=1)
        g_table.append(gt)
        g_inner.append(gi)
        g_bias.append(gb)
    return loss, [*g_table, *g_inner, *g_bias, g_out.astype(F4), g_out_bias.astype(F4)]


def train(spans: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = SEED) -> Net:
    """Adam on random stretches, languages drawn evenly."""
    net = new_net(classes, seed=seed)
    rng = np.random.default_rng(seed)
    data = np.full((len(spans), TRAIN_SPAN), NOTHING, np.int64)
    for i, s in enumerate(spans):
        data[i, :len(s)] = np.frombuffer(s[:TRAIN_SPAN], np.uint8)
    y = np.array(labels)
    members = [np.flatnonzero(y == c) for c in range(classes)]
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        drawn = rng.integers(0, classes, TRAIN_LANES)
        picked = np.array([members[c][rng.integers(len(members[c]))] for c in drawn])
        _, grads = gradients(net, np.ascontiguousarray(data[picked].T), y[picked])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(weights, grads, mean, square, strict=True):
            g = g * F4(min(1.0, 1.0 / max(size, 1e-9)))
            m += F4(0.1) * (g - m)
            v += F4(0.01) * (g * g - v)
            w -= F4(rate) * (m / F4(1 - 0.9**step)) / (np.sqrt(v / F4(1 - 0.99**step)) + F4(1e-6))
    return net


# ---- on tables ----------------------------------------------------------------------------------


def _cut(text: bytes, key: int) -> list[bytes]:
    """Up to ``STRETCHES`` stretches from places all over the text that depend on its key only."""
    if len(text) <= TRAIN_SPAN:
        return [text] if text else []
    places = np.random.default_rng(key & 0xFFFFFFFF).integers(0, len(text) - TRAIN_SPAN + 1, STRETCHES)
    return [text[p:p + TRAIN_SPAN] for p in np.unique(places).tolist()]


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, steps: int = STEPS) -> tuple[Net | None, list[str]]:
    """Train on at most ``docs_per_language`` documents of every language, none of them held out, chosen by hash.

    Without labelled documents there is no network.
    """
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.col("text").rlike(r"\p{L}")))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = usable.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("place")).withColumn(
        "n", F.row_number().over(order)).filter(F.col("n") <= docs_per_language)
    bounded_rows(chosen.select("lang").distinct(), MAX_LANGUAGES, "languages")
    limit = docs_per_language * MAX_LANGUAGES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, spans = [], []
            for lang, text, key in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "place")), strict=True):
                own = _cut(text.encode("utf-8", "replace"), key)
                langs += [lang] * len(own)
                spans += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(spans, pa.binary())], ["lang", "span"])

    picked = F.broadcast(chosen.select("doc_id", "lang", "place").limit(limit))  # ids of the sample
    sample = docs.select("doc_id", "lang", "text").filter("text is not null").join(picked, ["doc_id", "lang"])
    rows = sample.select("lang", "text", "place").mapInArrow(cut, "lang string, span binary").orderBy(
        "lang", F.xxhash64("span"), "span").limit(limit * STRETCHES).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None, []
    place = {lang: i for i, lang in enumerate(languages)}
    return train([bytes(r["span"]) for r in rows], [place[r["lang"]] for r in rows], len(languages), steps), languages


def pooled(net: Net, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions per text (n, C); zeros for a text without bytes.

    Stretches of all texts are sorted by length, so that those read side by side are nearly equally long.
    """
    lengths = np.diff(at)
    pieces = (lengths + SPAN - 1) // SPAN
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    # A text's stretches are equally long but for rounding.
    share = np.maximum(pieces[owner], 1)
    begin = at[owner] + number * lengths[owner] // share
    size = at[owner] + (number + 1) * lengths[owner] // share - begin
    order = np.argsort(-size, kind="stable")
    total = np.zeros((len(lengths), net.out.shape[0]))
    for k in range(0, len(order), LANES):
        own = order[k:k + LANES]
        longest = int(size[own[0]])
        where = begin[own] + np.arange(longest)[:, None]
        inside = np.arange(longest)[:, None] < size[own]
        steps = np.where(inside, data[np.minimum(where, len(data) - 1)], np.int16(NOTHING)).astype(np.int64)
        p = label_positions(net, steps)
        p *= inside[:, None, :]
        np.add.at(total, owner[own], p.sum(axis=0).T)
    return total / np.maximum(lengths, 1)[:, None]


def predict(docs: DataFrame, net: Net | None, languages: list[str]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``.

    ``score`` is the mean probability of the predicted language. NULL and empty texts, texts without a letter, and all
    texts when there was nothing to learn from are ``und`` with score 0. Repeated rows get the same answer, the score
    up to the last digits of a float; a NULL doc_id counts as held out.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((net, languages))  # a few thousand numbers per language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = sent.value
        for batch in batches:
            n = batch.num_rows
            letters = np.array(batch.column("letters").to_pylist(), bool)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if own is not None and n:
                p = pooled(own, *as_bytes(batch.column("text")))
                best, score = p.argmax(1), p.max(1)
            known = letters & (own is not None)
            says = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(says, pa.string()),
                 pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("letters"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(label, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
