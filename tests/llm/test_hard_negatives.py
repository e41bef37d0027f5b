import math
import random

import numpy as np
import pytest

from flowloom.llm import hard_negatives
from flowloom.llm.common import table

VECTORS = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df, **parameters):
    return sorted((tuple(r) for r in hard_negatives.mine(df, **parameters).select(*COLUMNS).collect()), key=repr)


def plainly(vectors):
    """The contract of op13, pair by pair; rows are (vec_id, components, label)."""
    taking = []
    for i, x, label in vectors:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        taking.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))

    def order(found):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))

    out = []
    for at, (i, q, label) in enumerate(taking):
        if i is None or i % 100:
            continue
        scored = [(max(-(1 << 56), min(1 << 56, sum(a * b for a, b in zip(q, r)))), j, other) for n, (j, r, other) in enumerate(taking) if n != at]
        for ps, positive, _ in order(f for f in scored if f[2] == label)[:5]:
            fits = [f for f in scored if f[2] != label and 30 * ps <= 100 * f[0] <= 90 * ps]
            out += [(i, positive, rank, j, ps, ns) for rank, (ns, j, _) in enumerate(order(fits)[:10], 1)]
    return sorted(out, key=repr)


def drawn(seed, n, dims=8, labels=4, spread=0.4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_small_table_against_all_pairs(spark, small):
    vectors = table(spark, small, "embeddings")
    want = plainly([tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()])
    assert want and mined(vectors) == want
    assert mined(vectors, block_rows=7, anchor_rows=2) == want


@pytest.mark.parametrize("seed,dims,spread", [(1, 2, 1.0), (2, 8, 0.4), (3, 33, 0.05)])
def test_drawn_vectors_against_all_pairs(spark, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(hard_negatives, "START_ROWS", 64)
    vectors = drawn(seed, 900, dims, spread=spread)
    df = spark.createDataFrame(vectors, VECTORS)
    assert mined(df, block_rows=150, anchor_rows=3) == plainly(vectors)


def test_ties_copies_and_rows_that_take_no_part(spark):
    base = drawn(7, 250, 4, labels=3)
    odd = [
        *base[:30], *base[:30], *[(1000 + i, base[0][1], base[0][2]) for i in range(40)], *[(2000 + i, base[0][1], 9) for i in range(40)],
        (300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [float("nan"), 0.0, 0.0, 0.0], 1), (600, [float("inf"), 0.0, 0.0, 0.0], 1),
        (700, [0.1, 0.2, 0.3, 0.4], None), (800, [], 1), (900, [0.0] * 4, 2), (1100, [0.5, 0.5], 1), (None, [0.4] * 4, 1), (None, None, None),
        (1200, [1e9, -1e9, 1e9, 3.0], 2), (1300, [2e9, -1e9, 1e9, 5.0], 2), (-100, [0.3] * 4, 0), (-7, [0.2] * 4, 9)]
    vectors = base + odd
    df = spark.createDataFrame(vectors, VECTORS)
    want = plainly([(i, x if x is None else [*x, *[0.0] * (4 - len(x))], label) for i, x, label in vectors])
    assert mined(df, block_rows=60, anchor_rows=4) == want
    clash = df.selectExpr("*", "1 as rank", "2 as score", "'x' as p", "3 as block", "4 as q")
    assert mined(clash) == want


def test_few_rows_of_a_label_and_empty_table(spark):
    vectors = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (2, [0.5, 0.2], 2), (100, [0.4, 0.4], 3), (3, [0.8, 0.0], 3)]
    df = spark.createDataFrame(vectors, VECTORS)
    assert mined(df) == plainly(vectors)
    assert mined(df.limit(0)) == []


def test_pruning_loses_nothing_and_spares_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (12, 16))
    q = np.rint(centres[rng.integers(0, 12, 6_000)] + rng.normal(0, 8, (6_000, 16))).astype(np.int64)
    q = q[np.argsort(-np.linalg.norm(q, axis=1), kind="stable")]
    ids, labels = np.arange(len(q)), np.zeros(len(q), np.int64)
    rows = hard_negatives.Rows(ids, np.ones(len(q), bool), labels, q)
    few = hard_negatives.Rows(ids[::60], rows.known[::60], labels[::60], q[::60])
    windows = np.tile(np.array([-hard_negatives.NO_ID, hard_negatives.NO_ID], np.int64), (len(few.ids), 1, 1))
    search = hard_negatives.Search(few, windows, 5, True)
    search.start(few)
    for low in range(0, len(q), 1_000):
        search.read(hard_negatives.Bucket(q[low:low + 1_000], low), rows, {i: {60 * i} for i in range(len(few.ids))})
    found = {}
    for i, r, s in search.results():
        found.setdefault(i, []).append((-s, r))
    for i in range(len(few.ids)):
        scores = q @ few.q[i]
        scores[60 * i] = -10**9
        assert sorted(found[i]) == [(-scores[r], r) for r in np.lexsort((ids, -scores))[:5]]
    assert search.verified < 0.3 * len(q) * len(few.ids)
