"""Quality votes and language network: held-out accuracy, brute force, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import language, quality

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_of_held_out_documents(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(sf_docs, quality.fit(sf_docs, labels)).collect()
    assert len(scored) == sf_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [(r.score, truth[r.doc_id]) for r in scored if r.held_out and r.doc_id in truth]
    good, bad = [s for s, t in unseen if t == 1], [s for s, t in unseen if t == 0]
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])  # the share of pairs in the right order
    assert above > 0.9, above


def test_votes_are_those_of_the_nearest(spark, sf_docs):
    model = quality.fit(sf_docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = [r.text for r in sf_docs.orderBy("doc_id").limit(40).collect()]
    counts = np.stack([c.copy() for c in quality.term_counts(pa.array(texts, pa.string()))])
    got = quality.vote(model, counts)
    for score, row in zip(got, counts, strict=True):
        own = quality.weigh(row[None, :], model.rarity)[0] @ model.project
        own = own / max(np.linalg.norm(own), 1e-9)
        near = sorted(((float(v @ own), y) for v, y in zip(model.vectors, model.labels, strict=True)), key=lambda p: -p[0])
        weights = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in near[:quality.NEIGHBOURS]]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total > 1e-9 and row.sum() else model.prior
        assert score == pytest.approx(want, abs=2e-3)


def test_quality_of_odd_rows(spark, make_docs):
    rows = [(i, f"good plain prose number {i} about a river") for i in range(12)]
    rows += [(100 + i, f"### {i} $$$ {i} !!! ###") for i in range(12)]
    odd = [(500, None), (501, ""), (None, "good plain prose"), (502, "long word " * 60_000), (0, rows[0][1]), (503, "퟿\x00")]
    docs = make_docs(rows + odd).selectExpr("*", "1 as score", "2 as held_out", "3 as quality", "4 as n")
    labels = spark.createDataFrame([(i, int(i < 100), None) for i, _ in rows] + [(500, 1, 1), (777, 0, 0), (None, 1, 0), (1, None, 0)], LABELS)
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows + odd)
    by_id = {r.doc_id: r for r in got}
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and by_id[None].held_out
    assert by_id[500].score == by_id[501].score == model.prior
    assert by_id[3].predicted == 1 and by_id[103].predicted == 0
    assert quality.score_quality(make_docs([]), model).collect() == []
    blank = quality.fit(make_docs([]), labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, blank).collect()} == {0.5}


def test_quality_never_learns_from_held_out_rows(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = labels.withColumn("quality", F.when(unseen, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(sf_docs, labels), quality.fit(sf_docs, other)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_language_of_held_out_documents(sf_docs):
    said = language.predict(sf_docs, *language.fit(sf_docs))
    truth = sf_docs.select(F.col("doc_id").alias("id"), "lang", F.col("text").rlike(r"\p{L}").alias("letters"))
    unseen = said.join(truth, said.doc_id == truth.id).filter("held_out and lang is not null and letters").collect()
    assert np.mean([r.lang_pred == r.lang for r in unseen]) > 0.9
    assert all(0 <= r.score <= 1 for r in unseen)


def test_language_of_odd_rows(make_docs):
    rows = [(i, f"the house and the water of the town number {i}", "en", None) for i in range(30)]
    rows += [(100 + i, f"das schöne Haus und die große Straße mit Nummer {i}", "de", None) for i in range(30)]
    odd = [(500, None, "en", None), (501, "", None, None), (502, "12 !", "de", None), (None, "the water of the town", None, None),
           (0, rows[0][1], "en", None), (503, "the house of the town " * 20_000, None, None)]
    docs = make_docs(rows + odd).selectExpr("*", "1 as letters", "2 as score", "3 as place", "4 as n", "5 as held_out")
    net, languages = language.fit(docs, steps=120)
    assert languages == ["de", "en"]
    got = language.predict(docs, net, languages).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows + odd)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (500, 501, 502)} == {language.UNKNOWN} and by_id[None].lang_pred == by_id[503].lang_pred == "en"
    twice = [r.score for r in got if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1], abs=1e-5)
    assert language.predict(make_docs([]), net, languages).collect() == []
    nothing = language.fit(make_docs([(1, "no label", None, None)]))
    assert nothing == (None, [])
    assert [(r.lang_pred, r.score) for r in language.predict(make_docs([(1, "text")]), *nothing).collect()] == [("und", 0.0)]


def test_a_text_reads_the_same_beside_others():
    net = language.new_net(3)
    texts = [b"short one", b"a longer text beside it " * 20, b"", b"x"]
    at = np.cumsum([0, *map(len, texts)])
    together = language.pooled(net, np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), at)
    for i, t in enumerate(texts):
        alone = language.pooled(net, np.frombuffer(t or b"-", np.uint8).astype(np.int16), np.array([0, len(t)]))
        assert np.allclose(alone[0], together[i], atol=1e-6)


def test_gradients_follow_the_loss():
    net = language.new_net(2, hidden=3)
    rng = np.random.default_rng(1)
    steps, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])
    steps[3:, 1] = language.NOTHING
    weights = net.weights()
    for w in weights:
        w[...] = rng.normal(0, 0.3, w.shape)
    _, grads = language.gradients(net, steps, y)
    for w, g in zip(weights, grads, strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        kept, step = w[at], np.float32(5e-3)
        w[at] = kept + step
        up, _ = language.gradients(net, steps, y)
        w[at] = kept - step
        down, _ = language.gradients(net, steps, y)
        w[at] = kept
        assert (up - down) / (2 * float(step)) == pytest.approx(float(g[at]), rel=0.1, abs=1e-3)
