"""NULLs, empty texts, ties, repeated rows, empty tables and foreign columns; queries with SQL next to their twins."""

import duckdb  # noqa: F401
import pytest
from compare import compare, connect

from flowloom.llm import decontaminate, exact_dedup, licences, line_dedup, mixing, queries, url_filter
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    ok, note = compare(spark, connect(small), queries.QUERIES[name], queries.ORACLES[name], small)
    assert ok, note


def test_exact_dedup_when_digests_collide(spark, make_docs, tmp_path):
    make_docs([(1, "A"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "b"), (3, "b")]).write.parquet(f"{tmp_path}/d.parquet")
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.lit("00"))):
        got = exact_dedup.exact_dedup(spark, f"{tmp_path}/d.parquet", digest=digest).collect()
        assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [
            (0, 3, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, False), (3, 3, 3, True), (4, 5, 2, False),
            (5, 5, 2, True)]


def test_lines(make_docs):
    got = line_dedup.dedup_lines(make_docs([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (None, "q\n\n\n\nr")]))
    assert {(r.row.doc_id, r.text, r.n_removed) for r in got.collect()} == {
        (1, "a\nb\nc\nd", 0), (2, "x", 3), (3, None, 0), (4, "", 0), (None, "q\n\n\n\nr", 0)}


def test_licences_longest_rule_wins(make_docs):
    s = licences.SENTENCES
    text = ". ".join([s["mit-title"], s["mit-grant"], s["mit-condition"], s["as-is"], "other", s["spdx-mit"]])
    got = {r.doc_id: (r.licences, r.spans) for r in licences.scan_licences(make_docs([(1, text), (2, None), (3, "x")])).collect()}
    assert got == {1: ("MIT", "MIT@0+4,MIT@5+1"), 2: ("", ""), 3: ("", "")}


def test_leaks_with_other_numbers_and_names(spark, make_docs):
    item = "If a train leaves with 5 km left and Anna counts 5 wagons then how many wagons does Anna count in total today"
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string")
    other = item.replace("5", "9").replace("Anna", "Berta")
    uneven = item.replace("5 km", "6 km")
    docs = make_docs([(1, item), (2, "Before. " + other), (3, uneven), (4, None), (5, "clean words only"), (6, other.replace("Berta counts", "Carla counts"))])
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, bench).collect()) == [1, 2]
    for limit in (0, 10**6):
        assert sorted(r.doc_id for r in decontaminate.leaks(docs, bench, broadcast_windows=limit).collect()) == [1, 2]


def test_mix_of_odd_sources(make_docs):
    docs = make_docs([(1, "a b c", None, "x"), (2, None, None, None), (3, "a", None, None), (4, "", None, "y")])
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_sources(docs).collect()}
    assert got[2] == (0, 0) and got[4] == (0, 0) and all(t <= 3 * s for s, t in got.values())
    assert mixing.mix_sources(make_docs([])).collect() == []


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Spam-Farm.org/x?y"), (4, "http://b.org"), (5, "http://q.net/es/1")],
                                  "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.spam-farm.org", "/x", None, "block"),
                   4: ("b.org", "", None, "allow"), 5: ("q.net", "/es/1", "net/es/", "block")}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    levels = url_filter.bloom_cascade(universe.filter("cast(substr(key, 2) as int) % 7 = 0"), universe)
    assert len(levels) > 1
    assert universe.filter(url_filter.is_listed(levels, F.col("key")) != (F.expr("cast(substr(key, 2) as int) % 7 = 0"))).isEmpty()
