import corpus_pipeline as cp


def test_stages_keep_columns_and_clean_rows(spark, make_docs, small):
    words = "the quick brown fox jumps over a lazy dog while many other animals watch from far away".split()
    clean = [(i, " ".join(words[i % 5:] + [f"n{i}x{j}" for j in range(20)]), "en", "s") for i in range(12)]
    german = [(100 + i, " ".join(f"schönes{j}wort{i} und" for j in range(20)), "de", "t") for i in range(12)]
    odd = [(500, None, None, None), (501, "", "en", "s"), (502, "12 34 !!", "en", "s"), (0, clean[0][1], "en", "s"),
           (600, clean[1][1], "en", "s"), (None, "a text of its own without any id in it at all", "en", None)]
    docs = make_docs(clean + german + odd).selectExpr("*", "1 as k", "2 as row", "3 as sid", "4 as at")
    kept = cp.identify_language(spark, docs, small)
    assert kept.columns == docs.columns
    assert {500, 501, 502}.isdisjoint({r.doc_id for r in kept.collect()})
    assert cp.remove_repeated_lines(spark, docs, small).columns == docs.columns
    one = cp.keep_one_of_near_copies(spark, docs, small)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert 600 not in ids and ids.count(0) == 1 and None in ids and {500, 501, *range(12), *range(100, 112)} <= set(ids)
    last = cp.drop_benchmark_leaks(spark, one, small)
    assert last.columns == docs.columns and sorted(map(str, ids)) == sorted(str(r.doc_id) for r in last.collect())


def near_copies_plainly(docs):
    """Ids that stay of (doc_id, text): five-word shingles, similarity of 0.8 or more, the smallest id of each group."""
    import re

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = {i: shingles(t) for i, t in docs}
    stays, group = set(), {}
    for i in sorted(sets):
        if i in group:
            continue
        group[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in sets:
                if b not in group and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[b] = i
                    todo.append(b)
        stays.add(i)
    return stays


def test_stages_against_sql_and_brute_force(spark, small, tmp_path):
    """Each stage on what the one before it kept of the smallest table; language ID and leaks have tests of their own."""
    import duckdb

    from flowloom.llm import queries
    from flowloom.llm.common import table

    def kept(stage, docs, name):
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        return spark.read.parquet(path), duckdb.connect(), path

    docs, _, path = kept(cp.identify_language, table(spark, small, "documents"), "language")
    lines, con, _ = kept(cp.remove_repeated_lines, docs, "lines")
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    want = {i: (n, removed, h) for i, n, removed, h in con.execute(
        f"select doc_id, n_lines, n_removed, kept_sha256 from ({queries.OP5_SQL})").fetchall()}
    got = {r.doc_id: r.h for r in lines.selectExpr("doc_id", "sha2(cast(coalesce(text, '') as binary), 256) as h").collect()}
    assert got == {i: h for i, (n, removed, h) in want.items() if removed == 0 or removed < n}
    apart, _, _ = kept(cp.keep_one_of_near_copies, lines, "apart")
    rows = [(r.doc_id, r.text) for r in lines.select("doc_id", "text").collect()]
    assert {r.doc_id for r in apart.collect()} == near_copies_plainly(rows)
    clean, _, path = kept(cp.drop_benchmark_leaks, apart, "clean")
    mixed, con, _ = kept(cp.mix, clean, "mixed")
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"select {', '.join(columns)} from ({queries.OP7_SQL}) order by doc_id").fetchall()
    got = [tuple(r) for r in mixed.select(*columns).orderBy("doc_id").collect()]
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 * max(1, b[3]) for a, b in zip(got, want))


def test_stages_on_empty_tables(spark, make_docs, small):
    docs = make_docs([])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, small).collect() == []
