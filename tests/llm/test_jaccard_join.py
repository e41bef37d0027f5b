from collections import defaultdict

import numpy as np
import pytest

from flowloom.llm.components import components
from flowloom.llm.jaccard_join import jaccard_groups, similar


def shingles(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(docs, words, percent):
    sets = [(d, shingles(t, words)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    for i, (_, s) in enumerate(sets):
        seen = {j for x in s for j in index[x] if j < i}
        for j in seen:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        smallest[r] = d if smallest.get(r) is None else (smallest[r] if d is None else min(d, smallest[r]))
    return sorted(((d, len(s), smallest[find(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def answer(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot_level": 1}])
def test_equals_brute_force(sf_docs, options):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert answer(jaccard_groups(sf_docs, 4, 85, **options)) == brute(docs, 4, 85)


@pytest.mark.parametrize("hot_level", [20, 2])
def test_many_near_copies_chains_and_odd_rows(make_docs, hot_level):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(None, "lone text of a null id here"), (5, ""), (6, None), (7, "  \n\t "), (8, "one"), (9, "ONE"), (9, "ONE")]
    for i in range(150):  # near copies that share most words, and a chain that drifts away word by word
        own = list(base)
        own[rng.integers(60)] = f"x{i}"
        docs.append((100 + i, " ".join(own)))
    chain = [f"c{i}" for i in range(80)]
    for i in range(40):
        docs.append((1000 + i, " ".join(chain)))
        chain = [*chain[1:], f"d{i}"]
    docs.append((None, " ".join(base)))
    got = answer(jaccard_groups(make_docs(docs), 4, 85, hot_level=hot_level))
    assert got == brute(docs, 4, 85)


def test_empty_table_and_extra_columns(spark, make_docs):
    assert answer(jaccard_groups(make_docs([]), 5, 80)) == []
    df = spark.createDataFrame([(1, "a b", 3, 4), (2, "a b", 5, 6)], "doc_id int, text string, sid int, token int")
    assert answer(jaccard_groups(df)) == [(1, 1, 1), (2, 1, 1)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 501: 500}
    assert components(links.limit(0)).collect() == []


def test_suffix_filter_never_drops_a_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(400):
        x = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.8, 1)], rng.integers(
            0, 2**63, rng.integers(0, 40), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert similar(x, y, 85) == (100 * both >= 85 * (len(x) + len(y) - both))
