import hashlib

import numpy as np
import pytest

from flowloom.llm.suffix_dedup import covered_in_block, remove_repeats


def brute(docs, length=100):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        b = (docs[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = True
            seen.add(s)
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (docs[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=repr)


def answer(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in df.collect()), key=repr)


def test_block_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        parts = [bytes(rng.integers(97, 99, rng.integers(1, 60), dtype=np.uint8)) for _ in range(12)]
        parts += [parts[0] + parts[1], parts[0] * 3, b"a" * 40, b"", "é\0é".encode() * 6]
        ords, starts = rng.integers(0, 5, len(parts)), rng.integers(0, 50, len(parts)) * 1000
        seen, want = {}, set()
        for s, o, b in zip(parts, ords, starts, strict=True):
            for i in range(len(s) - 9):
                seen.setdefault(s[i:i + 10], set()).add((int(o), int(b) + i))
        for places in seen.values():
            want |= places - {min(places)}
        assert set(zip(*map(np.ndarray.tolist, covered_in_block(parts, ords, starts, 10)), strict=True)) == want


def test_equals_brute_force(sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert answer(remove_repeats(sf_docs)) == brute(docs)


@pytest.mark.parametrize("options", [{}, {"hot_level": 0}, {"many_segments": 1}, {"hot_level": 1, "block_text": 300}])
def test_odd_texts_and_small_bounds(make_docs, options):
    rng = np.random.default_rng(8)
    word = [f"w{i} " for i in range(400)]
    passage = "".join(word[i] for i in rng.integers(0, 400, 60))
    docs = [(1, None), (2, ""), (3, "short"), (4, "a" * 1000), (5, "ab" * 300), (6, "ä€" * 80), (7, "x" * 99), (8, "x" * 100)]
    for i in range(40):
        own = "".join(word[j] for j in rng.integers(0, 400, 40))
        cut = int(rng.integers(0, 60))
        docs.append((100 + i, own + passage[cut:] + own[::-1]))
    docs += [(500, docs[-1][1]), (501, docs[3][1]), (502, passage)]
    assert answer(remove_repeats(make_docs(docs), **options)) == brute(docs)


def test_null_and_repeated_ids(make_docs):
    text = "".join(f"{i} " for i in range(100))
    got = answer(remove_repeats(make_docs([(3, text), (None, text), (3, text), (4, text + "end")])))
    assert [(r[0], r[1], r[2]) for r in got] == [(3, 290, 290), (3, 290, 290), (4, 293, 290), (None, 290, 0)]
    assert answer(remove_repeats(make_docs([]))) == []
