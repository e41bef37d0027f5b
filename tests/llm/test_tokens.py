import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import alignment, subwords, token_counts
from flowloom.llm.common import table


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b  ", "\n", "\n\n a", "a\n b", "a \n b", "a\t\tb \t c", "x▁y", "▁", "a ▁b",
    "<s>x</s> <unk> <|endoftext|>", "café naïve", "café", "汉字 中文", "\U0001f600\U0001f600 x", "\x00a \x1c b\x85c\xa0d 　e",
    "it's we'll I'VE 's 'll", "1234567 89 3.14", "=" * 300, "a" * 3000, "ab " * 2000, "a\r\nb\r\n", "<0x0A> x", "don't  do\n\n\n this ", "﻿x y",
    "word" * 400 + " tail", "x " + " " * 50 + "y", "tab\tword", "a b c", "same words here", "same words here", "same words here",
]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(subwords.default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=subwords.default_path("piece_bpe_32k.model"))


def aligned_plainly(models, texts):
    """The contract of op11, token by token."""
    a, b = models
    of_a, of_b = subwords.byte_model(subwords.default_path("byte_bpe_50k.json")).bytes, subwords.piece_model(
        subwords.default_path("piece_bpe_32k.model")).bytes
    out, counts, all_links = [], Counter(), []
    for text in texts:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(of_a[i] for i in ids_a) != whole or b"".join(of_b[i] for i in ids_b) != whole:
                ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in ids_a]).tolist(), np.cumsum([len(of_b[i]) for i in ids_b]).tolist()
        j = 0
        for i, (x, end) in enumerate(zip(ids_a, ends_a)):
            begin = ends_a[i - 1] if i else 0
            while j and ends_b[j - 1] > begin:
                j -= 1
            while j < len(ids_b) and (ends_b[j - 1] if j else 0) < end:
                if ends_b[j] > begin:
                    links.append((x, ids_b[j]))
                j += 1
        common = sorted(set(ends_a) & set(ends_b))
        low = 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= high) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = high
        counts.update(links)
        all_links.append(links)
        out.append([len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(*o[:4], sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), o[4]) for o, links in zip(out, all_links)]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_odd_texts(spark, make_docs, models):
    docs = make_docs(list(enumerate(ODD_TEXTS)))
    want = sorted(((i, *r) for i, r in enumerate(aligned_plainly(models, ODD_TEXTS))), key=repr)
    for part_bytes in (1, 500, 1 << 24):
        assert rows(alignment.align_tokens(docs, part_bytes=part_bytes), *ALIGNED) == want


def test_alignment_of_the_small_table(spark, small, models):
    docs = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = sorted(((i, *r) for i, r in zip(texts, aligned_plainly(models, list(texts.values())))), key=repr)
    assert rows(alignment.align_tokens(docs), *ALIGNED) == want


def test_alignment_of_repeated_rows_and_nothing(spark, make_docs, models):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])
    once = aligned_plainly(models, ["a b"] * 3)[0]
    nothing = (0, 0, 0, 0, 0, 0, "")
    assert rows(alignment.align_tokens(docs), *ALIGNED) == sorted([(1, *once), (1, *once), (None, *once), (None, *nothing)], key=repr)
    assert rows(alignment.align_tokens(docs.limit(0))) == []
    clash = docs.selectExpr("*", "'x' as key", "1 as n", "2 as n_links", "'y' as part", "3 as hot")
    assert rows(alignment.align_tokens(clash), *ALIGNED) == rows(alignment.align_tokens(docs), *ALIGNED)


def test_hot_texts_are_joined_by_broadcast(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "same text" if i % 3 else f"text {i}") for i in range(300)])
    want = rows(alignment.align_tokens(docs), *ALIGNED)
    for share in (2, 10_000):
        monkeypatch.setattr(alignment, "HOT_SHARE", share)
        assert rows(alignment.align_tokens(docs), *ALIGNED) == want


def test_ranks_and_merges_give_the_same_tokens(models):
    """Every character between letters, digits and spaces: the pattern of both libraries has the same classes."""
    fast = subwords.byte_model(subwords.default_path("byte_bpe_50k.json")).fast
    assert fast is not None
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c} \n{c}x " for c in chars[i:i + 400]) for i in range(0, len(chars), 400)]
    for text, e in zip(texts, models[0].encode_batch(texts, add_special_tokens=False)):
        assert fast.encode_ordinary(text) == e.ids


def test_units_have_the_tokens_of_the_text(models):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "1", "23", " ", "  ", "\n", "\t", "　", ".", "'s", "é", "汉", "▁", "\x1c", "\x85", "ing", "<s>"]
    a, b = models
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        units = subwords.units_of(text)
        assert " ".join(units) == text
        assert [i for u in units for i in a.encode(" " + u, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in units for i in b.encode(u)] == b.encode(text)


COUNTED = ("doc_id", "n_bytes", "n_tokens", "over_limit")


def counted_plainly(models, texts, limit=4096):
    out = []
    for text in texts:
        n = len(models[1].encode(text or ""))
        out.append((len((text or "").encode()), n, n > limit))
    return out


@pytest.mark.parametrize("huge,chunk,overlap", [(1 << 16, 1 << 15, 512), (20, 16, 4), (5, 64, 32)])
def test_token_counts_of_odd_texts(make_docs, models, huge, chunk, overlap):
    docs = make_docs(list(enumerate(ODD_TEXTS)))
    want = sorted(((i, *r) for i, r in enumerate(counted_plainly(models, ODD_TEXTS))), key=repr)
    assert rows(token_counts.count_tokens(docs, huge=huge, chunk=chunk, overlap=overlap), *COUNTED) == want


def test_token_counts_of_the_table(spark, sf_docs, models):
    texts = {r["doc_id"]: r["text"] for r in sf_docs.select("doc_id", "text").collect()}
    want = sorted(((i, *r) for i, r in zip(texts, counted_plainly(models, list(texts.values())))), key=repr)
    assert rows(token_counts.count_tokens(sf_docs), *COUNTED) == want
    assert rows(token_counts.count_tokens(sf_docs, huge=3_000, chunk=1_000, overlap=60), *COUNTED) == want


def test_overlaps_widen_until_neighbours_agree(spark, make_docs, models, monkeypatch):
    rounds = []
    plain = token_counts._chunk_rows
    monkeypatch.setattr(token_counts, "_chunk_rows", lambda *a: rounds.append(a[2:]) or plain(*a))
    texts = ["a" * 200_000, "b c " * 30_000, "x" * 90_000 + " y " + "x" * 90_000]
    docs = make_docs([*enumerate(texts), (3, texts[0]), (None, texts[1])])
    want = sorted([*((i, *r) for i, r in enumerate(counted_plainly(models, texts))), (3, *counted_plainly(models, texts[:1])[0]),
                   (None, *counted_plainly(models, texts[1:2])[0])], key=repr)
    assert rows(token_counts.count_tokens(docs), *COUNTED) == want
    assert rounds[0] == (1 << 15, 512) and len(rounds) > 2  # the text of one letter has no stable place


def test_token_counts_by_a_byte_level_vocabulary(make_docs, models):
    path = subwords.default_path("byte_bpe_50k.json")
    texts = [t for t in ODD_TEXTS if t] + ["many words in a row " * 50]
    docs = make_docs(list(enumerate(texts)))
    want = sorted(((i, len(models[0].encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)), key=repr)
    assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == want
    assert rows(token_counts.count_tokens(docs, path, huge=10, chunk=64, overlap=16), "doc_id", "n_tokens") == want


def test_token_counts_of_nothing(make_docs):
    docs = make_docs([(1, "a b"), (1, "a b")])
    assert rows(token_counts.count_tokens(docs.limit(0))) == []
    clash = docs.selectExpr("*", "'x' as key", "1 as n_tokens", "2 as n_bytes", "3 as seq")
    assert rows(token_counts.count_tokens(clash), *COUNTED) == [(1, 3, 2, False)] * 2


def test_splices_do_not_trust_equal_ends_alone():
    """A boundary is named only where no piece can cross it, whatever the tokens of one chunk say."""
    model = subwords.piece_model(subwords.default_path("piece_bpe_32k.model"))
    data = b"the thing in there"
    ends = np.arange(1, len(data) + 1)  # as if every byte were a token
    named = [p["at"] for p in token_counts.boundaries(model, data, ends, 0, len(data))]
    assert named and set(named) <= {i for i in range(1, len(data)) if data[i - 1:i + 1].decode().replace(" ", subwords.MARK) not in model.pairs}
