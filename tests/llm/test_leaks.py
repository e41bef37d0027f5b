"""Leaks that are edited, quoted in part, re-parameterised at the start of sentences, short, or disagree in a slot."""

import pytest

from flowloom.llm import decontaminate


@pytest.fixture
def found(spark, make_docs):
    def run(item, *texts, **options):
        bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
        return sorted(r.doc_id for r in decontaminate.leaks(make_docs(list(enumerate(texts))), bench, **options).collect())

    return run


def words(n, prefix="w"):
    return [f"{prefix}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(n)]


def test_inserted_words(found):
    short, long = words(20), words(40)
    once = [*short[:10], "extra", *short[10:]]
    assert found(" ".join(short), " ".join(once)) == [0]
    twice = [*long[:13], "extra", *long[13:27], "more", *long[27:]]
    assert found(" ".join(long), " ".join(twice), " ".join([*long[:8], *words(40, "x")])) == [0]


def test_part_of_a_long_item(found):
    other = words(40, "x")
    assert found(" ".join(words(300)), " ".join([*other, *words(300)[100:180], *other]), " ".join(other)) == [0]
    assert found(" ".join(words(59)), " ".join([*other, *words(59)[20:40], *other]), " ".join([*other, *words(59)[20:32]])) == [0]


def test_numbers_alone_are_no_run(found):
    item = " ".join([*words(60), *map(str, range(100, 120))])
    assert found(item, " ".join(map(str, range(500, 520)))) == []


def test_names_that_open_sentences(found):
    item = "Anna has 5 red apples. Ben has 7 apples. How many apples do they have?"
    other = "Carla has 6 red apples. Dora has 9 apples. How many apples do they have?"
    assert found(item, other, other.lower(), "The sun has set. " + other) == [0, 2]
    assert found("The old house by the lake was sold again", "and so the old house by the lake was sold again") == [0]


def test_wider_names_and_numbers(found):
    item = "Today Mr O'Brien gave three pears to Jean-Luc and twenty-one plums to McDonald before noon"
    other = "Today Mr Smith gave 4 pears to Anna and nine plums to Lee before noon"
    assert found(item, other) == [0]


def test_short_item_in_a_long_text(found):
    before, behind = words(30), words(30, "x")
    inside = " ".join([*before, "What is the capital of France?", *behind])
    assert found("What is the capital of France?", inside, "What is the capital", "What is the capital of Spain?") == [0, 2]
    assert found("What is the capital of France?", inside, broadcast_windows=0) == [0]
    assert found("17 4", "a text with 23 8 in it", "a text with 17 4 in it", "23 8") == [1, 2]


def test_a_slot_that_disagrees_takes_its_windows_only(found):
    item = " ".join(["5 km", *words(20), "5 wagons"])
    assert found(item, item.replace("5 km", "6 km")) == [0]
    assert found(" ".join(["3 km", *words(20), "5 wagons"]), " ".join(["4 km", *words(20), "4 wagons"])) == [0]


def test_copies_in_lower_and_upper_case(found):
    item = "Today Mr Brown met Anna and Berta near the old Mill before Carl left for Rome again"
    assert found(item, item, item.lower(), item.upper(), item.replace("Anna", "Dora").replace("Rome", "Bern")) == [0, 1, 2, 3]


def test_documents_of_numbers(found):
    """Windows of nothing but numbers are held with their values only: no false leak, and no pair of windows for every pair of places."""
    item = " ".join(map(str, range(200)))
    sevens = " ".join(str(7 * i) for i in range(8_000))
    assert found(item, sevens, " ".join(map(str, range(8_000))), "So 23 8 and " + " ".join(map(str, range(50, 120)))) == [1, 2]


def plainly(item, text, size=8, min_share=0.3, min_run=13):
    """Templates and their alignments for items and texts of lower-case words and numbers, pair by pair."""
    a, b = item.split(), text.split()

    def kind(w):
        return "#" if w.isdigit() else w

    held, values, longest = set(), set(), 0
    if len(a) < size:
        return None
    for shift in range(-len(a), len(b)):
        places = [i for i in range(len(a) - size + 1) if 0 <= i + shift <= len(b) - size
                  and all(kind(a[i + j]) == kind(b[i + shift + j]) for j in range(size))
                  and (any(not a[i + j].isdigit() for j in range(size)) or a[i:i + size] == b[i + shift:i + shift + size])]
        pairs = {(a[i + j], b[i + shift + j]) for i in places for j in range(size) if a[i + j].isdigit()}
        bad = {p for p in pairs if sum(p[0] == x for x, _ in pairs) > 1 or sum(p[1] == y for _, y in pairs) > 1}
        good = [i for i in places if not any((a[i + j], b[i + shift + j]) in bad for j in range(size) if a[i + j].isdigit())]
        held |= set(good)
        run, last = 0, -2
        for i in good:
            run = run + 1 if i == last + 1 else 1
            last, longest = i, max(longest, run)
    solid = {i for i in range(len(a) - size + 1) if any(not w.isdigit() for w in a[i:i + size])}
    values = held - solid
    total = len(solid) + len(values)
    return bool(held) and (len(held) / total >= min_share or longest + size - 1 >= min_run)


def test_leaks_against_pairs_of_windows(found):
    import random

    rng = random.Random(4)
    vocabulary = ["red", "hat", "dog", "sun", "run", "1", "2", "3", "44"]
    for _ in range(6):
        item = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        texts = []
        for _ in range(25):
            text = list(item)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            cut = rng.randrange(len(text))
            texts.append(" ".join([*[rng.choice(vocabulary) for _ in range(rng.randrange(9))], *(text[:cut] if rng.random() < 0.4 else text[cut:] + text)]))
        want = [i for i, t in enumerate(texts) if plainly(" ".join(item), t)]
        assert found(" ".join(item), *texts) == want


def test_recall_by_kind_of_edit(spark, small):
    """Items of the benchmark, edited and put into other texts; nine of ten are found, and clean texts stay."""
    import random

    rng = random.Random(8)
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect() if r.text and len(r.text.split()) >= 16][:60]
    filler = [f"{a}{b}" for a in ("blor", "quix", "zand", "trem") for b in ("ok", "ins", "ath", "uvel", "ewn")]

    def around(words):
        return " ".join([*rng.choices(filler, k=30), *words, *rng.choices(filler, k=30)])

    def inserted(words):
        at = len(words) // 2
        return [*words[:at], "zork", *words[at:]]

    kinds = {
        "as it is": lambda w: w, "lower case": lambda w: [x.lower() for x in w], "upper case": lambda w: [x.upper() for x in w],
        "one word inserted": inserted, "half": lambda w: w[:max(13, len(w) // 2)],
        "one word in twenty dropped": lambda w: [x for x in w if rng.random() > 0.05]}
    docs = [(f"{kind}:{i}", around(edit(w))) for kind, edit in kinds.items() for i, w in items]
    docs += [(f"clean:{i}", " ".join(rng.choices(filler, k=80))) for i in range(60)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id string, text string"), bench)
    hit = {r.doc_id for r in got.collect()}
    recall = {kind: sum(f"{kind}:{i}" in hit for i, _ in items) / len(items) for kind in kinds}
    assert min(recall.values()) >= 0.9, recall
    assert not any(h.startswith("clean") for h in hit)
