import random

import pytest

from leafwright.llm import leakage as L

rng = random.Random(1)
NOUNS = [a + b for a in ("bar", "cor", "dal", "fen", "gor", "hul", "jat", "kel", "lom", "mur") for b in ("ant", "ert", "ith", "ool", "ump", "ack")]


def sentence(r):
    return " ".join(r.choice(NOUNS) if r.random() < 0.7 else r.choice(("the", "of", "and", "a", "in")) for _ in range(12)) + "."


ITEMS = [(i, " ".join(sentence(rng) for _ in range(5))) for i in range(20)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_in_order_is_the_plain_lcs(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(6) for _ in range(r.randint(1, 50))] for _ in range(2))
    places = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in a}
    assert L.in_order(L.span_masks(places, b, 1), len(a)) == lcs(a, b)


@pytest.mark.parametrize("seed", range(15))
@pytest.mark.parametrize("span", (1, 3))
def test_automaton_finds_the_longest_matches(seed, span):
    r = random.Random(seed)
    items = [[r.randrange(4) for _ in range(r.randint(1, 25))] for _ in range(4)]
    auto = L.Automaton.unpacked(L.Automaton(items, 4, span).packed())
    text = [r.choice((-1, 0, 1, 2, 3)) for _ in range(60)]
    holds = lambda s, w: any(s[i : i + len(w)] == w for i in range(len(s) - len(w) + 1))
    longest = [max((n for n in range(i + 2) if any(holds(s, text[i + 1 - n : i + 1]) for s in items)), default=0) for i in range(60)]
    seen = list(auto.stream(text))
    assert [(i, n) for i, n, _ in seen] == [(i, n) for i, n in enumerate(longest) if n >= span]
    for i, _, top in seen:
        assert auto.owners[top].tolist() == [k for k, s in enumerate(items) if holds(s, text[i + 1 - span : i + 1])]


def test_leaks(spark):
    r = random.Random(7)
    filler = lambda n: " ".join(sentence(r) for _ in range(n))
    a, b, c = ITEMS[0][1], ITEMS[1][1], ITEMS[2][1]
    broken = a.replace(" ", "\n", 9).replace("barant", "bar-\nant")
    changed = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(b.split()))
    spread = f" {filler(12)} ".join(c.split(". "))
    items = ITEMS + [(100, "Read the passage and answer.\n" + a), (101, None), (102, " ")]
    docs = [(1, filler(30)), (2, f"{filler(9)} {a.upper()} {filler(9)}"), (3, broken), (4, f"{filler(20)} {changed}"), (5, " ".join(b.split()[: len(b.split()) // 2]) + filler(20)), (6, " ".join(b.split()[:9]) + filler(20)), (7, spread), (8, None), (9, ""), (2, f"{filler(9)} {a}")]
    d = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, cover string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = {(x.item_id, x.doc_id): x.cover for x in L.leaked_items(d, i).collect()}
    assert set(out) == {(0, 2), (100, 2), (0, 3), (100, 3), (1, 4), (1, 5)} and out[0, 2] == 1.0
    assert L.leaked_items(d, i).columns == ["item_id", "doc_id", "cover", "first_word"]
    assert L.leaked_items(d, i.limit(0)).count() == 0 and L.leaked_items(d.limit(0), i).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 120)
    d = spark.createDataFrame([(k, t) for k, t in ITEMS[:6]], "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in L.leaked_items(d, i).collect()} >= {(k, k) for k in range(6)}


def test_passage():
    assert L.passage("Answer this.\nA long passage of several words follows here and goes on.") == "A long passage of several words follows here and goes on."
    assert L.passage("one line only") == "one line only"


def carried(s, window, span):
    """Longest common subsequence of the words that stand in common spans; window: (word, places of s it may stand for)."""
    row = [0] * (len(s) + 1)
    for fits in window:
        last = 0
        for i in range(1, len(s) + 1):
            row[i], last = (last + 1 if i - 1 in fits else max(row[i], row[i - 1])), row[i]
    return row[-1]


@pytest.mark.parametrize("span", (1, 2, 3))
def test_every_pair_is_found(span):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(8, 60)))) for k in range(15)]
    finder = L.Finder(items, span)
    hits = 0
    for _ in range(40):
        doc = r.choices(vocabulary + [f"x{i}" for i in range(4)], k=r.randint(1, 80))
        for _ in range(r.randrange(3)):
            s = r.choice(items)[1].split()
            at = r.randrange(len(s))
            to = r.randrange(len(doc))
            doc[to:to] = s[at : at + r.randint(3, 40)]
        expected = {}
        for k, t in items:
            s = t.split()
            fits = [set() for _ in doc]
            for i in range(len(s) - span + 1):
                for j in range(len(doc) - span + 1):
                    if s[i : i + span] == doc[j : j + span]:
                        for d in range(span):
                            fits[j + d].add(i + d)
            size = int(L.STRETCH * len(s))
            scores = [carried(s, fits[at : at + size], span) for at in range(max(1, len(doc) - size + 1))]
            if max(scores) >= L.COVER * len(s):
                expected[k] = max(scores) / len(s), scores.index(max(scores))
        got = {k: (c, p) for k, c, p in finder.find(" ".join(doc))}
        assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in expected.items()}
        for k, (c, p) in got.items():
            s = items[k][1].split()
            assert len(doc) - p >= c * len(s)
        hits += len(expected)
    assert hits > 20


def test_scattered_words_are_a_pair_if_all_words_count(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    scattered = " ".join(f"w{2 * i} other" for i in range(25))
    d = spark.createDataFrame([(1, scattered)], "doc_id long, text string")
    i = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [r.cover for r in L.leaked_items(d, i, span=1).collect()] == [0.5]
    assert L.leaked_items(d, i).count() == 0


@pytest.mark.parametrize("copies", (1, 6, 7, 10, 40))
def test_a_passage_listed_many_times_is_found_for_each(spark, copies):
    passage = " ".join(f"w{i}" for i in range(60))
    changed = " ".join(w if i % 5 else "other" for i, w in enumerate(passage.split()))
    d = spark.createDataFrame([(1, changed)], "doc_id long, text string")
    i = spark.createDataFrame([(k, ("Answer this.\n" if k % 2 else "") + passage) for k in range(copies)], "item_id long, text string")
    assert sorted(r.item_id for r in L.leaked_items(d, i).collect()) == list(range(copies))


def test_exactly_two_fifths_in_exactly_one_and_a_half_passages(spark):
    passage = [f"w{i}" for i in range(160)]
    kept = passage[:32] + [f"x{i}" for i in range(176)] + passage[-32:]  # 64 words in 240
    docs = [(k, " ".join([f"y{i}" for i in range(k)] + kept + ["z"] * 50)) for k in range(60)] + [(1000, " ".join(passage[:32] + [f"x{i}" for i in range(177)] + passage[-32:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert {(r.doc_id, r.cover, r.first_word) for r in L.leaked_items(d, i).collect()} == {(k, 0.4, k) for k in range(60)}
