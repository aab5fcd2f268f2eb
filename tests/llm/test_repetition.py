import math
import random
from bisect import bisect_right
from collections import Counter

import pytest

from leafwright.llm import repetition as R

PROSE = (
    "The committee met in the spring and heard a report on the state of the harbour. Several members asked how the new cranes would be paid for. "
    "It was agreed that a loan should be sought from the bank in the capital. Nobody spoke against the plan, although the clerk noted that the last loan had not been repaid. "
    "After a short pause the meeting turned to the fishing rights, which had been argued over for years by the two villages on the coast."
)


def slow_share(tokens, run):
    marked = set()
    for i in range(len(tokens) - run + 1):
        if any(tokens[j : j + run] == tokens[i : i + run] for j in range(i)):
            marked.update(range(i, i + run))
    return len(marked)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_is_the_plain_count(seed):
    rng = random.Random(seed)
    tokens = [rng.choice("abc") for _ in range(rng.randrange(40))]
    assert R.repeated(tokens, 3) == slow_share(tokens, 3)


@pytest.mark.parametrize(
    ("text", "case"),
    [
        (PROSE, False), (PROSE + " " + PROSE, True), (PROSE + " and so on" * 40, True), (PROSE + " word" * 100, True),
        (PROSE + "\n" + "\n".join(f"Figure {i} shows the harbour in the year {1900 + i}." for i in range(20)), True),
        (PROSE + "\n" + "\n".join(("GO  HOME NOW, said the clerk of it!" if i % 2 else "go home now said the clerk of it") for i in range(20)), True),
        ("\n".join(f"row {i}, 1.5, 2.5, 3.5, 4.5, n/a" for i in range(40)), False),
        ("\n".join(f"• the item of kind {i}" for i in range(40)), False),
        ("(cid:12)(cid:13) " * 60, False), ("", False), ("   ", False), (None, False), ("one two", False),
    ],
)
def test_cases(spark, text, case):
    out = R.repeated_content(spark.createDataFrame([("k", text, "clash")], "id string, t string, repeated_share string"), ["id"], "t").collect()
    assert len(out) == 1 and out[0].flagged == case
    if not text or not text.strip():
        assert (out[0].n_words, out[0].repeated_share) == (0, 0.0)


def test_rows_are_kept(spark):
    df = spark.createDataFrame([("a", PROSE), ("a", PROSE), (None, None)], "id string, t string")
    assert R.repeated_content(df, ["id"], "t").count() == 3 and R.repeated_content(df.limit(0), ["id"], "t").count() == 0


def _texts(seed, n):
    rng = random.Random(seed)
    nouns = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("arn", "eld", "ist", "oom", "ung", "ade")]
    return [" ".join("The {} of the {} has {} it in a {} of this {}.".format(*rng.sample(nouns, 5)) for _ in range(15)) for _ in range(n)]


@pytest.mark.parametrize("bias", (0.0, 0.08, 0.12))
def test_cutoffs_keep_their_promise(bias):
    rows = [(name, s + bias) for t in _texts(0, 200) for name, s in R.holdout(t)]
    found = R.certified(rows)
    assert found and (min(found.values()) > R.SHARE) == (bias > 0.05)  # biased scores raise the cutoff over the wanted share
    fresh = [(name, s + bias) for t in _texts(99, 400) for name, s in R.holdout(t)]
    wrong = [s >= R.cutoff_of(name, found) for name, s in fresh]
    assert len(wrong) > 1000 and sum(wrong) <= R.RISK * len(wrong)


def test_what_cannot_be_certified_is_said(spark):
    assert R.certified([]) == {} and R.cutoff_of("en long", {}) is None
    assert R.certified([("en long", 1.0)] * 500) == {} and R.certified([("en long", 0.1)] * 20) == {}
    found = R.certified([("en long", 0.1)] * 400 + [("de long", 0.1)] * 20)
    assert "de long" not in found and R.cutoff_of("de long", found) == found["* long"] and R.cutoff_of("de short", found) == found["*"]
    df = spark.createDataFrame([("k", PROSE + " " + PROSE)], "id string, t string")
    assert [(r.cutoff, r.certified, r.flagged) for r in R.repeated_content(df, ["id"], "t").collect()] == [(R.SHARE, False, True)]
    many = spark.createDataFrame([(str(i), t) for i, t in enumerate(_texts(5, 300))] + [("k", PROSE + " " + PROSE)], "id string, t string")
    assert [r.certified for r in R.repeated_content(many, ["id"], "t").where("id = 'k'").collect()] == [True]


def test_one_text_a_thousand_times_is_one_row_of_the_holdout(spark):
    rows = [("copy", PROSE)] * 3000 + [(str(i), t) for i, t in enumerate(_texts(6, 300))]
    out = R.repeated_content(spark.createDataFrame(rows, "id string, t string"), ["id"], "t")
    assert out.where("flagged").count() == 0


def test_lines_and_runs_are_united():
    texts = _texts(3, 6)
    lines = "\n".join(f"and so it {w}.\n{' '.join(t.split()[4:8])}" for t, w in zip(texts, ["goes", "goes", "goes", "runs", "runs", "runs"]))
    tokens = R.words(lines)
    assert R.repeated(tokens) == 0 and R.repeated_share(lines)[0] == pytest.approx(16 / len(tokens))
    both = PROSE + "\n" + lines + "\n" + PROSE
    assert R.repeated_share(both)[0] == pytest.approx((16 + len(R.words(PROSE))) / len(R.words(both)))


def test_the_language_is_that_of_the_whole_text():
    start = "zzz " * 2000
    assert R.stratum(start + PROSE, 3000) == "en long"


def test_binomial_tail():
    assert R.binomial_tail(3, 3, 0.4) == pytest.approx(1.0) and R.binomial_tail(2, 0, 0.5) == pytest.approx(0.25)


def test_long_text(spark):
    text = PROSE * 2000
    assert R.repeated_share(text)[0] > 0.99


def test_the_holdout_is_all_texts(spark):
    german = [t.replace("The", "Die").replace(" of the ", " für die ").replace("has", "hat").replace(" it in a ", " sie nicht mit ").replace(" of this ", " oder ") for t in _texts(8, 120)]
    texts = _texts(7, 2800) + german
    rows = [x for t in texts for x in R.holdout(t)]
    found = R.certified(rows)
    assert "de long" in found and found["de long"] != found["* long"]  # of a part of the texts too few are German
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, *german, *german, None, "", "short"])] + [("k", german[0] + " " + german[0])], "id string, t string")
    counts = R.holdout_counts(df, "t")
    again = R.holdout(german[0] + " " + german[0])
    assert sum(counts.values()) == len(rows) + len(again)
    assert counts == Counter((name, bisect_right(R.GRID, s)) for name, s in rows + again)
    assert [(r.stratum, r.cutoff) for r in R.repeated_content(df, ["id"], "t").where("id = 'k'").collect()] == [("de long", R.certified(rows + again)["de long"])]


@pytest.mark.parametrize("seed", range(5))
def test_scores_of_the_holdout_are_those_of_its_texts(seed):
    texts = _texts(seed, 40) + [f"{t} – {PROSE} & {t[:90]} {seed}" for t in _texts(seed + 50, 20)] + [PROSE + "\n" + "\n".join(t.split(". ")[:3]) for t in _texts(seed + 90, 10)]
    for t in texts:
        clean, rows = R.collapsed(t), R.holdout(t)
        if len(R.words(clean)) < 30 or R.repeated_share(clean)[0] > 0.05:
            assert rows == []
            continue
        rng, made = random.Random(clean), []
        for k in range(3):
            tokens = clean.split()
            at, more = R.insertion(tokens, lambda: R.segments(clean), 0.0 if k == 0 else rng.uniform(0.05, R.SHARE - 0.02), rng.randrange(4), rng)
            made.append(" ".join(tokens[:at] + more + tokens[at:]))
        assert rows == [(R.stratum(x, n), s) for x in made for s, _, n in (R.score(x),)]
        assert [(a, s >= 0.3 and s) for a, s in R.holdout(t, least=0.3)] == [(a, s >= 0.3 and s) for a, s in rows]


def test_binomial_tail_of_many_rows():
    n = 10**7
    assert R.binomial_tail(n, n, 0.02) == pytest.approx(1.0) and R.binomial_tail(n, n // 50, 0.02) == pytest.approx(0.5, abs=1e-3) and R.binomial_tail(n, n // 100, 0.02) == 0.0
    assert R.binomial_tail(3000, 40, 0.02) == pytest.approx(sum(math.comb(3000, i) * 0.02**i * 0.98 ** (3000 - i) for i in range(41)))


def test_texts_are_read_once(spark):
    """What is returned comes from the checkpoint: the cutoffs don't need the texts again."""
    rows = [(str(i), t) for i, t in enumerate(_texts(5, 300))] + [("k", PROSE + " " + PROSE), ("n", None), ("e", "")]
    out = R.repeated_content(spark.createDataFrame(rows, "id string, t string"), ["id"], "t")
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert len(rows) == out.count() and [(r.id, r.certified) for r in out.where("flagged").collect()] == [("k", True)]
    assert [(r.id, r.n_words, r.repeated_share, r.certified, r.flagged) for r in out.where("id in ('n', 'e')").orderBy("id").collect()] == [("e", 0, 0.0, None, False), ("n", 0, 0.0, None, False)]


def test_only_rows_near_a_cutoff_are_looked_up(monkeypatch):
    texts = _texts(12, 60)
    looked = []
    monkeypatch.setattr(R, "_repeated_with", lambda *a, f=R._repeated_with: looked.append(1) or f(*a))
    all_rows = [x for t in texts for x in R.holdout(t)]
    n = len(looked)
    looked.clear()
    some_rows = [x for t in texts for x in R.holdout(t, least=R.GRID[0])]
    assert 0 < len(looked) < 0.6 * n
    reach = lambda rows: [(name, bisect_right(R.GRID, s)) for name, s in rows]
    assert reach(all_rows) == reach(some_rows) and len({r for _, r in reach(all_rows)}) > 3


def test_words_are_the_same_whatever_came_before():
    texts = [*_texts(2, 20), "Über 3,5 % (İstanbul) – l’été 12-b ΣΑΣ x" + "y" * 60 + ".", "— , ..."]
    known = R._word.__self__
    first = [R.words(t) for t in texts]
    assert first == [R.words(t) for t in texts] == [[w for t in x.lower().split() if (w := R._plain(t))] for x in texts]
    assert not any(len(t) > known.TOKEN for t in known) and len(known) <= known.MOST
