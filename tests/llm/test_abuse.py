import random

import pytest

from leafwright.llm import abuse as A

CALM = "The committee met in the spring and heard a report on the state of the harbour."


def scores(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, score string")
    return {r.doc_id: (r.score, r.category) for r in A.scored(df).collect()}


BAD = [
    "You are a worthless idiot and nobody likes you.", "Y0u are a worthless 1d10t.", "You are an i d i o t and a l o s e r.", "You pathetic m*r*n.", "Shut up, you miserable b@st@rd.",
    "You are a completely useless idiottttt.", "Du bist ein dummer Idiot und ein Versager.", "Tu es un pauvre crétin.", "Eres un imbécil y un pedazo de mierda.", "All of these people are vermin and should be driven out of the country.",
    "I will find out where you live and make you bleed.", "Hot naked girls waiting on cam, watch hardcore porn free.", "You are a brainless scumb-\nag.", "They don't deserve to live among decent people.",
]
FINE = [
    CALM, "", None, "Nude mice received the dosage before the survival was measured.", "The annotators rated offensive words such as idiot on a scale from one to five.", "Breast cancer screening and sex education enter the survey as controls.",
    "Comments labelled as insult, threat or hate speech were removed.", "The kill switch aborts the child process when the job hangs.", "Male rats were bred in master and slave pairs.", "The word \"bastard\" is quoted in the historical dictionary as a term.",
    "con la casa de mi pueblo", "La mesure retarde la règle.", "Abusive supervision, harassment and rape law are surveyed.",
]


def test_scores(spark):
    got = scores(spark, BAD + FINE)
    assert [t for i, t in enumerate(BAD) if got[i][0] < A.CUTOFF] == []
    assert [t for i, t in enumerate(FINE, len(BAD)) if got[i][0] >= A.CUTOFF] == []
    assert got[9][1] == "hateful" and got[11][1] == "sexual" and got[0][1] == "abusive"


def test_labels_and_rates(spark):
    texts = [(i, f"{CALM} {t}" if t else t, "good" if i % 2 else None) for i, t in enumerate(BAD + FINE)] + [(0, f"{CALM} {BAD[0]}", None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, source string")
    labels = spark.createDataFrame([(i, "abusive") for i in range(5)] + [(len(BAD), "ok"), (len(BAD) + 3, "ok"), (1, None), (2, "unsure")], "doc_id int, label string")
    assert sorted(r.doc_id for r in A.flagged(docs, labels).collect()) == list(range(len(BAD)))
    assert sorted(r.doc_id for r in A.flagged(docs, labels.limit(0)).collect()) == list(range(len(BAD)))
    rates = {r.source: r for r in A.rates(docs, labels).collect()}
    assert rates["good"].n_docs + rates[None].n_docs == len(texts) and rates["good"].n_flagged == 7 and rates[None].n_flagged == 8
    assert A.flagged(docs.limit(0), labels).count() == 0


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("word", ["basturd", "scumbag", "imbecille", "table", "harbour", "idoit"])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_automaton_is_the_plain_search(word, most):
    best = min((slow(t, word), t) for t in A.TERMS)
    got = A.TRIE.within(word, most)
    assert (got and (got[1], got[0])) == (best if best[0] <= most else None)


def test_frequent_neighbours_are_words_of_their_own(spark):
    docs = spark.createDataFrame([(i, "a fine bastion of the harbour") for i in range(50)] + [(99, "you bastrad of a harbour"), (98, "you bastard")], "doc_id int, text string")
    found = {r.word: r.term for r in A.spellings(docs, "text").collect()}
    assert "bastion" not in found and found["bastard"] == "bastard"


def test_more_spellings_than_are_held(spark, monkeypatch):
    whole = scores(spark, BAD + FINE)
    monkeypatch.setattr(A, "MOST_SPELLINGS", 3)
    assert {i for i, (s, _) in scores(spark, BAD + FINE).items() if s >= A.CUTOFF} == {i for i, (s, _) in whole.items() if s >= A.CUTOFF}


def test_copies_of_a_misspelt_term(spark):
    docs = spark.createDataFrame([(i, f"{CALM} you bastrd") for i in range(9)] + [(i, f"{CALM} Number {i}.") for i in range(9, 20)], "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, label string")
    assert {r.word: r.n_docs for r in A.spellings(docs, "text").collect()} == {"bastrd": 1}
    assert sorted(r.doc_id for r in A.flagged(docs, labels).collect()) == list(range(9))


def test_rejected_words_stay_rejected_past_what_is_held(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{CALM} you bastrd {i}") for i in range(9)] + [(10, "you moron"), (11, "you idiot")], "doc_id int, text string")
    whole = {r.doc_id: r.score for r in A.scored(docs).collect()}
    monkeypatch.setattr(A, "MOST_SPELLINGS", 1)
    assert {r.doc_id: r.score for r in A.scored(docs).collect()} == whole and whole[0] == 0


def test_words_that_are_no_misspellings_stay_out_past_what_is_held(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{CALM} The mean shifts and lowers the bound {i}.") for i in range(30)] + [(99, "you shits, you losers"), (98, "you are a moron"), (97, "you are an idiot")], "doc_id int, text string")
    whole = {r.doc_id: (r.score, r.category) for r in A.scored(docs).collect()}
    monkeypatch.setattr(A, "MOST_SPELLINGS", 0)
    assert {r.doc_id: (r.score, r.category) for r in A.scored(docs).collect()} == whole
    assert sorted(k for k, (s, _) in whole.items() if s >= A.CUTOFF) == [97, 98, 99]


def test_misspellings_beside_other_terms_are_kept(spark):
    docs = spark.createDataFrame([(i, f"you bastrd {i}, you stupid moron") for i in range(5)] + [(i, f"a fine bastion of the harbour {i}") for i in range(5, 30)] + [(40, "you sltu and bastard"), (41, "the slot is open")], "doc_id int, text string")
    found = {r.word for r in A.spellings(docs, "text").collect()}
    assert "bastrd" in found and "bastion" not in found and "slot" not in found


def test_long_words(spark):
    assert A.spell("idiot" + "t" * 90) == ("idiot", 1, True) and A.spell("donaudampfschifffahrtsgesellschaftskapitän") is None and A.spell("x" * 5000) is None
    assert scores(spark, ["You are such an idiot" + "t" * 60 + "."])[0][0] >= A.CUTOFF


def test_held_out(spark):
    docs = spark.createDataFrame([(i, f"{CALM} {i} {t}", "a" if i % 3 else None) for i, t in enumerate((BAD + [CALM] * 14) * 2)], "doc_id int, text string, source string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 28 < 14, 'abusive', 'ok') as label")
    out = {r.source: r for r in A.held_out(docs, labels, "source").collect()}
    assert sum(r.n_labelled for r in out.values()) == 56 and all(r.n_both == r.n_bad == r.n_flagged for r in out.values())
    assert A.held_out(docs, labels.limit(0), "source").count() == 0


def test_all_labelled_documents_count(spark):
    n = 12_000
    docs = spark.range(n).selectExpr("id as doc_id", f"if(id % 3 = 0, 'You are a worthless idiot.', '{CALM}') as text", "nullif(id % 7, 0) as source")
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 'abusive', 'ok') as label")
    out = {r.source: (r.n_labelled, r.n_bad, r.n_flagged, r.n_both) for r in A.held_out(docs, labels, "source").collect()}
    bad = {g: sum(i % 3 == 0 and i % 7 == (g or 0) for i in range(n)) for g in out}
    assert out == {g: (sum(i % 7 == (g or 0) for i in range(n)), bad[g], bad[g], bad[g]) for g in out} and len(out) == 7


def slow_cutoff(rows):
    best = (-1.0, 0.0, A.CUTOFF)
    for c in [0.5 + 0.05 * i for i in range(23)]:
        tp = sum(bad and score >= c for score, bad in rows)
        if tp:
            best = max(best, (round(2 * tp / (sum(bad for _, bad in rows) + sum(score >= c for score, _ in rows)), 4), -abs(c - A.CUTOFF), c))
    return best[2]


@pytest.mark.parametrize("seed", range(3))
def test_the_cutoff_is_that_of_all_labels(spark, seed):
    rng = random.Random(seed)
    rows = [(i, s, rng.random() < (0.9 if s >= 1 else 0.45 + 0.01 * seed)) for i, s in enumerate(rng.choice([0.0, 0.5, 0.55, 0.65, 0.7, 0.85, 1.0, 1.2, 1.6, 2.5]) for _ in range(11_000))]
    scores = spark.createDataFrame([(i, s) for i, s, _ in rows] + [(i, s) for i, s, _ in rows[:50]], "doc_id int, score double")
    labels = spark.createDataFrame([(i, "hateful" if b else "ok") for i, _, b in rows], "doc_id int, label string")
    assert A.fitted_cutoff(scores, labels) == slow_cutoff([(s, b) for _, s, b in rows])
    assert A.fitted_cutoff(scores, labels.limit(0)) == A.CUTOFF
