import random

import pytest

from leafwright.llm import scans as S

WORDS = "committee harbour spring report members cranes agreed should sought capital against although repaid meeting fishing rights villages coast noted paid question winter bridge season letter market engine window".split()


def page(rng, n=60):
    out = []
    for _ in range(n // 8):
        a = rng.sample(WORDS, 5)
        out.append(f"The {a[0]} of the {a[1]} was {a[2]} by the {a[3]} and the {a[4]}.")
    return " ".join(out)


def corpus():
    rng = random.Random(3)
    rows = []
    for d in range(14):
        for p in range(1, 8):
            head = f"Annals of the {WORDS[d].title()} {WORDS[d + 9].title()} Society\n" if d < 6 else ""
            rows.append((f"d{d}", p, head + ("Introduction\n\n" if p == 1 and d > 5 else "") + page(rng)))
    return rows


def test_noise_and_repair(spark):
    rng = random.Random(5)
    rows = corpus()
    clean = page(rng)
    rows += [
        ("m", 1, clean.replace("harbour", "harb0ur").replace("committee", "cornmittee").replace("winter", "wlnter") + " The harb0ur of the cornmittee was noted by the wlnter."),
        ("b", 1, page(rng) + " The com-\nmittee of the har¬\u00a0\nbour was noted."),
        ("h", 1, page(rng) + " The well-known co-\nworker left."),
        ("n", 1, page(rng) + "\n\n- 12 -"), ("n", 2, "[7]\n" + page(rng)), ("n", 3, page(rng) + "\nPage 3"),
        ("s", 1, page(rng) + " The har bour of the com mittee was noted."),
        ("c", 1, page(rng)), ("g", 1, "kqx0 vvz- ppl1 mmt rrw9 " * 20 + "\n12"), ("e", 1, ""), ("e", 2, None), ("e", 3, "  "), ("c", 1, rows[0][2]),
    ]
    df = spark.createDataFrame([(d, p, t, "clash") for d, p, t in rows], "doc_id string, page_num int, t string, word string").dropDuplicates(["doc_id", "page_num"])
    flags, fixes, headers, joins = S.scan_noise(df, ["doc_id", "page_num"], "t")
    out = {(r.doc_id, r.page_num): r for r in flags.collect()}
    assert all(out[f"d{d}", p].header for d in range(6) for p in range(1, 8)) and not any(k[0] in {"c", "e", "g"} or k[0][1:].isdigit() and int(k[0][1:]) > 5 for k in out)
    assert out["m", 1].misread and {r.word: r.replacement for r in fixes.collect()} == {"harb0ur": "harbour", "cornmittee": "committee", "wlnter": "winter"}
    assert out["b", 1].broken and out["s", 1].misread and all(out["n", p].page_number for p in (1, 2, 3))
    text = {(r.doc_id, r.page_num): r.repaired_text for r in S.repaired_texts(df, ["doc_id", "page_num"], "t").collect()}
    assert "0" not in text["m", 1] and "committee of the harbour was noted" in text["b", 1] and "12" not in text["n", 1] and not text["d0", 2].startswith("Annals")
    assert text["e", 1] == "" and ("e", 2) not in text
    empty = S.scan_noise(df.limit(0), ["doc_id", "page_num"], "t")
    assert [x.count() for x in empty] == [0, 0, 0, 0]


@pytest.mark.parametrize(("right", "read", "cheap"), [("modern", "modem", True), ("clear", "dear", True), ("report", "rep0rt", True), ("harbour", "barbour", True), ("harbour", "harvour", False), ("ship", "shop", False)])
def test_misreading_cost(right, read, cheap):
    assert (S.misreading_cost(right, read) < 0.5) == cheap


def test_ranker_on_held_out_words():
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("al", "er", "in", "or", "un")]
    words = [("".join(rng.sample(syllables, 3)), rng.randint(50, 5000)) for _ in range(900)]
    model = S.word_ranker(words[:700])
    good = bad = 0
    for w, n in words[700:]:
        wrong = S._misread(w, rng, 1)
        if wrong != w:
            good += model.probability_of(S._word_features(w, wrong, n, max(1, n // 400))) >= 0.5
            bad += 1
        at = rng.randrange(len(w))
        other = w[:at] + "x" + w[at:]
        good += model.probability_of(S._word_features(w, other, n, max(1, n // 400))) < 0.5
        bad += 1
    assert good >= 0.95 * bad


def test_canonical():
    assert S.canonical("12  HOUSlNG of 5igns  Vol. 7") == S.canonical("Housing of signs Vol. 8")


def test_errors_inside_short_words(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("al", "er", "in", "or", "un")]
    read = {"tirne": "time", "thcse": "these", "wcek": "week", "nolsy": "noisy", "moclel": "model", "kemel": "kernel", "sh0ws": "shows"}
    rows = [("".join(rng.sample(syllables, 3)), rng.randint(2000, 5000)) for _ in range(300)] + [(w, 2000) for w in read.values()] + [(w, 2) for w in read]
    counts = spark.createDataFrame(rows, "word string, n long").groupBy("word").agg({"n": "max"}).toDF("word", "n")
    assert {r.word: r.replacement for r in S.corrections(counts).collect()} == read


def planted(rng, text):
    """The text as a scanner would give it: a header, a number, lines broken at 50 characters, words broken or misread; and the words it had."""
    words, out, line = text.split(), [], ""
    for w in words:
        if rng.random() < 0.06 and w.isalpha() and len(w) > 5:
            w = S._misread(w, rng, 1)
        if len(line) + len(w) > 50:
            if rng.random() < 0.4 and w.isalpha() and len(w) > 5:
                at = rng.randint(3, len(w) - 3)
                out.append(line + " " + w[:at] + rng.choice("-¬"))
                line = w[at:]
                continue
            out.append(line)
            line = w
        else:
            line = (line + " " + w).strip()
    return "\n".join([*out, line]), words


def test_repair_of_planted_noise(spark):
    rng = random.Random(21)
    rows, truth = corpus(), {}
    for d in range(8):
        head = f"Proceedings of the {WORDS[d].title()} Meeting {WORDS[d + 5].title()}"
        for p in range(1, 8):
            noisy, words = planted(rng, page(rng, 90))
            truth[f"p{d}", p] = words
            rows.append((f"p{d}", p, f"{head}\n{noisy}\n\n- {p} -"))
    df = spark.createDataFrame(rows, "doc_id string, page_num int, t string")
    out = {(r.doc_id, r.page_num): r.repaired_text.split() for r in S.repaired_texts(df, ["doc_id", "page_num"], "t").collect()}
    right = sum(sum(a == b for a, b in zip(out[k], w)) for k, w in truth.items() if len(out[k]) == len(w))
    assert right >= 0.97 * sum(map(len, truth.values()))


def test_words_beyond_those_held(spark, monkeypatch):
    rng = random.Random(8)
    rows = corpus() + [("b", 1, page(rng) + " The com-\nmittee of the well-\nworn har-\nbour was noted."), ("s", 1, page(rng) + " The har bour of the com mittee was noted."), ("m", 1, page(rng) + " The harb0ur of it.")]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, t string")
    whole = [sorted(map(str, x.collect())) for x in S.scan_noise(df, ["doc_id", "page_num"], "t")]
    calls = []
    plain = S.most_frequent
    monkeypatch.setattr(S, "HELD_WORDS", 3)
    monkeypatch.setattr(S, "break_classifier", lambda words, f=S.break_classifier, n=sorted: calls.append(len(words)) or f(MOST))
    MOST = sorted(((r.word, r.n) for r in S.word_counts(df, "t").where("n >= 20").collect()), key=lambda x: (-x[1], x[0]))
    assert len(plain(S.word_counts(df, "t"), 3)) <= 3
    assert [sorted(map(str, x.collect())) for x in S.scan_noise(df, ["doc_id", "page_num"], "t")] == whole and calls[0] <= 3


def test_a_journal_on_every_page_of_many_documents(spark):
    rng = random.Random(12)
    rows = [(f"d{d}", p, ("Journal of Harbour Studies\n" if p > 1 else "") + ("Introduction\n\n" if p == 1 else "Conclusion\n\n" if p == 7 else "") + page(rng)) for d in range(12) for p in range(1, 8)]
    rows += [(d + "x", p, t) for d, p, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, t string")
    out = {(r.doc_id, r.page_num) for r in S.scan_noise(df, ["doc_id", "page_num"], "t")[0].where("header").collect()}
    assert {(f"d{d}", p) for d in range(12) for p in range(2, 8)} == {k for k in out if not k[0].endswith("x")}
