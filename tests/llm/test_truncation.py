import pytest

from leafwright.llm import truncation as T

S = "doc_id string, page_num int, attempt_seq int, engine string, text string, reason string"
BODY = "The committee met in the spring and heard a report on the state of the harbour. Several members asked how the new cranes would be paid for. It was agreed that a loan should be sought from the bank. "


def found(spark, rows):
    df = spark.createDataFrame([(d, p, s, e, t, "clash") for d, p, s, e, t in rows], S)
    return {(r.doc_id, r.page_num, r.attempt_seq): r for r in T.truncated_texts(df).collect()}


def filler(n):
    return [("z", i, 1, "y", BODY + f"They then spoke about the committee, the harbour and the bank in the spring of {i}.") for i in range(1, n)]


def test_endings(spark):
    rows = filler(40) + [
        ("a", 1, 1, "x", BODY + "Nobody spoke against the pl"),
        ("a", 9, 1, "x", BODY + "Nobody spoke about the…"),
        ("b", 1, 1, "x", BODY + "Nobody spoke against the harbour of the"), ("b", 2, 1, "x", "committee and the bank. " + BODY), ("b", 1, 2, "y", BODY + "Nobody spoke against the harbour of the"),
        ("c", 1, 1, "x", BODY + "Nobody spoke."), ("c", 2, 1, "x", BODY + "Nobody spoke of the harbour\n\n12"), ("c", 4, 1, "x", BODY + "\n\n• old cranes\n• new cranes"),
        ("d", 1, 1, "x", BODY + "It was agreed that"), ("d", 1, 2, "y", BODY + "It was agreed that a loan should be sought from the bank in the spring, and the meeting closed."),
        ("e", 1, 1, "x", None), ("e", 2, 1, "x", "  "), ("e", 3, 1, None, "kqx vvz ppl mmt rrw qqs xxz wwq zzk ppt"), ("f", None, 1, "x", BODY),
        ("a", 1, 1, "x", BODY + "Nobody spoke against the pl"),
    ]
    out = found(spark, rows)
    assert {k: r.reason for k, r in out.items()} == {("a", 1, 1): "word", ("a", 9, 1): "mark", ("d", 1, 1): "longer reading"}
    assert found(spark, []) == {}


@pytest.mark.parametrize(("name", "odd"), [("chars", ""), ("utf8", "é"), ("json", '"'), ("html", "&"), ("crlf", "\n")])
def test_hidden_limits(spark, name, odd):
    limit = 300
    at = T.ENCODINGS.index(name)
    rows = filler(5)
    for i in range(12):
        text = (BODY.replace(". ", f".{odd if odd == chr(10) else ' '}") + f"{odd} The clerk {odd * i} noted in the spring " + "that the loan of the bank was agreed " * 20).strip()
        while T.lengths(text)[at] > limit:
            text = text[:-1]
        rows.append((f"d{i}", 1, 1, "Cut", text if T.lengths(text)[at] == limit else text + "x"))
    got = found(spark, rows)
    hits = [r for r in got.values() if r.reason == "limit"]
    assert len(hits) >= 8 and {r.limit_encoding for r in hits} == {name} and {r.limit_length for r in hits} == {limit}


def test_lengths():
    assert T.lengths('a"é\n<') == (5, 6, 6, 7, 13)


@pytest.mark.parametrize(("head", "on"), [("of the harbour. It", True), ("Page 3\nof the harbour", True), ("A HEADER\nof the harbour", True), ("34 percent of the members who had been asked agreed", True), ("3 Methods\n\nThe", False), ("The harbour", False), ("", False)])
def test_goes_on(head, on):
    assert T.goes_on(head)[0] == on


@pytest.mark.parametrize("tail", ["<ul><li>a b</li></ul>", "\n\n$$x$$", "\n```\ncode\n```", "\n\n![f](a.png)", "~\\cite{a1}", "\n\n| a | b |\n|---|---|\n| c | 1 |", "</p></div>"])
def test_markup_at_the_end_is_no_ending(tail):
    assert T.ending(BODY + "It was agreed." + tail) is None and T.ending(BODY + "It was agreed that the" + tail)[1] == "the"


def test_long_heads_and_long_words(spark):
    header = "\n".join(f"Annals of the Harbour Society {'X' * i}" for i in range(1, 40))
    assert T.goes_on(header + "\nof the harbour. It")[0] and len(header) > 3 * T.EDGE
    url = "https://harbour.example/" + "a" * 90
    rows = filler(10) + [("u", i, 1, "x", BODY + f"See also {url} for the spring.") for i in range(30, 60)] + [("u", 1, 1, "x", BODY + f"It is to be found at {url}"), ("u", 2, 1, "x", f"and at the bank. {BODY}")]
    assert ("u", 1, 1) not in found(spark, rows)


def test_capitals_within_sentences(spark):
    german = "Der Ausschuss sprach lange über die brauchbare Methode der Häfen. Die Mitglieder fanden die Methode gut und lobten die Methode sehr. "
    rows = [("z", i, 1, "y", german * 3) for i in range(20)] + [("g", 1, 1, "x", german + "Der Ausschuss nannte die brauchbare"), ("g", 2, 1, "x", "Methode nach einer kurzen Pause. " + german), ("h", 1, 1, "x", german + "Der Ausschuss nannte die"), ("h", 2, 1, "x", "Die Mitglieder fanden die Methode gut. " + german)]
    assert {k: r.reason for k, r in found(spark, rows).items()} == {("h", 1, 1): "sentence"}


def test_layers_that_end_alike(spark):
    rows = filler(20) + [("a", 1, 1, "x", BODY + "Nobody spoke about the cranes of the harbour in the spring"), ("b", 1, 1, "x", BODY + "Nobody spoke about the cranes of the harb0ur"), ("c", 1, 1, "x", BODY + "Nobody spoke about the cranes")]
    attempts = spark.createDataFrame([(d, p, s, e, t, "clash") for d, p, s, e, t in rows], S)
    layers = spark.createDataFrame([("a", 1, "A long header of the harbour society\n" + BODY + "Nobody spoke about the cranes of the harbour in the spring"), ("b", 1, BODY + "Nobody spoke about the cranes of the harbour"), ("c", 1, BODY + "Nobody spoke about the cranes of the harbour in the spring."), ("d", 1, None), (None, 1, "x")], "doc_id string, page_num int, native_text string")
    out = {(r.doc_id, r.page_num): r.reason for r in T.truncated_texts(attempts, layers=layers).collect()}
    assert out == {("c", 1): "longer reading"}


@pytest.mark.parametrize("edge", (20, 400))
def test_the_first_look_decides_nothing(spark, monkeypatch, edge):
    monkeypatch.setattr(T, "EDGE", edge)
    rows = filler(20) + [("b", 1, 1, "x", BODY + "Nobody spoke against the harbour of the"), ("b", 2, 1, "x", "THE ANNALS OF THE HARBOUR SOCIETY\n\ncommittee and the bank. " + BODY), ("d", 1, 1, "x", BODY + "It was agreed that"), ("d", 1, 2, "y", BODY + "It was agreed that a loan should be sought from the bank in the spring.")]
    assert {k: r.reason for k, r in found(spark, rows).items()} == {("d", 1, 1): "longer reading"}
