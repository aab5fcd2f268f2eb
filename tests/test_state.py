import pytest

from leafwright.operators import consensus, state

READING = "doc_id string, page_num int, attempt_seq int, engine string, text string, status string, failure_mode string, audit_passed boolean, confidence double"
PAGES = "doc_id string, page_num int, is_born_digital boolean, native_text string, needs_ocr_enhancement boolean"
GOOD = " ".join(f"Sentence number {i} says something new about the matter at hand." for i in range(12))


def readings(spark, rows):
    return spark.createDataFrame([(d, p, s, e, t, "success" if ok is not None else "error", "none", bool(ok), 0.5) for d, p, s, e, t, ok in rows], READING)


def documents(spark, **pages):
    return spark.createDataFrame(list(pages.items()), "doc_id string, n_pages int")


@pytest.mark.parametrize(
    ("page", "attempts", "need"),
    [
        (None, [], True), (None, [False], True), (None, [True], False), (None, [False, True], False),
        ((True, "native", False), [], False), ((True, "native", False), [False], False),
        ((True, "native", True), [], True), ((True, "native", True), [False], False), ((True, "native", True), [True], False),
        ((True, "", True), [], True), ((True, None, False), [], True), ((False, "text of a scanner", False), [], True), ((False, "x", True), [True], False),
    ],
)
def test_need_of_a_reading(spark, page, attempts, need):
    pages = spark.createDataFrame([("a", 1, *page)] * 2 if page else [], PAGES)
    flags = state.flags_of(readings(spark, [("a", 1, i, "x", "t", ok) for i, ok in enumerate(attempts)] * 2))
    out = state.page_states(documents(spark, a=1), pages, flags).collect()
    assert [r.needs_repair for r in out] == [need] and out[0].n_attempts == len(attempts)


def test_unknown_pages_are_left_out(spark):
    pages = spark.createDataFrame([("a", 9, True, "native", False), ("z", 1, True, "native", False)], PAGES)
    out = state.page_states(documents(spark, a=2), pages, state.flags_of(readings(spark, [("a", 3, 1, "x", "t", True), ("a", 2, 1, "x", "t", None)]))).collect()
    assert {(r.doc_id, r.page_num, r.best_seq) for r in out} == {("a", 1, None), ("a", 2, None)}  # an error doesn't pass


def test_latest_documents(spark):
    handles = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", None, 1), ("c", 0, 1)], "doc_id string, page_count int, added_at int")
    pages = spark.createDataFrame([("b", 3), ("a", 9)], "doc_id string, page_num int")
    assert {(r.doc_id, r.n_pages) for r in state.latest_documents(handles, pages).collect()} == {("a", 7), ("b", 3)}
    assert {(r.doc_id, r.n_pages) for r in state.latest_documents(handles).collect()} == {("a", 7)}


def test_scoring(spark):
    rows = [("a", 1, 1, "x", GOOD, True), ("a", 1, 2, "y", "short", True), ("a", 2, 1, "x", "short", True), ("a", 3, 1, "x", GOOD, False), ("a", 4, 1, "x", "short", True), ("a", 0, 1, "x", GOOD, True), ("b", 0, 1, "x", GOOD, True)]
    attempts, docs = readings(spark, rows), documents(spark, a=4, b=31)
    pages = spark.createDataFrame([("a", 4, True, "native", True)], PAGES)
    states = state.page_states(docs, pages, state.flags_of(attempts))
    scored = state.scores(attempts, docs)
    out = {r.page_num: r for r in state.scored_pages(states, scored).where("doc_id = 'a'").collect()}
    # the last reading is scored: page 1 keeps its first, page 2 loses its only one, page 3 gains one, page 4 has a text layer
    assert [out[p].best_seq for p in (1, 2, 3, 4)] == [1, None, 1, 1] and [out[p].needs_repair for p in (1, 2, 3, 4)] == [False, True, False, False]
    assert out[2].failure == "low_word_count"
    multi = {r.page_num: r.best_seq for r in state.scored_pages(states, scored, every=True).where("doc_id = 'a'").collect()}
    assert multi == {1: 1, 2: 1, 3: 1, 4: 1}
    whole = {r.doc_id: (r.status, r.failure) for r in state.scored_documents(attempts, scored).collect()}
    assert whole == {"a": ("success", "none"), "b": ("success", "none")}  # b was read in chunks
    assert {r.doc_id: r.failure for r in state.scores(attempts, documents(spark, a=4, b=30)).where("page_num = 0").collect()} == {"a": "none", "b": "truncated"}


def _texts(spark, docs, rows, pages=()):
    attempts, native = readings(spark, rows), spark.createDataFrame(list(pages), PAGES)
    flags = state.flags_of(attempts)
    states, whole = state.page_states(docs, native, flags), state.whole_states(flags)
    runs = spark.createDataFrame([("a", 1, "X", 0.5, 2.0), ("a", 1, "X", 0.5, 2.0), ("a", 2, "y", 0.25, 1.0)], "doc_id string, run_seq int, engine string, cost double, processing_time double")
    out = state.assembled(docs, states, whole, state.document_texts(state.text_sources(states, whole), attempts, native), runs)
    return {r.doc_id: r for r in out.collect()}


def test_texts_by_precedence(spark):
    native = [("a", 1, True, "n1", False), ("a", 2, True, "n2", True)]
    text = lambda rows, pages=native: _texts(spark, documents(spark, a=3), rows, pages)["a"].text
    rule = "\n\n---\n\n"
    assert text([("a", 0, 1, "x", "w1", True), ("a", 0, 2, "x", "w2", True), ("a", 0, 3, "x", "w3", False)]) == "w2"
    assert text([("a", 0, 1, "x", "w1", False)]) == rule.join(["n1", "n2"])
    assert text([("a", 0, 1, "x", "w1", False), ("a", 0, 2, "x", "w2", False)], []) == "w2"
    assert text([("a", 0, 1, "x", "w1", True), ("a", 2, 1, "x", "p2", True)]) == rule.join(["n1", "p2"])
    assert text([("a", 3, 1, "x", "p3", True), ("a", 1, 1, "x", "bad", False)]) == rule.join(["n1", "n2", "p3"])
    assert text([], []) is None


def test_status(spark):
    docs = documents(spark, a=1, b=1, c=1, d=2)
    out = _texts(spark, docs, [("a", 1, 1, "x", "t", True), ("b", 0, 1, "x", "t", False), ("c", 1, 1, "x", None, None), ("d", 0, 1, "x", "whole", True)])
    assert {k: (r.status, r.pages_ok) for k, r in out.items()} == {"a": ("success", True), "b": ("audit_failed", False), "c": ("error", False), "d": ("success", True)}
    assert (out["a"].engines, out["a"].cost, out["a"].processing_time) == (["x", "y"], 0.75, 3.0) and out["b"].engines == []
    assert _texts(spark, docs.limit(0), []) == {}


def test_consensus(spark):
    rows = [("a", 1, 1, "x", "one two", False), ("a", 1, 2, "y", "one two three four", False), ("a", 2, 1, "x", "", None), ("a", 2, 2, "y", None, None), ("a", 3, 1, "x", "native too", True), ("a", 3, 2, "y", "native", True), ("a", 4, 1, "x", "only", True), ("a", 4, 2, "y", " ", True), ("a", 0, 1, "x", "alpha beta gamma", True), ("a", 0, 2, "y", "n3 text layer and more of it " * 4, True), ("a", 0, 3, "z", "n3 text layer", False)]
    attempts, docs = readings(spark, rows), documents(spark, a=5)
    native = spark.createDataFrame([("a", 3, True, "n3 text layer", False)], PAGES)
    flags = state.flags_of(attempts)
    states, whole = state.page_states(docs, native, flags), state.whole_states(flags)
    winners = state.consensus_winners(attempts, states, whole, native)
    out = {r.page_num: r for r in winners.collect()}
    assert set(out) == {0, 1, 2, 4}
    assert (out[1].engine, out[1].any_passed) == ("consensus(y)", False) and out[1].agreement == 0.5
    assert (out[2].attempt_seq, out[2].agreement) == (1, 0.0) and out[2].note and not out[1].note
    assert (out[4].engine, out[4].agreement, out[4].n_viable) == ("consensus(x)", 1.0, 1)
    assert out[0].engine == "consensus(z)"  # nearest to the text layer
    on_page, on_whole = state.after_consensus(states, whole, winners)
    assert {r.page_num: r.needs_repair for r in on_page.collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert on_whole.first().passing_seq == 3


@pytest.mark.parametrize("most", (1, 64))
def test_agreement_of_pages_of_any_size(spark, monkeypatch, most):
    texts = ["the dog bit the man", "the man bit the dog", "THE dog bit the man", "", None, "entirely other words here now then"]
    df = readings(spark, [("a", 1, i, "x", t, True) for i, t in enumerate(texts)] * 2 + [("a", 2, 1, "x", "alone", True)])
    want = consensus.mean_agreement(texts)
    monkeypatch.setattr(consensus, "MOST_READINGS", most)
    assert {r.page_num: round(r.agreement, 9) for r in consensus.agreement(df).collect()} == {1: round(want, 9), 2: 1.0}


def test_arbiter(spark):
    df = readings(spark, [("a", 1, 1, "x", "one", True), ("a", 1, 2, "y", "one two", True), ("a", 2, 1, "x", "alone", True), ("a", 3, 1, "x", "bad", True), ("a", 3, 2, "y", "bad two", True)])

    def ask(prompt):
        if "bad" in prompt:
            raise OSError("gone")
        return 'Chosen: {"selected": 2, "text": "one, two"}'

    assert {r.page_num: (r.engine, r.text) for r in consensus.arbitrated(df, ask).collect()} == {1: ("x", "one, two"), 2: ("x", "alone"), 3: ("y", "bad two")}


def test_messages(spark):
    df = readings(spark, [("a", 1, 1, "x", "a b c d", True), ("a", 1, 2, "y", "a b", False), ("a", 2, 1, "x", "a", True)])
    out = {r.page_num: r.messages for r in consensus.discrepancies(df).collect()}
    assert out == {1: ["Word count spread: x=4, y=2", "Audit divergence: passed=[x], failed=[y]"], 2: []}


def test_figure_contexts(spark):
    df = readings(spark, [("a", 1, 1, "x", "p" * 600, True), ("a", 0, 1, "x", "", True), ("a", 0, 2, "x", "whole", True)])
    states = state.page_states(documents(spark, a=2, b=1), spark.createDataFrame([], PAGES), state.flags_of(df))
    figures = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "doc_id string, page_num int, figure_num int")
    assert {(r.doc_id, r.page_num): r.context for r in state.figure_contexts(figures, states, df).collect()} == {("a", 1): "p" * 500, ("a", 2): "whole", ("b", 1): ""}
