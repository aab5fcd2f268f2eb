import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.functions import audit, distance, pages, text

CLEAN = " ".join(f"This is clean sentence number {i} about the results of the survey." for i in range(30))


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_edit_distance_is_the_plain_one(a, b):
    assert distance.edit_distance(a, b) == slow_distance(a, b) == distance.edit_distance(b, a)


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("ab", "axb", 1), ("axb", "ab", 1), ("ab", "ac", 1), ("", "", 0), ("", "ab", 2)])
def test_edit_distance_known(a, b, d):
    assert distance.edit_distance(list(a), list(b)) == d


def test_error_rates(spark):
    rows = [("alpha bravo", "charlie delta", 1.0), ("", "", 0.0), ("", "a b", 1.0), ("a b", "", 1.0), ("a x c y", "a b c d", 0.5), ("a b c", "a", 2.0)]
    df = spark.createDataFrame(rows, "h string, r string, w double")
    out = df.select("w", distance.error_rate(distance.word_distance("h", "r"), text.word_count(F.col("h")), text.word_count(F.col("r"))).alias("got")).collect()
    assert [r.got for r in out] == [r.w for r in out]


@pytest.mark.parametrize("t", ["", "  ", "a b", "a\u00a0b\x1cc d", "tab\tnew\nline", " x ", "é ü ß", "\x85a\u2003b"])
def test_words_are_pythons(one, t):
    assert one(text.word_count, t) == len(t.split())
    assert one(text.words, t) == t.split()
    assert one(text.strip, t) == t.strip()
    assert one(text.is_blank, t) == (not t.strip())


def test_null_text(one):
    assert one(text.word_count, None) == 0 and one(text.is_blank, None) is True and one(text.structure_count, None) == 0


@pytest.mark.parametrize(
    ("engine", "t", "want"),
    [
        ("deepseek", "<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nBody", "Body"),
        ("GLM", "a<br/>b <b>c</b> [[1, 2, 3, 4]]", "a\nb c"),
        ("mistral", "# OCR Results\n\n**Original File:** x.pdf\n**Processed:** now\nBody", "Body"),
        ("nougat", "\\documentclass[a]{b}\nx\\begin{document}Body\\end{document}\n", "Body"),
        ("marker", "a [MISSING_PAGE_POST:3] b [MISSING_PAGE_EMPTY] c", "a  b  c"),
        ("other", "a\r\nb  \n\n\n\nc \u201cq\u201d \ufb01n \u2014", 'a\nb\n\nc "q" fin --'),
        (None, "<b>stays</b>", "<b>stays</b>"),
    ],
)
def test_normalized(spark, engine, t, want):
    df = spark.createDataFrame([(t, engine)], "t string, e string")
    assert df.select(text.normalized(F.col("t"), F.col("e")).alias("x")).first().x == want


def test_normalized_twice_is_once(spark):
    rows = [(t, e) for t in ("a \u2026 \u00b2\u00a0x", "# OCR Results\n\nx\n\n\ny", "<|x|>\u2018\u2019", "") for e in ("deepseek", "mistral", "x")]
    once = spark.createDataFrame(rows, "t string, e string").withColumn("a", text.normalized(F.col("t"), F.col("e")))
    assert all(r.a == r.b for r in once.withColumn("b", text.normalized(F.col("a"), F.col("e"))).collect())


def test_nfkc(spark):
    words = ["\u00b2", "\ufb01", "e\u0301", "x", None]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "t string").select(text.nfkc("t").alias("x")).collect()]
    assert got == [w and unicodedata.normalize("NFKC", w) for w in words]


def test_cli_text(spark):
    t = "---\na: b\n---\n# OCR Results\n\n**Processed:** now\n\n---\nBody"
    assert spark.createDataFrame([(t,)], "t string").select(text.cli_text(F.col("t"), F.lit("gemini")).alias("x")).first().x == "Body"


def test_phantom_images(one):
    t = "a ![x](figs/1.png) b ![y](https://h/1.png) ![z](data:image/png;base64,AA) ![w](/abs/1.png)"
    assert one(text.without_phantom_images, t) == "a  b ![y](https://h/1.png) ![z](data:image/png;base64,AA) ![w](/abs/1.png)"


def test_markdown_table(spark):
    rows = [["a", None], ["b", " c ", "d"]]
    got = spark.createDataFrame([(rows,), ([],)], "r array<array<string>>").select(text.markdown_table(F.col("r")).alias("x")).collect()
    assert got[0].x == "| a |  |  |\n| --- | --- | --- |\n| b | c | d |" and got[1].x == ""


@pytest.mark.parametrize(("t", "n"), [("# a\n## b", 2), ("| a |\n| b |", 2), ("- a\n* b\n1. c", 3), ("plain\n-", 0)])
def test_structure_count(one, t, n):
    assert one(text.structure_count, t) == n


def test_figure_type(one):
    assert [one(text.figure_type, t) for t in ("A bar CHART", "notable", "heatmap", "nothing")] == ["chart", "table", "map", "unknown"]


def test_responses(spark):
    bodies = [('{"choices": [{"message": {"content": " long enough text "}}]}', 200, "none", "long enough text"), ('{"candidates": [{"content": {"parts": [{"text": "x"}]}}]}', 200, "empty_output", "x"), ("{", 200, "empty_output", ""), (None, 500, "api_error", "")]
    df = spark.createDataFrame([(b, c) for b, c, *_ in bodies], "b string, c int").select(text.response_failure(F.col("c"), F.col("b")).alias("f"), text.response_text(F.col("b")).alias("t"))
    assert [(r.f, r.t) for r in df.collect()] == [(f, t) for *_, f, t in bodies]


def test_file_stem(one):
    assert one(text.file_stem, " a/b:c é.pdf ") == "a_b_c é.pdf"


AUDITS = [
    ("", "empty_output"),
    (None, "empty_output"),
    ("   \n\t  ", "empty_output"),
    ("Hello world this is short", "low_word_count"),
    ("(cid:12) (cid:34) word " * 30, "garbage"),
    ("word " * 60 + "\x01" * 300, "garbage"),
    ("This very sentence is said again and again. " * 20, "hallucination"),
    ("Use a standard font. Include page numbers. Proofread your work. Times New Roman. " + "clean " * 200, "hallucination"),
    ("I'm sorry, I cannot process this image.", "refusal"),
    (CLEAN, "none"),
    (CLEAN * 3 + " I am sorry", "none"),
]


@pytest.mark.parametrize(("t", "failure"), AUDITS)
def test_audit(spark, t, failure):
    r = audit.audited(spark.createDataFrame([(t, "kept")], "t string, note string"), "t").first()
    assert (r.primary_failure, r.passed, r.note) == (failure, failure == "none", "kept")


def test_audit_pages_and_confidence(spark):
    df = spark.createDataFrame([(CLEAN, 10), (CLEAN, 2), (CLEAN, None), ("x " * 10 + "(cid:1)", None)], "t string, p int")
    out = audit.audited(df, "t", F.col("p")).collect()
    assert [r.primary_failure for r in out] == ["truncated", "none", "none", "garbage"]
    assert [r.confidence for r in out] == [0.75, 1.0, 1.0, 0.95]


@pytest.mark.parametrize(("t", "want"), [("aaaaa", ["repeated chars"]), ("the the the", ["repeated words"]), ("abababab", ["alternating patterns"]), ("fine", [])])
def test_repeated_patterns(one, t, want):
    assert one(audit.repeated_patterns, t) == want


def test_page_classes(spark):
    rows = [(1, CLEAN, 4), (2, "Title Page", 1), (3, None, 0), (4, "a b c d e f g h i j k l " * 20, 1), (5, "(cid:3) " + CLEAN, 1), (6, CLEAN + "\ufffd" * 400, 1)]
    out = {r.k: r for r in pages.classified(spark.createDataFrame(rows, "k int, t string, f int"), "t", "f").collect()}
    assert [out[k].reason for k in range(1, 7)] == [None, "chars", "chars", "short_words", "cid", "broken"]
    assert out[1].is_native and out[1].native_confidence == 1.0


def test_document_pages(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", 2, None), ("b", 1, True)], "d string, p int, n boolean")
    out = {r.d: r for r in pages.by_document(df, "d", "p", "n").collect()}
    assert (out["a"].n_pages, out["a"].n_native, out["a"].mixed, out["a"].native_pages) == (2, 1, True, [1]) and out["b"].all_native
    assert pages.by_document(df.limit(0), "d", "p", "n").count() == 0


def test_equations(one):
    assert [one(pages.has_equations, t) for t in (r"\frac{a}{b}", "$$x$$", r"\[ y \]", "costs $5 and $6")] == [True, True, True, False]
