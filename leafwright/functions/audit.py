"""Heuristic audit of extracted text: metrics, failure modes, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, is_blank, let, strip, word_count, words

# What models say when they refuse, and what they make up about formatting.
REFUSALS = (
    "I cannot read", "I am sorry", "I'm sorry", "As an AI", "I'm unable to", "cannot process this image", "I cannot assist", "I can't read",
    "unable to extract", "cannot extract text",
)
FORMATTING = (
    r"Use a standard font", r"print on \d+\.?\d*\s*[x×]\s*\d+", r"Include (?:all )?(?:figures|tables|links|references)", r"Include links to other resources",
    r"Include page numbers", r"Include captions", r"Proofread your work", r"double[- ]spaced", r"single[- ]spaced", r"Times New Roman",
    r"formatting guidelines", r"submission guidelines", r"page margins",
)
# Without one of these, in lower case, no pattern of FORMATTING fits; the last two have case forms of their own.
FORMATTING_ANCHORS = (
    "standard font", "print on", "include all", "include figures", "include tables", "include links", "include references", "include page numbers", "include captions",
    "proofread", "spaced", "times new roman", "guidelines", "page margins", "\u017f", "\u212a",
)
# Failure modes by rising priority.
PRIORITY = ("low_word_count", "garbage", "truncated", "empty_output", "refusal", "hallucination")
# What a failing metric stands for.
MODE_OF = {"empty": "empty_output", "refusal": "refusal", "cid": "garbage", "loops": "hallucination", "formatting": "hallucination", "word_count": "low_word_count", "truncation": "truncated", "garbage": "garbage"}
NOT_GARBAGE = rf"\p{{L}}\p{{N}}_{SPACE}.,!?;:'\"()\[\]{{}}<>@#$%&*+=/\\\-"


def refuses(text: Column, n_words: Column | None = None) -> Column:
    """A refusal anywhere in a text of fewer than 200 words, or in the first 500 characters of a longer one."""
    return F.when((word_count(text) if n_words is None else n_words) < 200, text).otherwise(F.substring(text, 1, 500)).rlike("(?iu)" + "|".join(REFUSALS))


def loops(text: Column) -> Column:
    """A sentence of at least 20 characters three times running, in a text of at least six."""
    parts = F.transform(F.split(text, rf"[.!?][{SPACE}]+", -1), strip)
    again = lambda p: F.exists(F.sequence(F.lit(0), F.size(p) - 3), lambda i: (F.length(F.get(p, i)) >= 20) & (F.get(p, i) == F.get(p, i + 1)) & (F.get(p, i) == F.get(p, i + 2)))
    return let(parts, lambda p: F.when(F.size(p) >= 6, again(p)).otherwise(False))


def formatting_patterns(text: Column) -> Column:
    """How many patterns fit; the expressions run only on texts that have a word of theirs."""
    lower = F.lower(text)
    near = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in FORMATTING_ANCHORS])
    return F.when(near, reduce(lambda a, b: a + b, [text.rlike(f"(?iu){p}").cast("int") for p in FORMATTING])).otherwise(0)


def garbage_ratio(text: Column) -> Column:
    """Unusual characters and runs of four or more blanks over the length."""
    n = F.length(text)
    found = F.regexp_count(text, F.lit(f"[^{NOT_GARBAGE}]")) + F.regexp_count(text, F.lit(f"[{SPACE}]{{4,}}"))
    return F.when(n > 0, found / n).otherwise(0.0)


def math_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, "\\{}^_$", ""))) / n).otherwise(0.0)


def mean_word_length(text: Column) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(0.0))


def unicode_issues(text: Column) -> Column:
    checks = (("replacement chars", r"\x{fffd}"), ("private use chars", r"[\x{e000}-\x{f8ff}]"), ("control chars", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in checks]))


def repeated_patterns(text: Column) -> Column:
    checks = (("repeated chars", r"(.)\1{4,}"), ("repeated words", r"(?iu)\b([\p{L}\p{N}_]+)\s+\1\s+\1\b"), ("alternating patterns", r"(..)\1{3,}"))
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in checks]))


def has_structure(text: Column) -> Column:
    return text.rlike(r"(?m)^#+\s+[\p{L}\p{N}_]") | text.rlike(r"(?m)^\d+\.\s+[\p{L}\p{N}_]") | text.rlike(r"(?m)^[-*•]\s+[\p{L}\p{N}_]") | (F.size(F.split(text, "\n\n", -1)) > 2)


# What the details say of each failing metric, and the names of the metrics that warn.
DETAILS = {
    "empty": "No text extracted from document", "refusal": "Model refused to process the input", "cid": "PDF font mapping failures (CID references)",
    "loops": "Repeated sentence patterns indicate model hallucination loop", "formatting": "Model hallucinated formatting instructions instead of OCR output",
    "word_count": "Extracted text has too few words", "truncation": "Output appears truncated relative to document page count", "garbage": "High ratio of non-text characters",
}
VALUES = {"empty": "No text extracted", "refusal": "Model refused to process image", "cid": "PDF font mapping failures detected", "loops": "Repeated sentence patterns detected"}
WARNINGS = {"mean_word_length": "Avg word length", "unicode": "Unicode issues", "patterns": "Repeated patterns"}


def measured(df: DataFrame, text: str, min_words: int = 50, max_garbage: float = 0.15, shortest: float = 2.0, longest: float = 15.0) -> DataFrame:
    """df with what the text alone tells: n_words, mean_word_length, garbage_ratio, n_formatting, unicode_issues, patterns, failing, warnings.

    failing: the metrics that fail, in their order, truncation aside; "empty" and "refusal" stand alone.  Narrow columns in
    one pass over the texts: take these, not the texts, through joins and aggregations, and ``judged`` after them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"n_words": word_count(body), "garbage_ratio": garbage_ratio(body), "mean_word_length": mean_word_length(body), "_blank": is_blank(body), "n_formatting": formatting_patterns(body)})
    df = df.withColumns({"_refusal": ~F.col("_blank") & refuses(body, F.col("n_words")), "unicode_issues": unicode_issues(body), "patterns": repeated_patterns(body)})
    checks = {
        "cid": body.rlike(r"\(cid:\d+\)"),
        "loops": loops(body),
        "formatting": F.col("n_formatting") >= 2,
        "word_count": F.col("n_words") < min_words,
        "garbage": (F.col("garbage_ratio") > max_garbage) & (math_ratio(body) <= 0.3),
    }
    failing = F.when(F.col("_blank"), F.array(F.lit("empty"))).when(F.col("_refusal"), F.array(F.lit("refusal"))).otherwise(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()])))
    soft = {"mean_word_length": ~F.col("mean_word_length").between(shortest, longest), "unicode": F.size("unicode_issues") > 0, "patterns": F.size("patterns") > 0}
    warnings = F.when(F.col("_blank") | F.col("_refusal"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(c, k) for k, c in soft.items()])))
    return df.withColumns({"failing": failing, "warnings": warnings}).drop("_blank", "_refusal")


def judged(df: DataFrame, expected_pages: Column | None = None) -> DataFrame:
    """df (see measured) with errors, passed, modes, primary_failure, confidence; failing goes.

    Without expected pages, and for 5 or fewer, truncation isn't checked.  modes are in the order of the metrics, each once;
    primary_failure is the one of the highest priority.
    """
    alone = F.array_contains("failing", "empty") | F.array_contains("failing", "refusal")
    errors = F.col("failing")
    if expected_pages is not None:
        pages = F.coalesce(expected_pages, F.lit(0))
        short = ~alone & (pages > 5) & (F.col("n_words") > 0) & (F.col("n_words") / pages < 100)
        last = F.array(F.lit("garbage"))
        errors = F.when(short, F.concat(F.array_except("failing", last), F.array(F.lit("truncation")), F.array_intersect("failing", last))).otherwise(F.col("failing"))
    df = df.withColumn("errors", errors).drop("failing")
    mode = F.create_map(*[F.lit(x) for kv in MODE_OF.items() for x in kv])
    df = df.withColumn("modes", F.array_distinct(F.transform("errors", lambda e: mode[e])))
    rank = lambda m: F.array_position(F.array(*map(F.lit, PRIORITY)), m)
    primary = F.aggregate("modes", F.lit("none"), lambda a, m: F.when(rank(m) > F.when(a == "none", 0).otherwise(rank(a)), m).otherwise(a))
    e, w = F.size("errors"), F.size("warnings")
    confidence = F.when(e >= 2, 0.95).when((e == 1) & (w >= 1), 0.85).when(e == 1, 0.75).otherwise(1.0)
    return df.withColumns({"passed": e == 0, "primary_failure": primary, "confidence": confidence})


def audited(df: DataFrame, text: str, expected_pages: Column | None = None, **limits) -> DataFrame:
    """measured and judged; null counts as empty.  limits: those of measured."""
    return judged(measured(df, text, **limits), expected_pages)


def details(expected_pages: Column | None = None) -> Column:
    """Map of failure mode -> what failed and its value, of a judged row; of several metrics of a mode the last holds."""
    pages = F.coalesce(expected_pages, F.lit(0)) if expected_pages is not None else F.lit(0)
    number = lambda c: c.cast("bigint").cast("string")
    value = {k: F.lit(v) for k, v in VALUES.items()} | {
        "formatting": F.concat(F.col("n_formatting").cast("string"), F.lit(" formatting instruction patterns detected")),
        "word_count": F.col("n_words").cast("string"),
        "truncation": F.concat(number(F.bround(F.col("n_words") / pages, 0)), F.lit(" words/page ("), F.col("n_words").cast("string"), F.lit(" words / "), number(pages), F.lit(" pages)")),
        "garbage": F.format_string("%.1f%%", F.col("garbage_ratio") * 100),
    }
    entries = [F.when(F.array_contains("errors", k), F.struct(F.lit(MODE_OF[k]).alias("key"), F.concat(F.lit(f"{DETAILS[k]} ("), value[k], F.lit(")")).alias("value"))) for k in MODE_OF]
    held = F.array_compact(F.array(*entries))
    # the last of each mode: no later entry has its key
    kept = F.filter(held, lambda x, i: ~F.exists(F.slice(held, i + 2, F.size(held)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"])))


def messages() -> Column:
    """The warnings of a measured row as "name: value"."""
    value = {"mean_word_length": F.format_string("%.1f", F.col("mean_word_length")), "unicode": F.array_join("unicode_issues", ", "), "patterns": F.concat(F.size("patterns").cast("string"), F.lit(" suspicious patterns"))}
    return F.array_compact(F.array(*[F.when(F.array_contains("warnings", k), F.concat(F.lit(f"{n}: "), value[k])) for k, n in WARNINGS.items()]))
