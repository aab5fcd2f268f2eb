"""Per-document text quality statistics: natural prose told from lists, tables and junk, and wrong stored counts.

Each statistic has a mergeable quantile sketch (KLL) per language; texts without a known language are held against the
merged sketch of all.  Values become robust z-scores (distance from the median in quartile ranges), and the tails are
flagged; where many texts are tables the range is as wide as they are, so there the tails only rank.  Whether a text is prose
is settled for every text by counting the words that stand in sentences.  A text in a language whose function words aren't
known, and too short to show its own, can't be settled so: statistics that no language's words enter (FREE) are held
against the merged sketches of the texts that are prose, which tables and lists can't widen, and its tails decide.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, per_row
from .prose import ANY_FUNCTION_WORD, language_of, prose_share, shows_too_little, words_of
from .repetition import collapsed

STATISTICS = ("mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words")
#: From how many robust standard deviations a value lies in the tail, and which tails tell against prose.
TAIL = 2.0
BAD = {"mean_word_length": (True, True), "symbol_ratio": (False, True), "digit_ratio": (False, True), "punctuated_lines": (True, False), "common_words": (True, False)}
#: Statistics that need no known words, and which of their tails tell against prose.
#: Short words are those of two and three letters.
FREE = {"mean_word_length": (False, True), "symbol_ratio": (False, True), "digit_ratio": (False, True), "vowel_ratio": (True, False), "short_words": (True, False)}
#: Accuracy of the sketches.
SKETCH_K = 400
#: A quartile range below this counts as this.
LEAST_RANGE = 0.01

_NOT_WORDS = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýąęěıőűůœāēīōū"


def statistics(text: str | None) -> tuple | None:
    """language, n_words, n_chars and STATISTICS; None for null, empty and blank texts."""
    if not text or not text.strip():
        return None
    tokens = words_of(text)
    n, size = len(tokens), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip().endswith((".", "!", "?", ":", ";", "…", '"', "”", "»")) for x in lines)
    symbols, digits = len(_NOT_WORDS.findall(text)), len(_DIGIT.findall(text))
    common = sum(t in ANY_FUNCTION_WORD for t in tokens)
    return language_of(tokens), n, size, sum(map(len, tokens)) / n, symbols / size, digits / size, ended / len(lines), common / n


def text_statistics(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, language, n_words, n_chars, STATISTICS, a z_... for each of them, tails (how many lie in a tail that tells against prose).

    Null, empty and blank texts give no row, nor do rows with a null in a key.  Equal keys come out once.  A language with a single text has the z-score 0 in
    all statistics.  Texts of any length are read whole; an empty table gives an empty result.
    """
    fields = [("language", "string"), ("n_words", "int"), ("n_chars", "int"), *((s, "double") for s in STATISTICS)]
    rows = checkpoint(per_row(df.dropna(subset=keys), keys, [text], lambda: statistics, fields).dropDuplicates(keys))
    by_language = rows.groupBy("language").agg(*[F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in STATISTICS])
    merged = by_language.agg(F.lit("und").alias("language"), *[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS])
    sketches = by_language.where("language <> 'und'").unionByName(merged)
    quantile = lambda s, q: F.kll_sketch_get_quantile_double(s, F.lit(q))
    typical = sketches.select(
        "language",
        *[quantile(s, 0.5).alias(f"mid_{s}") for s in STATISTICS],
        *[F.greatest((quantile(s, 0.75) - quantile(s, 0.25)) / 1.349, F.lit(LEAST_RANGE)).alias(f"range_{s}") for s in STATISTICS],
    )
    # One row for each language in prose.LANGUAGES and "und": small whatever the table.
    scored = rows.join(F.broadcast(typical), "language", "left")
    z = {s: (F.col(s) - F.col(f"mid_{s}")) / F.col(f"range_{s}") for s in STATISTICS}
    scored = scored.withColumns({f"z_{s}": z[s] for s in STATISTICS})
    tails = [F.when(low & (F.col(f"z_{s}") < -TAIL) | F.lit(high) & (F.col(f"z_{s}") > TAIL), 1).otherwise(0) for s, (low, high) in ((s, (F.lit(a), b)) for s, (a, b) in BAD.items())]
    return scored.withColumn("tails", sum(tails[1:], tails[0])).select(*keys, *[n for n, _ in fields], *[f"z_{s}" for s in STATISTICS], "tails")


def is_prose(text: str) -> bool:
    """At least half of the words stand in sentences; what is said over and over counts once.  Markup and page numbers don't count."""
    inside, total, _ = prose_share(text)
    if 2 * inside < total:
        inside, total, _ = prose_share(collapsed(text))
    return 2 * inside >= total > 0


def not_prose(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and language of the texts that are lists, tables or junk: all texts are checked, whatever their statistics.

    Texts that show too little of an unknown language are cases if one of FREE lies in a tail that tells against prose, by
    the sketches of all texts that are prose, or if there are none.  Null, empty and blank texts aren't cases, nor are rows
    with a null in a key.  Equal keys come out once.
    """

    def check(t: str | None) -> tuple | None:
        if not t or not t.strip():
            return None
        tokens, prose = words_of(t), is_prose(t)
        open_ = not prose and shows_too_little(t)
        return language_of(tokens), prose, open_, *(free_statistics(t, tokens) if prose or open_ else (None,) * len(FREE))

    fields = [("language", "string"), ("_prose", "boolean"), ("_open", "boolean"), *((f"_{s}", "double") for s in FREE)]
    rows = checkpoint(per_row(df.dropna(subset=keys), keys, [text], lambda: check, fields))
    by_language = rows.where("_prose").groupBy("language").agg(*[F.kll_sketch_agg_double(f"_{s}", F.lit(SKETCH_K)).alias(s) for s in FREE])
    merged = by_language.agg(F.count("*").alias("n"), *[F.kll_merge_agg_double(s).alias(s) for s in FREE]).where("n > 0")
    quantile = lambda s, q: F.kll_sketch_get_quantile_double(s, F.lit(q))
    typical = merged.select(*[quantile(s, 0.5).alias(f"_mid_{s}") for s in FREE], *[F.greatest((quantile(s, 0.75) - quantile(s, 0.25)) / 1.349, F.lit(LEAST_RANGE)).alias(f"_range_{s}") for s in FREE])
    z = {s: (F.col(f"_{s}") - F.col(f"_mid_{s}")) / F.col(f"_range_{s}") for s in FREE}
    outside = [F.lit(low) & (z[s] < -TAIL) | F.lit(high) & (z[s] > TAIL) for s, (low, high) in FREE.items()]
    # At most one row.
    held = rows.where("_open").join(F.broadcast(typical), how="left").where(F.coalesce(F.greatest(*outside), F.lit(True)))
    return rows.where("not _prose and not _open").select(*keys, "language").unionByName(held.select(*keys, "language")).dropDuplicates(keys)


def free_statistics(text: str, tokens: list[str]) -> tuple[float, ...]:
    """FREE of a text that isn't blank, with its tokens."""
    words = [t for t in tokens if t.isalpha()]
    letters = "".join(words)
    n, size = max(1, len(words)), len(text)
    return len(letters) / n, len(_NOT_WORDS.findall(text)) / size, len(_DIGIT.findall(text)) / size, sum(map(letters.count, _VOWELS)) / max(1, len(letters)), sum(1 < len(t) <= 3 for t in words) / n


def wrong_counts(df: DataFrame, keys: list[str], text: str, n_words: str, n_chars: str) -> DataFrame:
    """keys, true_words, true_chars of the non-empty texts whose stored number of words or characters isn't null and is wrong.

    Words are separated by white space, characters are code points.  Equal keys come out once.
    """
    picked = df.select(*keys, F.col(text).alias("_t"), F.col(n_words).cast("bigint").alias("_w"), F.col(n_chars).cast("bigint").alias("_c")).where("_t <> '' and (_w is not null or _c is not null)")

    def compare(t: str, w: int | None, c: int | None) -> tuple | None:
        words, chars = len(t.split()), len(t)
        return (words, chars) if w is not None and w != words or c is not None and c != chars else None

    return per_row(picked, keys, ["_t", "_w", "_c"], lambda: compare, [("true_words", "int"), ("true_chars", "int")]).dropDuplicates(keys)
