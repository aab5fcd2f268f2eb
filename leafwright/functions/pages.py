"""Whether a page carries a text layer of its own, and what its document looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import mean_word_length
from .text import SPACE, markdown_table, strip, word_count

# TeX commands that mean mathematics.
MATH = (
    r"\\(?:frac|sum|int|prod|lim|infty|partial|nabla|alpha|beta|gamma|delta|epsilon|theta|lambda|sigma|omega|begin\{(?:equation|align|gather|math|displaymath)\})"
)


def broken_ratio(text: Column) -> Column:
    """Control, replacement and private-use characters over the length."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}\x{e000}-\x{f8ff}]")) / n).otherwise(0.0)


def blank_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(f"[{SPACE}]")) / n).otherwise(0.0)


def has_equations(text: Column) -> Column:
    return text.rlike(MATH) | text.rlike(r"(?s)\$\$.+?\$\$") | text.rlike(r"(?s)\\\[.+?\\\]")


def classified(df: DataFrame, text: str, fonts: str | None = None, min_chars: int = 50, min_words: int = 15, max_broken: float = 0.05) -> DataFrame:
    """df with is_native, native_confidence and reason, by the first rule that fits.  Null counts as empty.

    The reason is one of chars, words, cid, broken, blanks, short_words, long_words; null for a native page.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stripped = F.length(F.regexp_replace(body, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    font = F.coalesce(F.col(fonts), F.lit(0)) if fonts else F.lit(0)
    df = df.withColumns({"_c": stripped, "_w": word_count(body), "_b": broken_ratio(body), "_s": blank_ratio(body), "_m": mean_word_length(body)})
    c, w, b, s, m = (F.col(x) for x in ("_c", "_w", "_b", "_s", "_m"))
    rules = (("chars", c < min_chars, 0.95), ("words", w < min_words, 0.85), ("cid", body.rlike(r"\(cid:\d+\)"), 0.95), ("broken", b > max_broken, 0.80), ("blanks", s > 0.60, 0.75), ("short_words", m < 2.5, 0.70), ("long_words", m > 20, 0.70))
    reason, sure = F.when(rules[0][1], rules[0][0]), F.when(rules[0][1], rules[0][2])
    for name, rule, p in rules[1:]:
        reason, sure = reason.when(rule, name), sure.when(rule, p)
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    native = 0.80 + plus(w > 100, 0.05) + plus(w > 300, 0.05) + plus(b < 0.01, 0.03) + plus(font >= 2, 0.03) + plus(font >= 4, 0.02) + plus(m.between(3.5, 7.0), 0.02)
    out = df.withColumns({"reason": reason, "native_confidence": F.round(sure.otherwise(F.least(native, F.lit(1.0))), 6)})
    return out.withColumn("is_native", F.col("reason").isNull()).drop("_c", "_w", "_b", "_s", "_m")


def enhanced(native: str, tables: str, figures: str, equations: str) -> Column:
    """A native page whose tables, figures or equations its text layer may not show."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flag(native) & (flag(tables) | flag(figures) | flag(equations))


def by_document(pages: DataFrame, doc: str, page: str, native: str) -> DataFrame:
    """doc, n_pages, n_native, all_native, none_native, mixed, native_pages; pages that occur twice count once."""
    one = pages.groupBy(doc, page).agg(F.max(F.coalesce(F.col(native), F.lit(False))).alias("n"))
    n = F.col("n")
    out = one.groupBy(doc).agg(F.count("*").alias("n_pages"), F.count_if(n).alias("n_native"), F.bool_and(n).alias("all_native"), F.bool_and(~n).alias("none_native"), F.sort_array(F.collect_list(F.when(n, F.col(page)))).alias("native_pages"))
    return out.withColumn("mixed", ~F.col("all_native") & ~F.col("none_native"))


def has_tables(text: Column) -> Column:
    """A stand-in where nothing looked for tables on the page: a row of cells with the rule of a table's head below it."""
    return F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*\|.*\|\s*$\n^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")


def structured_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_num, text of each page with text: its blocks of text in their order, tables as Markdown in place of the blocks they cover.

    blocks: doc_id, page_num, block_id, x0, y0, x1, y1, lines (null for an image); tables: doc_id, page_num, x0, y0, x1, y1,
    rows.  A table comes before the first block that doesn't begin above it, or last.  Empty tables cover nothing.
    """
    page = ["doc_id", "page_num"]
    corners = ["x0", "y0", "x1", "y1"]
    found = tables.withColumn("md", markdown_table(F.col("rows"))).where("md <> ''").groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "md"))).alias("t"))
    held = blocks.where("lines is not null").groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("block_id", *corners, "lines"))).alias("b"))  # a page's blocks
    both = held.join(found, page, "full").select(*page, F.coalesce("b", F.array().cast(held.schema["b"].dataType)).alias("b"), F.coalesce("t", F.array().cast(found.schema["t"].dataType)).alias("t"))
    covered = lambda b: F.exists("t", lambda t: (b["x0"] < t["x1"]) & (t["x0"] < b["x1"]) & (b["y0"] < t["y1"]) & (t["y0"] < b["y1"]))
    tables_at = lambda i, b: F.filter("t", lambda t: (t["y0"] <= b["y0"]) & ~F.exists(F.slice("b", 1, i), lambda e: t["y0"] <= e["y0"]))
    lines = lambda b: F.filter(F.transform(b["lines"], lambda x: F.trim(x)), lambda x: x != "")
    as_text = lambda ts: F.transform(ts, lambda t: F.concat(F.lit("\n"), t["md"], F.lit("\n")))
    none = F.array().cast("array<string>")
    body = F.flatten(F.transform("b", lambda b, i: F.concat(as_text(tables_at(i, b)), F.when(covered(b), none).otherwise(lines(b)))))
    rest = as_text(F.filter("t", lambda t: ~F.exists("b", lambda b: t["y0"] <= b["y0"])))
    return both.select(*page, strip(F.array_join(F.concat(body, rest), "\n")).alias("text")).where("text <> ''")


def one_page(assessments: DataFrame, doc_id, page_num: int) -> DataFrame:
    """The row of a page; a page that the document doesn't have is an error."""
    row = assessments.where((F.col("doc_id") == doc_id) & (F.col("page_num") == page_num)).limit(1)
    if row.isEmpty():
        raise ValueError(f"no page {page_num} of {doc_id}")
    return row
