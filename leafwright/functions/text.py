"""Column functions on text: words, normalisation, structure, tables, file names, response parsing."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it, as a class for Java's and for RE2's expressions.
SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{SPACE}]+"

# Engines whose texts carry grounding tags, and typographic characters with their plain forms.
GROUNDED = ("deepseek", "deepseek-vllm", "glm")
PLAIN = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "--", "\u2026": "...",
    "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb00": "ff",
}
# Substrings that name a figure's type, in order of precedence.
FIGURE_TYPES = {
    "chart": ("bar chart", "pie chart", "chart"), "graph": ("line graph", "scatter plot", "graph", "plot"), "table": ("table", "tabular"),
    "diagram": ("diagram", "flowchart", "schematic", "architecture"), "map": ("map", "geographic", "spatial"), "equation": ("equation", "formula", "mathematical"),
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body and lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def _drop(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def without_grounding(text: Column) -> Column:
    """Less reference and detection tags, other engine tags, boxes and HTML tags; <br> becomes a newline."""
    text = _drop(text, r"<\|ref\|>.*?<\|/ref\|>", r"<\|det\|>\[\[.*?\]\]<\|/det\|>", r"<\|[^|]+\|>", r"\[\[\d+,\s*\d+,\s*\d+,\s*\d+\]\]")
    return _drop(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>")


def without_header(text: Column) -> Column:
    """Less a results heading at the start and lines of file metadata."""
    return _drop(text, r"^#\s*OCR Results\s*\n+", r"(?m)^\*\*(?:Original File|Full Path|Processed|Processing Time):\*\*[^\n]*\n?")


def without_preamble(text: Column) -> Column:
    return _drop(text, r"(?s)^\\documentclass(?:\[.*?\])?\{.*?\}(?:.*?\\begin\{document\})?", r"\\end\{document\}\s*$")


def without_page_markers(text: Column) -> Column:
    return _drop(text, r"\[MISSING_PAGE_(?:POST|EMPTY)(?::\w+)?\]")


def engine_text(text: Column, engine: Column) -> Column:
    """The text less what its engine adds; engines are compared in lower case."""
    e = F.lower(engine)
    return (
        F.when(e.isin(*GROUNDED), without_grounding(text))
        .when(e == "mistral", without_header(text))
        .when(e == "nougat", without_preamble(text))
        .when(e == "marker", without_page_markers(text))
        .otherwise(text)
    )


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no expression for."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def tidy(text: Column) -> Column:
    """Newlines, plain punctuation, no blanks at line ends, at most one blank line, nothing around."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), PLAIN.items(), text)
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def normalized(text: Column, engine: Column) -> Column:
    """engine_text, NFKC where a text has other than ASCII characters, tidy.  Null and empty texts stay as they are."""
    cleaned = F.regexp_replace(engine_text(text, engine), r"\r\n?", "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(tidy(nfkc(cleaned)))


def cli_text(text: Column, engine: Column) -> Column:
    """Output of a command-line engine: less YAML front matter and a metadata block, then normalized."""
    parts = F.split(text, "---", 3)
    text = F.when(text.startswith("---") & (F.size(parts) >= 3), strip(F.element_at(parts, 3))).otherwise(text)
    block = r"^#\s*OCR Results\s*\n+(?:\*\*(?:Original File|Full Path|Processed|Processing Time):\*\*[^\n]*\n)+\s*(?:---\s*\n)?"
    return normalized(strip(F.regexp_replace(text, block, "")), engine)


def without_phantom_images(text: Column) -> Column:
    """Less image references other than to the web, to inline data and to absolute paths."""
    less = F.regexp_replace(text, r"!\[[^\]]*\]\((?!\s*(?:https?://|data:|/))[^)]+\)", "")
    return F.when(text.contains("!["), F.regexp_replace(less, r"\n{3,}", "\n\n")).otherwise(text)


def file_stem(name: Column) -> Column:
    """Letters, digits, dots, underscores, blanks and hyphens stay, others become underscores."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "_"))


def latex_plain(block: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(strip(block), r"\s+", " "), F.lit(r"\ "), F.lit(" ")), F.lit(r"\,"), F.lit(" "))


def structure_count(text: Column) -> Column:
    """Lines that are headings, table rows or list entries."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), strip)
    return F.size(F.filter(lines, lambda x: x.rlike(r"^(?:#|\|.*\|$|[-*+]\s|\d+\.\s)")))


def markdown_table(rows: Column) -> Column:
    """rows: array of arrays of cells.  Null cells are empty, short rows are filled up; the first row is the head."""
    return F.when(F.size(rows) > 0, let(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: _table(rows, width))).otherwise("")


def _table(rows: Column, width: Column) -> Column:
    cells = lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.trim(F.get(r, i - 1)), F.lit("")))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    body = F.transform(rows, lambda r: line(cells(r)))
    return let(body, lambda b: F.array_join(F.concat(F.slice(b, 1, 1), F.array(rule), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))), "\n"))


def figure_type(description: Column, default: str | None = "unknown") -> Column:
    d = F.lower(description)
    named = [F.when(reduce(lambda a, b: a | b, [d.contains(w) for w in words_]), t) for t, words_ in FIGURE_TYPES.items()]
    return F.coalesce(*named, F.lit(default).cast("string"))


def response_text(body: Column) -> Column:
    """The text in a model's JSON response, of either of two shapes; empty where there is none."""
    return F.trim(F.coalesce(F.get_json_object(body, "$.candidates[0].content.parts[0].text"), F.get_json_object(body, "$.choices[0].message.content"), F.lit("")))


def response_failure(status_code: Column, body: Column) -> Column:
    """none, api_error or empty_output of an HTTP response."""
    return F.when(F.coalesce(status_code, F.lit(0)) != 200, "api_error").when(F.length(response_text(body)) < 10, "empty_output").otherwise("none")


def pages_of(text: Column) -> Column:
    """The parts of a whole document's text between page rules; blank parts keep their number but are left out."""
    parts = F.split(text, r"\n\n---\n\n", -1)
    return F.filter(F.transform(parts, lambda t, i: F.struct((i + 1).alias("page_num"), t.alias("text"))), lambda s: ~is_blank(s["text"]))
