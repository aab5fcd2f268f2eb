"""Formulas of one reading merged into another."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What displayed formulas, environments and inline formulas look like.
_DISPLAY = re.compile(r"\$\$([^$]+)\$\$")
_ENVIRONMENT = re.compile(r"\\begin\{(equation|align|gather|multline)\*?\}(.+?)\\end\{\1\*?\}", re.S)
_INLINE = re.compile(r"(?<!\$)\$(?!\$)([^$]+)\$(?!\$)")
_TOKEN = re.compile(r"\\?\w+")
# Phrases after which a formula is put, in order of precedence.
_CUES = tuple(re.compile(p, re.I) for p in (r"equation\s*\(\d+\)", r"formula\s*\(\d+\)", "as follows:", "given by:", "defined as:", "where:"))
#: Share of common tokens from which two formulas are the same.
SAME = 0.6


def plain(formula: str) -> str:
    return re.sub(r"\s+", " ", formula.strip()).replace(r"\ ", " ").replace(r"\,", " ")


def blocks(text: str) -> list[tuple[int, str, str, bool]]:
    """Start, whole, plain body, whether displayed, of each formula by its place."""
    found = [(m.start(), m[0], plain(m[1]), True) for m in _DISPLAY.finditer(text)]
    found += [(m.start(), m[0], plain(m[2]), True) for m in _ENVIRONMENT.finditer(text)]
    found += [(m.start(), m[0], plain(m[1]), False) for m in _INLINE.finditer(text)]
    return sorted(found, key=lambda b: b[0])


def same(a: tuple, b: tuple) -> bool:
    """Both displayed or both not, and one holds the other or they share most tokens; an empty formula is in any."""
    x, y = a[2].lower(), b[2].lower()
    if a[3] != b[3]:
        return False
    if x in y or y in x:
        return True
    s, t = set(_TOKEN.findall(x)), set(_TOKEN.findall(y))
    return bool(s | t) and len(s & t) > SAME * len(s | t)


def place(text: str) -> int:
    for cue in _CUES:
        if m := cue.search(text):
            return m.end()
    at = text.find("\n\n")
    return at if at > 0 else -1


def merged(base: str, source: str) -> tuple[str, int]:
    """The base with the source's formulas, and how many were taken over."""
    ours, theirs = blocks(base), blocks(source)
    n = 0
    if not ours:
        for _, whole, _, displayed in theirs:
            if displayed and (at := place(base)) >= 0:
                base, n = f"{base[:at]}\n\n{whole}\n\n{base[at:]}", n + 1
        return base, n
    for block in theirs:
        match = next((b for b in ours if same(b, block)), None)
        if match:
            base, n = base.replace(match[1], block[1]), n + 1
    return base, n


@F.pandas_udf(T.StructType().add("text", "string").add("n_merged", "integer"))
def merged_formulas(base: pd.Series, source: pd.Series) -> pd.DataFrame:
    """Null texts count as empty."""
    return pd.DataFrame([merged(a or "", b or "") for a, b in zip(base, source)], columns=["text", "n_merged"])


@F.pandas_udf(T.ArrayType(T.StructType().add("start", "integer").add("content", "string").add("plain", "string").add("display", "boolean")))
def formula_blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": s, "content": c, "plain": p, "display": d} for s, c, p, d in blocks(t)] if t else [])


def reconciled(attempts: DataFrame, primary: str = "deepseek-vllm", source: str = "nougat", pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, text, engines, engine, n_merged, confidence, status, error for each page.

    The base is the last reading of the primary engine, else the first of any; the last reading of the source engine gives
    its formulas if it isn't the base.  attempts: doc_id, page_num, attempt_seq, engine, text, confidence.  engine:
    "reconciled(a,b)"; status: success with a text, else error.  pages (doc_id, page_num): pages of which there is no
    reading come out as errors of their own.  Only pages of several readings are put together; the texts move once.
    """
    key = ["doc_id", "page_num"]
    rows = attempts.select(*key, "attempt_seq", F.lower("engine").alias("e"), "text", "confidence")
    one = F.struct("e", "text", "confidence", "attempt_seq")
    found = rows.groupBy(*key).agg(F.max_by(one, F.when(F.col("e") == primary, F.struct("attempt_seq", "text"))).alias("p"), F.min_by(one, F.struct("attempt_seq", "text")).alias("f"), F.max_by(one, F.when(F.col("e") == source, F.struct("attempt_seq", "text"))).alias("s"))
    found = found.withColumn("b", F.coalesce("p", "f")).withColumn("merge", F.coalesce(F.col("s").isNotNull() & (F.col("b.e") != source), F.lit(False)))
    plain_ = found.where(~F.col("merge")).select(*key, F.col("b.text").alias("text"), F.array("b.e").alias("engines"), F.lit(0).alias("n_merged"), F.col("b.confidence").alias("confidence"))
    both = found.where("merge").withColumn("m", merged_formulas("b.text", "s.text"))
    both = both.select(*key, "m.text", F.array("b.e", "s.e").alias("engines"), "m.n_merged", F.greatest("b.confidence", "s.confidence").alias("confidence"))
    out = plain_.unionByName(both).withColumn("error", F.lit(None).cast("string"))
    if pages is not None:
        gone = pages.select(*key).distinct().join(rows.select(*key).distinct(), key, "left_anti")
        out = out.unionByName(gone.select(*key, F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("engines"), F.lit(0).alias("n_merged"), F.lit(0.0).alias("confidence"), F.lit("no engine gave output").alias("error")))
    name = F.when(F.col("error").isNull(), F.concat(F.lit("reconciled("), F.array_join("engines", ","), F.lit(")")))
    return out.select(*key, "text", "engines", name.alias("engine"), "n_merged", "confidence", F.when(F.coalesce("text", F.lit("")) != "", "success").otherwise("error").alias("status"), "error")
