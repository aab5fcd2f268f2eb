"""Pages put together to documents and documents taken apart into pages or chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, pages_of, word_count

RULE = "\n\n---\n\n"


def joined(df: DataFrame, keys: list[str], order: str, text: str, separator: str = RULE) -> DataFrame:
    """keys, text, n_parts, n_words: the non-empty texts of each group in their order.  A document is one value by its nature."""
    kept = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t"))
    grouped = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", "_t"))).alias("p"))
    whole = F.array_join(F.col("p._t"), separator)
    return grouped.select(*keys, whole.alias("text"), F.size("p").alias("n_parts"), word_count(whole).alias("n_words"))


def page_texts(pages: DataFrame, best: DataFrame) -> DataFrame:
    """doc_id, page_num, text of each page: a passing best reading, else its native text, else a failing best reading.

    pages: doc_id, page_num, native_text; best: doc_id, page_num, text, audit_passed.  Readings of unknown pages are left out.
    """
    p = pages.dropDuplicates(["doc_id", "page_num"]).join(best.select("doc_id", "page_num", F.col("text").alias("_t"), "audit_passed"), ["doc_id", "page_num"], "left")
    native = F.when(~is_blank(F.col("native_text")), F.col("native_text"))
    return p.select("doc_id", "page_num", F.when(F.col("audit_passed"), F.col("_t")).otherwise(F.coalesce(native, "_t")).alias("text"))


def split_pages(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, page_num, text of the parts of whole-document texts between page rules."""
    return df.select(*keys, F.explode(pages_of(F.col(text))).alias("p")).select(*keys, "p.page_num", "p.text")


def needs_chunking(documents: DataFrame, pages: str, threshold: int) -> DataFrame:
    """The documents of more pages than the threshold; of an unknown number none."""
    return documents.where(F.col(pages) > threshold)


def fixed_chunks(documents: DataFrame, pages: str, size: int) -> DataFrame:
    """doc_id, chunk, first_page, last_page, n_pages: runs of ``size`` pages, the last as short as need be.  No pages, no chunks."""
    if size < 1:
        raise ValueError("a chunk has at least one page")
    n = F.col(pages)
    chunks = documents.where(n > 0).select("doc_id", n.alias("_n"), F.explode(F.sequence(F.lit(1), F.ceil(n / size).cast("int"))).alias("chunk"))
    first, last = (F.col("chunk") - 1) * size + 1, F.least(F.col("chunk") * size, F.col("_n"))
    return chunks.select("doc_id", "chunk", first.alias("first_page"), last.alias("last_page"), (last - first + 1).alias("n_pages"))


def engines_used(runs: DataFrame) -> DataFrame:
    """doc_id, engines in the order of their first use, n_runs, processing_time."""
    rows = runs.dropDuplicates(["doc_id", "run_seq"]).withColumn("engine", F.lower("engine"))
    each = rows.groupBy("doc_id", "engine").agg(F.min("run_seq").alias("first"), F.count("*").alias("n"), F.sum("processing_time").alias("t"))
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "engine"))).alias("e"), F.sum("n").alias("n_runs"), F.sum("t").alias("processing_time")).select("doc_id", F.col("e.engine").alias("engines"), "n_runs", "processing_time")


def figure_blocks(figures: DataFrame) -> DataFrame:
    """doc_id, blocks: captions and image links of a document's figures (doc_id, figure_num, page_num, description, path) in order; without a path none."""
    block = F.concat(F.lit("**Figure "), "figure_num", F.lit("** (page "), "page_num", F.lit("): "), F.coalesce("description", F.lit("")), F.lit("\n\n![Figure "), "figure_num", F.lit("]("), "path", F.lit(")"))
    return joined(figures.where("path is not null").withColumn("_b", block), ["doc_id"], "figure_num", "_b", "\n\n").select("doc_id", F.col("text").alias("blocks"))
