"""Queries of problems 1 and 3 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpoint, table
from . import abuse, leakage, markup, packing, quality, repetition, scans, splitting, truncation

KEYS = ["src", "doc_id", "page_num", "seq"]


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "attempts").select(F.lit("attempts").alias("src"), "doc_id", "page_num", F.col("attempt_seq").alias("seq"), "engine", "text")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_runs").select(F.lit("engine_runs").alias("src"), "doc_id", F.lit(-1).alias("page_num"), F.col("run_seq").alias("seq"), "engine", F.col("markdown").alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_assessment").select(F.lit("page_assessment").alias("src"), "doc_id", "page_num", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("engine"), F.col("native_text").alias("text"), "word_count", "char_count")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).unionByName(_runs(spark, sf_dir))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).unionByName(_pages(spark, sf_dir).drop("word_count", "char_count"))


def p1_found(spark, sf_dir):
    return repetition.repeated_content(_read(spark, sf_dir), KEYS, "text").where("flagged").select(*KEYS).distinct()


def p1_repeated_shares(spark, sf_dir):
    """The share of repeated content of every text."""
    return repetition.repeated_content(_read(spark, sf_dir), KEYS, "text").dropDuplicates(KEYS)


def p3_found(spark, sf_dir):
    return truncation.truncated_texts(table(spark, sf_dir, "attempts"), layers=table(spark, sf_dir, "page_assessment")).select("doc_id", "page_num", "attempt_seq")


def p3_truncation_rates(spark, sf_dir):
    """engine, n_texts, n_cut, rate: how often each source truncates."""
    attempts = table(spark, sf_dir, "attempts")
    keys = ["doc_id", "page_num", "attempt_seq"]
    cut = truncation.truncated_texts(attempts, layers=table(spark, sf_dir, "page_assessment")).select(*keys, F.lit(1).alias("cut"))
    texts = attempts.where("trim(text) <> ''").select(*keys, F.lower(F.trim("engine")).alias("engine")).dropDuplicates(keys)
    return texts.join(cut, keys, "left").groupBy("engine").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("rate"))


def p3_texts(spark, sf_dir):
    """engine, n_texts, consistent: the texts that the rates are of, and whether no more are cut."""
    return p3_truncation_rates(spark, sf_dir).select("engine", "n_texts", (F.col("n_cut") <= F.col("n_texts")).alias("consistent"))


def p4_found(spark, sf_dir):
    prose = quality.not_prose(_attempts(spark, sf_dir), KEYS, "text").select(*KEYS)
    return prose.unionByName(quality.wrong_counts(_pages(spark, sf_dir), KEYS, "text", "word_count", "char_count").select(*KEYS))


def p4_text_statistics(spark, sf_dir):
    return quality.text_statistics(_attempts(spark, sf_dir), KEYS, "text")


def p4_wrong_counts(spark, sf_dir):
    return quality.wrong_counts(_pages(spark, sf_dir), KEYS, "text", "word_count", "char_count")


def _oversized(spark, sf_dir):
    return splitting.oversized(table(spark, sf_dir, "handles"), table(spark, sf_dir, "page_assessment"), table(spark, sf_dir, "pipeline_configs"))


def p5_pieces(spark, sf_dir):
    return splitting.split_documents(_oversized(spark, sf_dir), table(spark, sf_dir, "outline"))


def p5_coverage(spark, sf_dir):
    """doc_id, n_pages, n_covered, fits, n_first, n_last: whether the pieces of each document hold all of its pages within the limit."""
    docs = _oversized(spark, sf_dir).distinct()
    pieces = splitting.split_documents(docs, table(spark, sf_dir, "outline")).join(docs, "doc_id")
    size = F.col("last_page") - F.col("first_page") + 1
    each = pieces.select("doc_id", "n_pages", (size <= F.col("chunk_size")).alias("fits"), "first_page", "last_page", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    return each.groupBy("doc_id", "n_pages").agg(F.count_distinct("page").alias("n_covered"), F.bool_and("fits").alias("fits"), F.min("first_page").alias("n_first"), F.max("last_page").alias("n_last"))


def p5_found(spark, sf_dir):
    """The documents that came out in more than one piece: those with more pages than their limit."""
    return p5_pieces(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")


def p6_found(spark, sf_dir):
    return scans.scan_noise(_scanned(spark, sf_dir), KEYS, "text")[0].select(*KEYS)


def p6_repaired_texts(spark, sf_dir):
    return scans.repaired_texts(_scanned(spark, sf_dir), KEYS, "text")


def p7_found(spark, sf_dir):
    return markup.markup_tokens(_read(spark, sf_dir), KEYS, "engine", "text").select(*KEYS)


def p7_clean_texts(spark, sf_dir):
    return markup.clean_texts(_read(spark, sf_dir).where("text is not null").dropDuplicates(KEYS), KEYS, "text", "engine")


def p7_templates(spark, sf_dir):
    """source, name, class, rank, parent of the shapes that make up the templates of each engine."""
    return markup.template_tokens(checkpoint(markup.page_tokens(_read(spark, sf_dir), KEYS, "engine", "text")))


def p7_slots(spark, sf_dir):
    """How many slots of each text each class of its engine's template has, and how long they are."""
    slots = markup.template_slots(_read(spark, sf_dir), KEYS, "engine", "text")
    return slots.groupBy(*KEYS, "class", "name").agg(F.count("*").alias("n_slots"), F.sum(F.length("content")).alias("n_chars"))


def p7_decisions(spark, sf_dir):
    """by (class, grammar), n_texts: what decided about the texts with markup."""
    found = markup.markup_tokens(_read(spark, sf_dir), KEYS, "engine", "text")
    return found.groupBy(F.when(F.col("by_class"), "class").otherwise("grammar").alias("by")).agg(F.count("*").alias("n_texts"))


def p8_containers(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_limits"))


def p8_coverage(spark, sf_dir):
    """pack_name, n_texts, over, split, torn: texts packed, containers over their capacity, texts split that would fit, texts whose parts aren't 0, 1, 2, ..."""
    rows = p8_containers(spark, sf_dir)
    over = rows.groupBy("pack_name", "container").agg((F.sum("tokens") > F.max("capacity_tokens")).cast("int").alias("over")).groupBy("pack_name").agg(F.sum("over").alias("over"))
    texts = rows.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"), F.max("capacity_tokens").alias("capacity"))
    split, torn = ((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).cast("int"), ((F.col("parts") != F.col("n")) | (F.col("last") != F.col("n") - 1)).cast("int")
    return texts.groupBy("pack_name").agg(F.count("*").alias("n_texts"), F.sum(split).alias("split"), F.sum(torn).alias("torn")).join(over, "pack_name")


def p9_found(spark, sf_dir):
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p9_leaked_items(spark, sf_dir):
    """item_id, n_docs, most: how many documents each leaked item stands in, and the greatest part of it that does."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("cover").alias("most"))


def p10_found(spark, sf_dir):
    return abuse.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels")).select("doc_id")


def p10_scores(spark, sf_dir):
    return abuse.scored(table(spark, sf_dir, "documents"))


def p10_source_rates(spark, sf_dir):
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p10_source_counts(spark, sf_dir):
    """source, n_docs, consistent: the rates' documents of each source, and whether their counts add up."""
    rates = p10_source_rates(spark, sf_dir)
    return rates.select("source", "n_docs", ((F.col("n_abusive") + F.col("n_hateful") + F.col("n_sexual") == F.col("n_flagged")) & (F.col("n_flagged") <= F.col("n_docs"))).alias("consistent"))


def p10_held_out_sources(spark, sf_dir):
    """The labelled documents of each source by the cutoff fitted on the other sources."""
    return abuse.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), "source")


def p10_held_out_languages(spark, sf_dir):
    return abuse.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), "lang")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("p") and k[1:2].isdigit()}
