"""Error rates of engines against a ground truth, their profiles and ranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import per_row
from ..functions.distance import char_distance, edit_distance, error_rate, word_distance
from ..functions.text import strip, word_count
from .routing import ENGINES


def page_scores(attempts: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, page_num, attempt_seq, engine, word_distance, char_distance, n_words, n_truth, n_chars, wer, cer, word_ratio.

    truth: doc_id, page_num, truth.  Words are compared as they are.  The ratio to an empty truth is 0 for an empty text, else infinite.
    """
    rows = attempts.dropDuplicates(["doc_id", "page_num", "attempt_seq"]).select("doc_id", "page_num", "attempt_seq", F.lower("engine").alias("engine"), F.coalesce("text", F.lit("")).alias("t"))
    both = rows.join(truth.where("truth is not null").dropDuplicates(["doc_id", "page_num"]), ["doc_id", "page_num"])
    both = both.withColumns({"word_distance": word_distance("t", "truth"), "char_distance": char_distance("t", "truth"), "n_words": word_count(F.col("t")), "n_truth": word_count(F.col("truth")), "n_chars": F.length("truth"), "_c": F.length("t")})
    return both.select(
        "doc_id", "page_num", "attempt_seq", "engine", "word_distance", "char_distance", "n_words", "n_truth", "n_chars",
        error_rate(F.col("word_distance"), F.col("n_words"), F.col("n_truth")).alias("wer"),
        error_rate(F.col("char_distance"), F.col("_c"), F.col("n_chars")).alias("cer"),
        F.when(F.col("n_truth") > 0, F.col("n_words") / F.col("n_truth")).when(F.col("n_words") == 0, 0.0).otherwise(float("inf")).alias("word_ratio"),
    )


def document_scores(attempts: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, engine, pages, n_words, n_truth, wer, cer of each engine's last readings of the pages that have a truth.

    The distance is that of the concatenated words (characters) of these pages, not a mean over pages; a reading of the
    whole document (page 0) is held against all of its pages, unless the engine also read single ones.  Null readings count
    as empty; without a word of truth both rates are 0.  truth: doc_id, page_num, truth.  A document is one value by its
    nature; the time grows with the square of its length over 64.
    """
    rows = attempts.select("doc_id", "page_num", "attempt_seq", F.lower("engine").alias("engine"), strip(F.coalesce("text", F.lit(""))).alias("t"))
    last = rows.groupBy("doc_id", "engine", "page_num").agg(F.max_by("t", F.struct("attempt_seq", "t")).alias("t"))
    known = truth.where("truth is not null").select("doc_id", "page_num", strip(F.col("truth")).alias("g")).dropDuplicates(["doc_id", "page_num"])
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("page_num", c))), lambda x: x[c])
    paged = last.join(known, ["doc_id", "page_num"]).groupBy("doc_id", "engine").agg(in_order("t").alias("t"), in_order("g").alias("g"))
    whole = last.where("page_num = 0").join(paged, ["doc_id", "engine"], "left_anti").select("doc_id", "engine", F.array("t").alias("t"))
    whole = whole.join(known.groupBy("doc_id").agg(in_order("g").alias("g")), "doc_id").select("doc_id", "engine", "t", "g")

    def score(t: list, g: list) -> tuple:
        a, b = [w for x in t for w in x.split()], [w for x in g for w in x.split()]
        x, y = "".join(t), "".join(g)
        return len(g), len(a), len(b), edit_distance(a, b) / len(b) if b else 0.0, edit_distance(x, y) / len(y) if y else 0.0

    fields = [("pages", "int"), ("n_words", "int"), ("n_truth", "int"), ("wer", "double"), ("cer", "double")]
    return per_row(paged.unionByName(whole), ["doc_id", "engine"], ["t", "g"], lambda: score, fields)


def run_matrix(papers: DataFrame, engines: list[str], available: list[str], runs: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, engine, status, failure_mode, processing_time, wer, cer: a row for each paper (doc_id) and engine.

    An engine that isn't available is an error of its own; a missing run counts as one too.  Only successful runs that have
    a truth are scored.  runs: doc_id, run_seq, engine, status, failure_mode, processing_time, of which the last of an engine holds.
    """
    grid = papers.select("doc_id").distinct().withColumn("engine", F.explode(F.array(*map(F.lit, engines)).cast("array<string>")))
    one = F.struct("status", "failure_mode", "processing_time")
    last = runs.groupBy("doc_id", F.lower("engine").alias("engine")).agg(F.max_by(one, F.struct("run_seq", one)).alias("r"))
    rows = grid.join(last, ["doc_id", "engine"], "left").join(scores.select("doc_id", "engine", "wer", "cer"), ["doc_id", "engine"], "left")
    usable = F.col("engine").isin(*available) & F.col("r").isNotNull() if available else F.lit(False)
    status = F.when(usable, F.coalesce(F.lower("r.status"), F.lit("pending"))).otherwise("error")
    scored = usable & (status == "success")
    return rows.select(
        "doc_id", "engine", status.alias("status"), F.when(usable, F.coalesce("r.failure_mode", F.lit("none"))).otherwise("model_unavailable").alias("failure_mode"),
        F.when(usable, F.coalesce("r.processing_time", F.lit(0.0))).otherwise(0.0).alias("processing_time"), F.when(scored, F.col("wer")).alias("wer"), F.when(scored, F.col("cer")).alias("cer"),
    )


SCORE = "paper_name string, engine string, overall_wer double, overall_cer double, processing_time double, pages array<struct<page_num: int, word_error_rate: double, character_error_rate: double, word_count_ratio: double>>"


def scores_to_json(scores: DataFrame, pages: DataFrame, paper: str = "doc_id") -> DataFrame:
    """paper, engine, score: each document's score with its pages in order as JSON; pages: paper, engine, page_num, wer, cer, word_ratio."""
    page = F.struct("page_num", F.col("wer").alias("word_error_rate"), F.col("cer").alias("character_error_rate"), F.col("word_ratio").alias("word_count_ratio"))
    held = pages.groupBy(paper, "engine").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    body = F.struct(F.col(paper).alias("paper_name"), "engine", F.col("wer").alias("overall_wer"), F.col("cer").alias("overall_cer"), F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"), F.coalesce("pages", F.array().cast(SCORE.split("pages ", 1)[1])).alias("pages"))
    return scores.join(held, [paper, "engine"], "left").select(paper, "engine", F.to_json(body).alias("score"))


def scores_from_json(rows: DataFrame, score: str = "score") -> DataFrame:
    """The columns of SCORE of each row; a row that isn't a score is left out, a missing time is 0."""
    s = rows.select(F.from_json(score, SCORE).alias("s")).where("s.paper_name is not null and s.engine is not null")
    return s.select("s.paper_name", "s.engine", "s.overall_wer", "s.overall_cer", F.coalesce("s.processing_time", F.lit(0.0)).alias("processing_time"), F.coalesce("s.pages", F.array().cast(SCORE.split("pages ", 1)[1])).alias("pages"))


def exact_mean(column: str) -> Column:
    """The mean by an exact sum, which doesn't depend on the order of the rows."""
    return (F.sum(F.col(column).cast("decimal(24,12)")).cast("double") / F.count(column)).alias(f"mean_{column}")


def engine_summary(runs: DataFrame, wer: str = "wer") -> DataFrame:
    """engine, n_runs, n_scored, mean_wer, mean_cer (where runs have it), mean_time; unscored runs count for the time."""
    return runs.groupBy(F.lower("engine").alias("engine")).agg(F.count("*").alias("n_runs"), F.count(wer).alias("n_scored"), exact_mean(wer).alias("mean_wer"), *([exact_mean("cer")] if "cer" in runs.columns else []), F.coalesce(exact_mean("processing_time"), F.lit(0.0)).alias("mean_time"))


def summary_by_grouping(runs: DataFrame, wer: str = "wer") -> DataFrame:
    """engine, category, n_runs, mean_wer by engine, by engine and category, and over all (null), in one pass."""
    return runs.withColumn("engine", F.lower("engine")).rollup("engine", "category").agg(F.count("*").alias("n_runs"), exact_mean(wer).alias("mean_wer"))


def recovery(runs: DataFrame, wer: str = "wer", good: float = 0.5) -> DataFrame:
    """engine, failure_mode, n, recovered: the share of the runs that failed in this way and are still scored better than ``good``."""
    failed = runs.where("failure_mode is not null and failure_mode <> 'none'")
    return failed.groupBy(F.lower("engine").alias("engine"), "failure_mode").agg(F.count("*").alias("n"), (F.count_if(F.col(wer) < good) / F.count("*")).alias("recovered"))


def profiles(runs: DataFrame, wer: str = "wer") -> DataFrame:
    """engine, category_wer, recovery, mean_time: an engine's profile with maps by category (and "_all") and failure mode."""
    by = runs.withColumns({"engine": F.lower("engine"), "category": F.coalesce("category", F.lit("_unknown"))})
    as_map = lambda df, k, v, name: df.groupBy("engine").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias(name))
    rates = by.where(F.col(wer).isNotNull()).groupBy("engine", "category").agg(exact_mean(wer).alias("r")).unionByName(by.where(F.col(wer).isNotNull()).groupBy("engine").agg(exact_mean(wer).alias("r")).withColumn("category", F.lit("_all")))
    times = engine_summary(runs, wer).select("engine", "mean_time")
    return times.join(as_map(rates, "category", "r", "category_wer"), "engine", "left").join(as_map(recovery(runs, wer), "failure_mode", "recovered", "recovery"), "engine", "left")


def ranking(runs: DataFrame, wer: str = "wer") -> DataFrame:
    """category, engine, rank, rate: engines with scores in a category by their mean WER, then the others by their overall one (1 if none), ties by name."""
    by = runs.withColumns({"engine": F.lower("engine"), "category": F.coalesce("category", F.lit("_unknown"))})
    overall = by.groupBy("engine").agg(exact_mean(wer).alias("all_wer"))
    held = by.groupBy("engine", "category").agg(exact_mean(wer).alias("own_wer"))
    # engines x categories: every pair is wanted; which engines there are is bounded by those that are known to a benchmark
    names = overall.agg(F.sort_array(F.collect_list(F.struct("engine", "all_wer"))).alias("e"))
    grid = by.select("category").distinct().crossJoin(names).select("category", F.explode("e").alias("e")).select("category", "e.*")
    rows = grid.join(held, ["engine", "category"], "left")
    rate: Column = F.coalesce("own_wer", "all_wer", F.lit(1.0))
    order = [F.col("own_wer").isNull(), rate, F.col("engine")]
    return rows.select("category", "engine", F.row_number().over(W.partitionBy("category").orderBy(*order)).alias("rank"), rate.alias("rate"))


def chains(ranked: DataFrame) -> DataFrame:
    """category, chain: the engines of each category in their order."""
    return ranked.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("rank", "engine"))).alias("c")).select("category", F.col("c.engine").alias("chain"))


def overall_order(profiles: DataFrame) -> DataFrame:
    """engine, rate, rank over all categories: engines by the mean of their error rates (1 without any), ties by name; profiles: engine, category_wer."""
    values = F.map_values("category_wer")
    rate = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(1.0)
    ranked = profiles.select("engine", rate.alias("rate"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rate", "engine")))  # a row for each engine


def applied(order: DataFrame, settings):
    """The settings with the best known engine as primary and the others as its chain, in their order; unchanged without any."""
    names = [r.engine for r in order.where(F.col("engine").isin(*ENGINES)).orderBy("rank").select("engine").collect()]  # at most the known engines
    return replace(settings, primary_engine=names[0], fallback_chain=tuple(names[1:])) if names else settings
