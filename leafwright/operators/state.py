"""The state of documents in the making: pages with what was read of them, scored, reconciled and put together.

All of it is derived: readings are only ever added, and what holds of a page is an aggregation of them.  Decisions are made
on narrow rows (keys, flags and numbers); a text moves only if it was chosen.

Tables: documents (doc_id, n_pages), pages (doc_id, page_num, is_born_digital, native_text, needs_ocr_enhancement),
attempts (doc_id, page_num, attempt_seq, engine, text, status, audit_passed, confidence; page_num 0 is a whole document),
runs (doc_id, run_seq, engine, cost, processing_time).  Rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audit
from ..functions.text import is_blank
from . import consensus
from .assembly import RULE, engines_used, joined

KEYS = ["doc_id", "page_num", "attempt_seq"]
PAGE = ["doc_id", "page_num"]
#: Documents of more pages than this are read in chunks, whose texts aren't held against the number of pages.
CHUNK_THRESHOLD = 30


def latest_documents(handles: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, n_pages of each document's latest registration; where it is unknown (null, 0) the last page in pages.  Documents without pages are left out."""
    last = handles.groupBy("doc_id").agg(F.max_by("page_count", F.struct("added_at", "page_count")).alias("stated"))
    if pages is None:
        return last.where("stated > 0").select("doc_id", F.col("stated").alias("n_pages"))
    counted = pages.groupBy("doc_id").agg(F.max("page_num").alias("counted"))
    return last.join(counted, "doc_id", "left").select("doc_id", F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.col("counted")).alias("n_pages")).where("n_pages > 0")


def flags_of(attempts: DataFrame) -> DataFrame:
    """KEYS, engine, passed of each reading.  A reading that is an error doesn't pass, whatever its flag says; null is a fail."""
    passed = F.coalesce("audit_passed", F.lit(False)) & (F.coalesce(F.lower("status"), F.lit("")) != "error")
    return attempts.groupBy(*KEYS).agg(F.min(F.lower("engine")).alias("engine"), F.bool_or(passed).alias("passed"))


def page_states(documents: DataFrame, pages: DataFrame, flags: DataFrame) -> DataFrame:
    """doc_id, page_num, born_digital, has_text, enhance, n_attempts, best_seq, last_seq, needs_repair of every page from 1 to n_pages.

    best_seq: the first reading that passes.  Readings and classifications of pages that the document doesn't have are left
    out.  A page with a text layer needs a reading only if that should be enhanced and nothing was tried; any other page
    needs one until one passes.
    """
    flag = lambda c: F.lit(None).cast("boolean").alias(c)
    known = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_num"), F.lit(True).alias("known"), flag("native"), flag("text"), flag("enhance"), F.lit(None).cast("int").alias("seq"), flag("passed"))
    native = F.coalesce("is_born_digital", F.lit(False))
    marked = pages.select(*PAGE, flag("known"), native.alias("native"), (native & (F.coalesce("native_text", F.lit("")) != "")).alias("text"), (native & F.coalesce("needs_ocr_enhancement", F.lit(False))).alias("enhance"), F.lit(None).cast("int").alias("seq"), flag("passed"))
    read = flags.where("page_num > 0").select(*PAGE, flag("known"), flag("native"), flag("text"), flag("enhance"), F.col("attempt_seq").alias("seq"), "passed")
    # One aggregation over three kinds of rows in place of two joins.
    whole = known.unionByName(marked).unionByName(read).groupBy(*PAGE).agg(
        F.bool_or("known").alias("known"), F.coalesce(F.bool_or("native"), F.lit(False)).alias("born_digital"), F.coalesce(F.bool_or("text"), F.lit(False)).alias("has_text"), F.coalesce(F.bool_or("enhance"), F.lit(False)).alias("enhance"),
        F.count("seq").alias("n_attempts"), F.min(F.when(F.col("passed"), F.col("seq"))).alias("best_seq"), F.max("seq").alias("last_seq"),
    )
    return with_need(whole.where("known").drop("known"))


def with_need(states: DataFrame) -> DataFrame:
    missing = F.col("best_seq").isNull()
    need = F.when(F.col("has_text"), F.col("enhance") & missing & (F.col("n_attempts") == 0)).otherwise(missing)
    return states.withColumn("needs_repair", need)


def whole_states(flags: DataFrame) -> DataFrame:
    """doc_id, n_whole, passing_seq (the last that passes), last_seq of the readings of whole documents."""
    whole = flags.where("page_num = 0")
    return whole.groupBy("doc_id").agg(F.count("*").alias("n_whole"), F.max(F.when(F.col("passed"), F.col("attempt_seq"))).alias("passing_seq"), F.max("attempt_seq").alias("last_seq"))


# --- scoring


def scores(attempts: DataFrame, documents: DataFrame, threshold: int = CHUNK_THRESHOLD, **limits) -> DataFrame:
    """KEYS, n_words, passed, failure, confidence of each reading by the audit of its text.

    A whole document is held against its number of pages, unless that is over the threshold: it was read in chunks then.
    """
    narrow = audit.measured(attempts.select(*KEYS, "text"), "text", **limits).select(*KEYS, "n_words", "failing", "warnings").dropDuplicates(KEYS)
    limit = documents.select("doc_id", F.when(F.col("n_pages") <= threshold, F.col("n_pages")).alias("pages"))
    out = audit.judged(narrow.join(limit, "doc_id", "left"), F.when(F.col("page_num") == 0, F.col("pages")))
    return out.select(*KEYS, "n_words", "passed", F.col("primary_failure").alias("failure"), "confidence")


def scored_pages(states: DataFrame, scored: DataFrame, every: bool = False) -> DataFrame:
    """states after scoring, with failure (of the last reading).

    Pages without a text layer are scored by their last reading: if it is the best and fails, there is none; if it passes
    and there is none, it is.  every: all readings are scored, the first that passes fills a gap, and none is taken away.
    """
    mine = scored.where("page_num > 0").select(*PAGE, "attempt_seq", F.col("passed").alias("ok"), F.col("failure").alias("why"))
    by_page = mine.groupBy(*PAGE).agg(F.max_by("ok", "attempt_seq").alias("ok"), F.max_by("why", "attempt_seq").alias("failure"), F.min(F.when(F.col("ok"), F.col("attempt_seq"))).alias("first_ok"))
    both = states.drop("needs_repair").join(by_page, PAGE, "left")
    if every:
        best = F.coalesce("best_seq", "first_ok")
    else:
        best = F.when(F.col("ok"), F.coalesce("best_seq", "last_seq")).when(F.col("best_seq") == F.col("last_seq"), None).otherwise(F.col("best_seq"))
        best = F.when(F.col("has_text") | (F.col("n_attempts") == 0), F.col("best_seq")).otherwise(best)
    return with_need(both.withColumn("best_seq", best).drop("ok", "first_ok"))


def scored_documents(runs: DataFrame, scored: DataFrame, success: Column | None = None) -> DataFrame:
    """doc_id, attempt_seq, status (success, audit_failed), failure of the readings of whole documents; runs: KEYS of those that gave a text."""
    whole = scored.where("page_num = 0").join(runs.where("page_num = 0").select(*KEYS).distinct(), KEYS, "left_semi")
    return whole.select("doc_id", "attempt_seq", F.when(F.col("passed"), "success").otherwise("audit_failed").alias("status"), "failure")


# --- consensus


def consensus_gate(states: DataFrame, whole: DataFrame) -> DataFrame:
    """PAGE of what has several readings to choose from: pages without a text layer, and whole documents as page 0."""
    several = states.where("n_attempts >= 2 and not has_text").select(*PAGE)
    return several.unionByName(whole.where("n_whole >= 2").select("doc_id", F.lit(0).alias("page_num")))


def consensus_winners(attempts: DataFrame, states: DataFrame, whole: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, attempt_seq, engine ("consensus(x)"), agreement, n_viable, any_passed, note of each choice among several readings.

    Whole documents are scored against their text layers joined in order, where there are any (pages); other pages have
    none.  Without a viable reading the first is taken, with agreement 0 and a note; a single viable one has agreement 1.
    """
    wanted = attempts.join(consensus_gate(states, whole), PAGE, "left_semi")
    reference = None
    if pages is not None:
        held = pages.where("is_born_digital and native_text <> ''").select(*PAGE, "native_text").dropDuplicates(PAGE)
        held = held.join(whole.where("n_whole >= 2").select("doc_id"), "doc_id", "left_semi")
        reference = joined(held, ["doc_id"], "page_num", "native_text", "\n\n").select("doc_id", F.lit(0).alias("page_num"), F.col("text").alias("reference"))
    best = consensus.best_reading(wanted, reference)
    viable = wanted.where(~is_blank(F.col("text")) & (F.coalesce(F.lower("status"), F.lit("")) != "error"))
    agreed = consensus.agreement(viable).select(*PAGE, F.col("agreement").alias("_agreement"))
    out = best.join(agreed, PAGE, "left")
    return out.select(
        *PAGE, "attempt_seq", F.concat(F.lit("consensus("), "engine", F.lit(")")).alias("engine"), F.when(F.col("viable"), F.col("_agreement")).otherwise(0.0).alias("agreement"), "n_viable", "any_passed",
        F.when(~F.col("viable"), "all readings failed or are empty").alias("note"),
    )


def after_consensus(states: DataFrame, whole: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """states and whole with the winners as what holds: a winner counts as passing."""
    w = winners.select(*PAGE, F.col("attempt_seq").alias("_won"))
    on_page = states.drop("needs_repair").join(w.where("page_num > 0"), PAGE, "left").withColumn("best_seq", F.coalesce("_won", "best_seq")).drop("_won")
    on_whole = whole.join(w.where("page_num = 0").select("doc_id", "_won"), "doc_id", "left").withColumns({"passing_seq": F.coalesce("_won", "passing_seq"), "last_seq": F.coalesce("_won", "last_seq")}).drop("_won")
    return with_need(on_page), on_whole


# --- assembly


def text_sources(states: DataFrame, whole: DataFrame) -> DataFrame:
    """doc_id, page_num, source (reading, native), attempt_seq of each part of each document's text.

    Where no page has a reading that holds but there are readings of the whole document: the last that passes, else the text
    layers, else the last that fails.  Otherwise, page by page, the reading that holds, else the text layer; pages without either are left out.
    """
    by_doc = states.groupBy("doc_id").agg(F.bool_or(F.col("best_seq").isNotNull()).alias("any_best"), F.bool_or("has_text").alias("any_text"))
    plan = by_doc.join(whole, "doc_id", "left").withColumn(
        "route",
        F.when(F.col("any_best") | F.col("n_whole").isNull(), "pages").when(F.col("passing_seq").isNotNull(), "passing").when(F.col("any_text"), "native").otherwise("last"),
    )
    documents = plan.where("route in ('passing', 'last')").select("doc_id", F.lit(0).alias("page_num"), F.lit("reading").alias("source"), F.when(F.col("route") == "passing", F.col("passing_seq")).otherwise(F.col("last_seq")).alias("attempt_seq"))
    paged = states.join(plan.where("route in ('pages', 'native')").select("doc_id", "route"), "doc_id")
    reading = (F.col("route") == "pages") & F.col("best_seq").isNotNull()
    parts = paged.where(reading | F.col("has_text")).select(*PAGE, F.when(reading, "reading").otherwise("native").alias("source"), F.when(reading, F.col("best_seq")).alias("attempt_seq"))
    return documents.unionByName(parts)


def document_texts(sources: DataFrame, attempts: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text, n_parts, n_words of each document put together of its sources; only chosen texts move."""
    read = attempts.select(*KEYS, "text").join(sources.where("source = 'reading'").select(*KEYS), KEYS, "left_semi").dropDuplicates(KEYS).select(*PAGE, "text")
    native = pages.where("is_born_digital and native_text <> ''").select(*PAGE, F.col("native_text").alias("text")).join(sources.where("source = 'native'").select(*PAGE), PAGE, "left_semi").dropDuplicates(PAGE)
    return joined(read.unionByName(native), ["doc_id"], "page_num", "text", RULE)


def assembled(documents: DataFrame, states: DataFrame, whole: DataFrame, texts: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, status, pages_ok, n_repair, n_words, engines, cost, processing_time, text of every document.

    status: success with a text and no page in need of repair (or a passing whole reading), audit_failed with a text only, else error.
    """
    need = states.groupBy("doc_id").agg(F.count_if("needs_repair").alias("n_repair"))
    used = engines_used(runs)
    cost = runs.groupBy("doc_id", "run_seq").agg(F.max("cost").alias("c")).groupBy("doc_id").agg(F.sum("c").alias("cost"))
    out = documents.select("doc_id").join(need, "doc_id", "left").join(whole.select("doc_id", "passing_seq"), "doc_id", "left").join(used.join(cost, "doc_id"), "doc_id", "left").join(texts.select("doc_id", "text", "n_words"), "doc_id", "left")
    ok = (F.coalesce("n_repair", F.lit(0)) == 0) | F.col("passing_seq").isNotNull()
    has_text = ~is_blank(F.col("text"))
    status = F.when(has_text & ok, "success").when(has_text, "audit_failed").otherwise("error")
    return out.select("doc_id", status.alias("status"), ok.alias("pages_ok"), F.coalesce("n_repair", F.lit(0)).alias("n_repair"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("engines", F.array().cast("array<string>")).alias("engines"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"), "text")


def figure_contexts(figures: DataFrame, states: DataFrame, attempts: DataFrame, length: int = 500) -> DataFrame:
    """figures (doc_id, page_num, figure_num) with context: the beginning of the page's reading that holds, else of the first reading of the whole document that has a text."""
    start = F.substring("text", 1, length).alias("_t")
    of_page = states.where("best_seq is not null").select(*PAGE, F.col("best_seq").alias("attempt_seq")).join(figures.select(*PAGE).distinct(), PAGE, "left_semi")
    page = attempts.select(*KEYS, start).join(of_page, KEYS, "left_semi").dropDuplicates(KEYS).select(*PAGE, F.col("_t").alias("_page"))
    whole = attempts.where("page_num = 0 and text <> ''").select("doc_id", "attempt_seq", start).groupBy("doc_id").agg(F.min_by("_t", "attempt_seq").alias("_whole"))
    out = figures.join(page, PAGE, "left").join(whole, "doc_id", "left")
    return out.withColumn("context", F.coalesce("_page", "_whole", F.lit(""))).drop("_page", "_whole")
