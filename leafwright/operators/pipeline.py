"""Whole runs over documents: which way each one is read, what is called for it, repairs, batches, the ledger.

A run is a plan, a table of tasks, which engines (``sources.providers``) then work off batch by batch.  Every step adds
readings; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint
from ..functions import audit
from ..functions.text import is_blank
from ..sources.providers import run_engine
from . import state
from .assembly import fixed_chunks
from .incremental import checksum
from .routing import ENGINES, repair_plan

# Engines read page by page over HTTP, the one that reads single pages in a native-first run, and the rank of engines by priority (others 99).
PER_PAGE = ("gemini-api",)
VISION = "gemini-api"
PRIORITY = {"glm": 0, "nougat": 1, "deepseek": 2, "marker": 3, "gemini": 4, "gemini-api": 4, "mistral": 5, "deepseek-vllm": 6, "vllm": 7}
#: Engines that read whole documents from the command line.
COMMAND = ("nougat", "deepseek", "mistral", "gemini", "marker", "glm")

READING = "doc_id, page_num, engine, text, status, failure_mode, confidence, processing_time, error, audit_passed".split(", ")


def by_priority(engines: list[str]) -> list[str]:
    """Engines by rank, of equal rank in the order given."""
    return sorted(engines, key=lambda e: PRIORITY.get(e, 99))


def _in(engine: Column, names) -> Column:
    return engine.isin(*names) if names else F.lit(False)


# --- the backbone


def backbone_routes(documents: DataFrame, states: DataFrame, primary: str, available: list[str], native_first: bool = True, threshold: int = state.CHUNK_THRESHOLD) -> DataFrame:
    """doc_id, n_pages, n_digital, route of each document.

    native_first where at least half of the pages are born digital; else per_page for an engine that reads pages,
    unavailable if the engine is, chunked for more pages than the threshold, whole for the rest.
    """
    digital = states.groupBy("doc_id").agg(F.count_if("born_digital").alias("n_digital"))
    rows = documents.join(digital, "doc_id", "left").withColumn("n_digital", F.coalesce("n_digital", F.lit(0)))
    ratio = F.col("n_digital") / F.greatest("n_pages", F.lit(1))
    engine = F.lit("unavailable") if primary not in available else F.lit("per_page") if primary in PER_PAGE else F.when(F.col("n_pages") > threshold, "chunked").otherwise("whole")
    return rows.select("doc_id", "n_pages", "n_digital", F.when(F.lit(native_first) & (ratio >= 0.5), "native_first").otherwise(engine).alias("route"))


def backbone_tasks(states: DataFrame, routes: DataFrame, primary: str, available: list[str], chunk_size: int = 20) -> DataFrame:
    """doc_id, page_num (0 for a run of pages), first_page, last_page, engine, action (native, call, error), fallback.

    native_first: prose pages take their text layer, the others are read by VISION; where that is unavailable, pages to be
    enhanced take their text layer and scanned ones are errors.  fallback: the text layer stands in if the call fails.
    """
    paged = states.join(routes.where("route in ('native_first', 'per_page')").select("doc_id", "route"), "doc_id")
    prose = F.col("born_digital") & ~F.col("enhance") & F.col("has_text")
    enhanced = F.col("born_digital") & F.col("enhance")
    vision = F.lit(VISION in available)
    native = (F.col("route") == "native_first") & (prose | enhanced & ~vision & F.col("has_text"))
    missing = (F.col("route") == "native_first") & ~vision & ~native
    # pages to be enhanced without a text layer get nothing where the engine is missing
    paged = paged.where(~(missing & enhanced))
    pages = paged.select(
        "doc_id", "page_num", F.col("page_num").alias("first_page"), F.col("page_num").alias("last_page"),
        F.when(native, "native").when(F.col("route") == "native_first", VISION).otherwise(primary).alias("engine"),
        F.when(native, "native").when(missing, "error").otherwise("call").alias("action"), ((F.col("route") == "native_first") & enhanced & F.col("has_text")).alias("fallback"),
    )
    runs = routes.where("route in ('chunked', 'whole', 'unavailable')")
    chunks = fixed_chunks(runs.where("route = 'chunked'"), "n_pages", chunk_size).select("doc_id", "first_page", "last_page", F.lit("call").alias("action"))
    whole = runs.where("route <> 'chunked'").select("doc_id", F.lit(1).alias("first_page"), F.col("n_pages").alias("last_page"), F.when(F.col("route") == "whole", "call").otherwise("error").alias("action"))
    ranges = chunks.unionByName(whole).select("doc_id", F.lit(0).alias("page_num"), "first_page", "last_page", F.lit(primary).alias("engine"), "action", F.lit(False).alias("fallback"))
    return pages.unionByName(ranges)


def multi_engine_tasks(documents: DataFrame, states: DataFrame, engines: list[str], available: list[str]) -> DataFrame:
    """The tasks of several engines on every document, whatever its pages; engines that are unknown or unavailable are skipped."""
    usable = [e for e in engines if e in available and (e in COMMAND or e in PER_PAGE)]
    whole, paged = [e for e in usable if e not in PER_PAGE], [e for e in usable if e in PER_PAGE]
    each = lambda df, names: df.withColumn("engine", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    a = each(documents, whole).select("doc_id", F.lit(0).alias("page_num"), F.lit(1).alias("first_page"), F.col("n_pages").alias("last_page"), "engine")
    b = each(states, paged).select("doc_id", "page_num", F.col("page_num").alias("first_page"), F.col("page_num").alias("last_page"), "engine")
    return a.unionByName(b).withColumns({"action": F.lit("call"), "fallback": F.lit(False)})


def run_tasks(tasks: DataFrame, contents: DataFrame, pages: DataFrame, engines: list[str]) -> DataFrame:
    """READING rows of the tasks, worked off by the registered engines of that name.

    contents (doc_id, page_num, content): what an engine gets, for a run of pages the array of them in order (at most a
    chunk, or a document that isn't chunked).  pages: the text layers.  Chunks of a document are joined to one reading;
    failed and empty ones are left out of it, and without any text it is an error.
    """
    tasks = checkpoint(tasks)
    layer = pages.where("is_born_digital and native_text <> ''").select("doc_id", "page_num", F.col("native_text").alias("text")).dropDuplicates(["doc_id", "page_num"])
    key = ["doc_id", "page_num"]

    def native(rows: DataFrame) -> DataFrame:
        return layer.join(rows.select(*key), key, "left_semi").select(*key, F.lit("native").alias("engine"), "text", F.lit("success").alias("status"), F.lit("none").alias("failure_mode"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("processing_time"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("audit_passed"))

    failed = tasks.where("action = 'error'").select(*key, "engine", F.lit("").alias("text"), F.lit("error").alias("status"), F.lit("model_unavailable").alias("failure_mode"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("processing_time"), F.concat(F.lit("engine not available: "), "engine").alias("error"), F.lit(False).alias("audit_passed"))
    out = native(tasks.where("action = 'native'")).unionByName(failed)
    calls = tasks.where("action = 'call'")
    for e in engines:
        mine = calls.where(F.col("engine") == e)
        by_page = checkpoint(run_engine(contents.join(mine.where("page_num > 0").select(*key), key, "left_semi"), e))
        out = out.unionByName(by_page.select(*READING))
        lost = by_page.where("status <> 'success'").join(mine.where("fallback").select(*key), key, "left_semi")
        out = out.unionByName(native(lost))
        ranges = mine.where("page_num = 0").select("doc_id", "first_page", "last_page")
        spread = ranges.withColumn("page_num", F.explode(F.sequence("first_page", "last_page"))).join(contents, key)
        part = spread.groupBy("doc_id", "first_page").agg(F.sort_array(F.collect_list(F.struct("page_num", "content"))).alias("c")).select("doc_id", F.col("first_page").alias("page_num"), F.col("c.content").alias("content"))
        read = run_engine(part, e)
        good = (F.col("status") == "success") & ~is_blank(F.col("text"))
        whole = read.groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.when(good, F.struct("page_num", "text")))).alias("t"), F.min(F.when(good, F.col("confidence"))).alias("confidence"), F.sum("processing_time").alias("processing_time"),
            F.min_by("failure_mode", F.when(F.col("failure_mode") != "none", F.col("page_num"))).alias("why"), F.max("error").alias("error"),
        )
        ok = F.size("t") > 0
        out = out.unionByName(
            whole.select(
                "doc_id", F.lit(0).alias("page_num"), F.lit(e).alias("engine"), F.array_join(F.col("t.text"), "\n\n").alias("text"), F.when(ok, "success").otherwise("error").alias("status"),
                F.when(ok, "none").otherwise(F.coalesce("why", F.lit("empty_output"))).alias("failure_mode"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "processing_time", F.when(~ok, F.col("error")).alias("error"), ok.alias("audit_passed"),
            )
        )
    return out


# --- repair


def with_new(attempts: DataFrame, new: DataFrame) -> DataFrame:
    """attempts and new readings, numbered on after the last of their page (new has at most a few for each page)."""
    from pyspark.sql import Window as W

    last = attempts.groupBy("doc_id", "page_num").agg(F.max("attempt_seq").alias("_last"))
    nth = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("engine", "status"))
    numbered = new.join(last, ["doc_id", "page_num"], "left").withColumn("attempt_seq", (F.coalesce("_last", F.lit(0)) + nth).cast("int")).drop("_last")
    return attempts.unionByName(numbered, allowMissingColumns=True)


def repaired(documents: DataFrame, pages: DataFrame, attempts: DataFrame, contents: DataFrame, chain: list[str], primary: str, available: list[str], max_retries: int = 2, truncation_retries: int = 1) -> DataFrame:
    """attempts and the readings of the repair rounds.

    A document whose last whole reading was truncated is read again by the same engine.  Then, in at most max_retries
    rounds, each page that needs a reading gets one by the next engine for its failure, and each document whose whole
    readings all failed and that has no page to repair one by the next of the chain.  New readings are audited at once.
    Only engines that are available are tried, so that no round repeats another.  Rounds end early when nothing is planned.
    """
    columns = [*state.KEYS, "engine", "text", "status", "failure_mode", "audit_passed", "confidence"]
    held = attempts.select(*columns).dropDuplicates(state.KEYS)
    usable = [e for e in ENGINES if e in available]
    if not usable:
        return held
    chain, primary = [e for e in chain if e in usable], primary if primary in usable else usable[0]

    def audited(new: DataFrame) -> DataFrame:
        limits = documents.select("doc_id", F.col("n_pages").alias("_n"))
        judged = audit.judged(audit.measured(new, "text").join(limits, "doc_id", "left"), F.when(F.col("page_num") == 0, F.col("_n")))
        ok = F.col("passed") & (F.col("status") != "error")
        mode = F.when(F.col("status") == "error", F.col("failure_mode")).otherwise(F.col("primary_failure"))
        return judged.select(*[c for c in columns if c not in ("attempt_seq", "failure_mode", "audit_passed", "confidence")], mode.alias("failure_mode"), ok.alias("audit_passed"), F.col("new_confidence").alias("confidence"))

    def read(tasks: DataFrame) -> DataFrame:
        new = run_tasks(tasks.withColumns({"action": F.lit("call"), "fallback": F.lit(False)}), contents, pages, usable)
        return checkpoint(with_new(held, audited(new.withColumnRenamed("confidence", "new_confidence"))))

    whole_task = lambda df: df.join(documents, "doc_id").select("doc_id", F.lit(0).alias("page_num"), F.lit(1).alias("first_page"), F.col("n_pages").alias("last_page"), "engine")

    def failing_whole() -> DataFrame:
        """doc_id, engine and failure of the last whole reading of documents of which none passes."""
        w = held.where("page_num = 0").groupBy("doc_id").agg(F.bool_or(F.coalesce("audit_passed", F.lit(False))).alias("ok"), F.max_by(F.struct(F.lower("engine").alias("engine"), "failure_mode"), "attempt_seq").alias("x"), F.collect_set(F.lower("engine")).alias("tried"))
        return w.where("not ok").select("doc_id", "x.engine", "x.failure_mode", "tried")

    for _ in range(truncation_retries):
        again = checkpoint(failing_whole().where((F.col("failure_mode") == "truncated") & _in(F.col("engine"), usable)).select("doc_id", "engine"))
        if again.isEmpty():
            break
        held = read(whole_task(again))
    for _ in range(max_retries):
        states = state.page_states(documents, pages, state.flags_of(held))
        need = states.where("needs_repair").select("doc_id", "page_num")
        # A document that a whole reading covers needs no pages.
        covered = held.where("page_num = 0 and audit_passed").select("doc_id").distinct()
        need = need.join(covered, "doc_id", "left_anti")
        planned = repair_plan(held, chain, primary, tuple(usable), need).where("engine is not null")
        paged = planned.select("doc_id", "page_num", F.col("page_num").alias("first_page"), F.col("page_num").alias("last_page"), "engine")
        nxt = F.get(F.array_except(F.array(*map(F.lit, chain)).cast("array<string>"), "tried"), 0)
        docs = failing_whole().join(planned.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", nxt.alias("engine")).where("engine is not null")
        tasks = checkpoint(paged.unionByName(whole_task(docs)))
        if tasks.isEmpty():
            break
        held = read(tasks)
    return held


# --- the standard way, batches, the ledger


def standard_results(runs: DataFrame, chain: list[str], primary: str) -> DataFrame:
    """doc_id, run_seq, engine, status, failure, saved: what the standard way takes of the runs there are (doc_id, run_seq, engine, status, text).

    The primary engine's last run, if it gave a text that passes the audit or if nothing else helps; where it fails the
    audit, the first of the chain that gave a text, which isn't audited again.  An engine error is final.  saved: there is a text to keep.
    """
    e = F.lower("engine")
    order = F.array_position(F.array(*[F.lit(c) for c in chain if c != primary]).cast("array<string>"), e)
    gave = ~is_blank(F.col("text")) & (F.lower(F.coalesce("status", F.lit(""))) == "success")
    rows = audit.judged(audit.measured(runs.select("doc_id", "run_seq", e.alias("engine"), gave.alias("gave"), F.when(e == primary, 0).otherwise(order).alias("place"), "text"), "text"))
    rows = rows.select("doc_id", "run_seq", "engine", "gave", "place", "passed", F.col("primary_failure").alias("failure")).where((F.col("engine") == primary) | (F.col("place") > 0)).dropDuplicates(["doc_id", "run_seq"])
    one = F.struct("run_seq", "engine", "gave", "passed", "failure")
    best = rows.groupBy("doc_id").agg(F.max_by(one, F.when(F.col("place") == 0, F.col("run_seq"))).alias("p"), F.min_by(one, F.when((F.col("place") > 0) & F.col("gave"), F.struct("place", "run_seq"))).alias("f"))
    other = F.col("p.gave") & ~F.col("p.passed") & F.col("f").isNotNull()
    taken = best.where("p is not null").select("doc_id", F.when(other, F.col("f")).otherwise(F.col("p")).alias("t"), other.alias("other"))
    status = F.when(~F.col("t.gave"), "error").when(F.col("other") | F.col("t.passed"), "success").otherwise("audit_failed")
    return taken.select("doc_id", "t.run_seq", "t.engine", status.alias("status"), F.when(F.col("other"), "none").otherwise(F.col("t.failure")).alias("failure"), (status == "success").alias("saved"))


def ledger_entries(results: DataFrame) -> DataFrame:
    """Entries to append to the ledger for the successes among results (name, checksum, engine, status, processing_time, pages, ts, output_path); an error leaves none, so the file is due again."""
    prefixed = F.concat(F.lit("sha256:"), checksum(F.col("checksum")))
    return results.where("status = 'success'").select("name", prefixed.alias("checksum"), F.lit("completed").alias("status"), "engine", F.round("processing_time", 2).alias("processing_time"), "pages", "ts", "output_path")


def upserted(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """One entry for each name: of the old and the new ones the latest by ts, a new one before an old one of the same time."""
    both = ledger.select(*entries.columns, F.lit(0).alias("_new")).unionByName(entries.withColumn("_new", F.lit(1)))
    rest = [c for c in entries.columns if c != "name"]
    held = both.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("ts", "_new", *[c for c in rest if c != "ts"])).alias("e"))
    return held.select("name", *[F.col(f"e.{c}") for c in rest])
