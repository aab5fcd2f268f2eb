"""Which engine to try next for a page that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Engines in their configured order, families of engines, and engines suited to a kind of failure, in order.
ENGINES = ("nougat", "deepseek", "mistral", "gemini", "marker", "glm", "gemini-api", "deepseek-vllm", "vllm")
FAMILY = {"deepseek": "deepseek", "deepseek-vllm": "deepseek", "gemini": "google", "mistral": "mistral", "nougat": "meta", "marker": "meta", "glm": "local", "vllm": "local"}
CLOUD, CAPABLE, LIGHT = ("gemini", "mistral", "deepseek"), ("gemini", "mistral", "deepseek", "deepseek-vllm"), ("glm", "nougat", "marker")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def next_engine(failure: Column, tried: Column, chain: Column, primary: Column, enabled: Column) -> Column:
    """The engine for a failure mode among those not tried: chain, then primary, then the enabled ones; null if all were.

    After a hallucination one of a family not tried yet, after a refusal a cloud engine, after poor text a capable one,
    after a timeout a light one; else, and where no such engine is left, the first.
    """
    left = F.array_except(F.array_distinct(F.concat(chain, F.array(primary), enabled)), tried)
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    used = F.array_compact(F.transform(tried, lambda e: family[e]))
    other = F.filter(left, lambda e: family[e].isNotNull() & ~F.array_contains(used, family[e]))
    first_of = lambda of: F.get(F.filter(_strings(of), lambda e: F.array_contains(left, e)), 0)
    fit = (
        F.when(failure == "hallucination", F.get(other, 0))
        .when(failure == "refusal", F.get(F.filter(left, lambda e: e.isin(*CLOUD)), 0))
        .when(failure.isin("garbage", "low_word_count", "truncated"), first_of(CAPABLE))
        .when(failure == "timeout", first_of(LIGHT))
    )
    return F.coalesce(fit, F.get(left, 0))


def repair_plan(attempts: DataFrame, chain: list[str], primary: str, enabled: tuple[str, ...] = ENGINES, need: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, failure, tried, engine, reason of the pages to be read again; engine is null where all were tried.

    need: doc_id, page_num of these pages (``state.page_states``), among them pages without a reading; without it, those
    whose last reading failed the audit.  failure is the mode of the most recent reading that has one, else empty_output;
    tried holds known engines only, sorted.
    """
    page = ["doc_id", "page_num"]
    rows = attempts.where("page_num > 0").select(*page, "attempt_seq", F.lower("engine").alias("e"), "failure_mode", F.coalesce("audit_passed", F.lit(False)).alias("ok")).dropDuplicates([*page, "attempt_seq"])
    has = F.when((F.col("failure_mode") != "none"), F.col("attempt_seq"))
    known = F.col("e").isin(*ENGINES)
    pages = rows.groupBy(*page).agg(
        F.max_by("failure_mode", has).alias("failure"),
        F.sort_array(F.collect_set(F.when(known, F.col("e")))).alias("tried"),  # at most the known engines
        F.max_by("ok", "attempt_seq").alias("passed"),
    )
    failed = pages.where("not passed") if need is None else need.select(*page).join(pages, page, "left")
    none = F.array().cast("array<string>")
    failed = failed.select(*page, F.coalesce("failure", F.lit("empty_output")).alias("failure"), F.coalesce("tried", none).alias("tried"))
    planned = failed.withColumn("engine", next_engine(F.col("failure"), F.col("tried"), _strings(chain).cast("array<string>"), F.lit(primary), _strings(enabled).cast("array<string>")))
    reason = F.concat(F.lit("failure="), "failure", F.lit(", tried=["), F.array_join("tried", ", "), F.lit("], selected="), F.coalesce("engine", F.lit("none")))
    return planned.withColumn("reason", reason)
