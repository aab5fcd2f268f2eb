"""Choosing among several readings of a page: scores, agreement, discrepancies, the best one."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import per_row
from ..functions.distance import edit_distance, error_rate, word_distance
from ..functions.text import is_blank, structure_count, word_count

#: Readings of a page whose texts one task compares at a time; pages with more are compared pair by pair, each pair a row.
MOST_READINGS = 64


def ungrounded_score(text: Column, passed: Column, confidence: Column) -> Column:
    """Length and structure on a logarithmic scale, the audit and the engine's confidence."""
    return F.log1p(word_count(text).cast("double")) + 5 * F.log1p(structure_count(text).cast("double")) + 10 * F.coalesce(passed, F.lit(False)).cast("int") + 5 * F.coalesce(confidence, F.lit(0.0))


def grounded_score(text: Column, passed: Column, reference: Column) -> Column:
    """Closeness to a reference text, less a penalty for half as many words again."""
    n, m = word_count(text), word_count(reference)
    wer = error_rate(word_distance(F.lower(text), F.lower(reference)), n, m)
    structure = F.least(structure_count(text) / F.greatest(structure_count(reference), F.lit(1)), F.lit(1.0))
    return (1 - F.least(wer, F.lit(2.0))) * 70 + 15 * F.coalesce(passed, F.lit(False)).cast("int") - F.when(n > 1.5 * m, 20).otherwise(0) + 5 * structure


def scored(attempts: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """attempts with viable and score.

    attempts: doc_id, page_num, attempt_seq, text, status, audit_passed, confidence.  reference: doc_id, page_num,
    reference; where it isn't blank the score is grounded on it.  Null texts are blank; blank texts and errors aren't viable.
    """
    a = attempts.withColumn("viable", ~is_blank(F.col("text")) & (F.coalesce(F.lower("status"), F.lit("")) != "error"))
    plain = ungrounded_score(F.col("text"), F.col("audit_passed"), F.col("confidence"))
    if reference is None:
        return a.withColumn("score", plain)
    a = a.join(reference.select("doc_id", "page_num", "reference"), ["doc_id", "page_num"], "left")
    known = ~is_blank(F.col("reference"))
    # The distances are computed in Python, so only for the rows that have a reference.
    with_reference = a.where(known).withColumn("score", grounded_score(F.coalesce("text", F.lit("")), F.col("audit_passed"), F.col("reference")))
    return with_reference.unionByName(a.where(~known).withColumn("score", plain)).drop("reference")


KEYS = ["doc_id", "page_num", "attempt_seq"]


def best_reading(attempts: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, attempt_seq, engine, score, viable, n_attempts, n_viable, any_passed of each page's best reading.

    Viable readings come first, then the higher score; of equal ones the earliest.  Rows that occur twice count once.  The
    texts are scored where they are read; only scores are shuffled (and, with a reference, what is joined to it).
    """
    rows = scored(attempts, reference).select(*KEYS, "engine", "score", "viable", F.coalesce("audit_passed", F.lit(False)).alias("ok")).dropDuplicates(KEYS)
    # An aggregation, not a window: it combines on the map side, so a page with very many readings does no harm.
    order = F.struct("viable", F.when(F.col("viable"), F.col("score")).alias("s"), (-F.col("attempt_seq")).alias("first"))
    best = rows.groupBy("doc_id", "page_num").agg(F.max_by(F.struct("attempt_seq", "engine", "score", "viable"), order).alias("b"), F.count("*").alias("n_attempts"), F.count_if("viable").alias("n_viable"), F.bool_or("ok").alias("any_passed"))
    return best.select("doc_id", "page_num", "b.*", "n_attempts", "n_viable", "any_passed")


def mean_agreement(texts: list[str | None]) -> float:
    """Mean of 1 - WER (0 at least) over all pairs of texts, the later as reference; 1 for fewer than two.  Equal texts are compared once."""
    if len(texts) < 2:
        return 1.0
    kinds = Counter((t or "").lower() for t in texts)
    split = {t: t.split() for t in kinds}
    names = list(kinds)
    at = {t: i for i, t in enumerate(names)}
    order = [at[(t or "").lower()] for t in texts]
    # how often a reading of kind i is earlier than one of kind j
    before = [[0] * len(names) for _ in names]
    seen = [0] * len(names)
    for j in order:
        for i, n in enumerate(seen):
            before[i][j] += n
        seen[j] += 1
    total = 0.0
    for i in range(len(names)):
        total += before[i][i]
        for j in range(i):
            if before[i][j] or before[j][i]:
                a, b = split[names[i]], split[names[j]]
                d = edit_distance(a, b)
                rate = lambda h, r: max(0.0, 1 - (d / len(r) if r else float(bool(h))))  # noqa: B023, E731
                total += before[i][j] * rate(a, b) + before[j][i] * rate(b, a)
    return total / (len(texts) * (len(texts) - 1) / 2)


def agreement(attempts: DataFrame) -> DataFrame:
    """doc_id, page_num, agreement: the mean of 1 - WER (0 at least) over all pairs of readings, the later as reference; 1 for a single one.

    Only pages with several readings send their texts through a shuffle, once, and are compared page by page.  A page with more than
    MOST_READINGS readings is compared by pairs of its distinct texts, which name each other by hash, with the same result.
    """
    sizes = attempts.select(*KEYS).distinct().groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    single = sizes.where("n = 1").select("doc_id", "page_num", F.lit(1.0).alias("agreement"))
    texts = attempts.select(*KEYS, "text")
    few = texts.join(sizes.where(F.col("n").between(2, MOST_READINGS)).select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    # At most MOST_READINGS distinct readings come together; copies of a row are one element of the set.
    grouped = few.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_set(F.struct("attempt_seq", "text"))).alias("r")).select("doc_id", "page_num", F.col("r.text").alias("texts"))
    compared = per_row(grouped, ["doc_id", "page_num"], ["texts"], lambda: lambda t: (mean_agreement(t),), [("agreement", "double")])
    many = texts.join(sizes.where(F.col("n") > MOST_READINGS).select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    return single.unionByName(compared).unionByName(_agreement_by_pairs(many))


def _agreement_by_pairs(attempts: DataFrame) -> DataFrame:
    """agreement of pages with very many readings: equal texts are paired once and weighted."""
    rows = attempts.select(*KEYS, F.lower(F.coalesce("text", F.lit(""))).alias("t")).dropDuplicates(KEYS).withColumn("h", F.xxhash64("t"))
    page = ["doc_id", "page_num"]
    kinds = rows.groupBy(*page, "h").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("attempt_seq")).alias("at"), F.min(F.struct(word_count(F.col("t")).alias("w"), "t")).alias("x")).select(*page, "h", "n", "at", F.col("x.w").alias("w"), F.col("x.t").alias("t"))
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_num") == F.col("b.page_num")) & (F.col("a.h") < F.col("b.h")))
    # of the readings i of a and j of b, how often i is the earlier
    first = F.aggregate("a.at", F.lit(0).cast("bigint"), lambda s, i: s + F.size(F.filter("b.at", lambda j: j > i)))
    d = word_distance(F.col("a.t"), F.col("b.t"))
    rate = lambda n, m: F.greatest(1 - error_rate(F.col("d"), n, m), F.lit(0.0))
    pairs = pairs.select("a.doc_id", "a.page_num", F.col("a.w").alias("wa"), F.col("b.w").alias("wb"), first.alias("ab"), (F.col("a.n") * F.col("b.n")).alias("all"), d.alias("d"))
    other = pairs.groupBy(*page).agg(F.sum(F.col("ab") * rate(F.col("wa"), F.col("wb")) + (F.col("all") - F.col("ab")) * rate(F.col("wb"), F.col("wa"))).alias("other"))
    same = kinds.groupBy(*page).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum("n").alias("n"))
    total = F.col("n") * (F.col("n") - 1) / 2
    return same.join(other, page, "left").select(*page, ((F.col("same") + F.coalesce("other", F.lit(0.0))) / F.nullif(total, F.lit(0.0))).alias("agreement"))


def discrepancies(attempts: DataFrame) -> DataFrame:
    """doc_id, page_num, spread, wide (spread over 0.3 of the mean number of words), divided (by the last status of each engine, some pass the audit and some fail), messages.

    messages: "Word count spread: engine=words, ..." of the engines by falling number of words (of equal ones by name; of an
    engine that read several times its longest reading), and "Audit divergence: passed=[...], failed=[...]" by name.
    """
    rows = attempts.select(*KEYS, "engine", F.coalesce("audit_passed", F.lit(False)).alias("ok"), word_count(F.col("text")).alias("n")).dropDuplicates(KEYS)
    # Partly summed up by engine first: what comes together for a page are its engines, not its readings.
    engine = rows.groupBy("doc_id", "page_num", "engine").agg(F.count("*").alias("k"), F.sum("n").alias("sum"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.max_by("ok", "attempt_seq").alias("ok"))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.coalesce("engine", F.lit(""))))), ", ")
    longest = F.collect_list(F.struct((-F.col("most")).alias("o"), F.coalesce("engine", F.lit("")).alias("engine"), F.col("most").alias("n")))
    page = engine.groupBy("doc_id", "page_num").agg(
        F.sum("k").alias("n_attempts"), F.when(F.sum("sum") > 0, (F.max("most") - F.min("fewest")) / (F.sum("sum") / F.sum("k"))).otherwise(0.0).alias("spread"),
        F.bool_or("ok").alias("some"), F.bool_and("ok").alias("every"), names(F.col("ok")).alias("passed"), names(~F.col("ok")).alias("failed"), F.array_sort(longest).alias("words"),
    )
    many = F.col("n_attempts") > 1
    wide, divided = many & (F.col("spread") > 0.3), many & F.col("some") & ~F.col("every")
    counts = F.array_join(F.transform("words", lambda w: F.concat(w["engine"], F.lit("="), w["n"].cast("string"))), ", ")
    said = F.array_compact(F.array(F.when(wide, F.concat(F.lit("Word count spread: "), counts)), F.when(divided, F.concat(F.lit("Audit divergence: passed=["), "passed", F.lit("], failed=["), "failed", F.lit("]")))))
    return page.select("doc_id", "page_num", F.when(many, F.col("spread")).otherwise(0.0).alias("spread"), wide.alias("wide"), divided.alias("divided"), said.alias("messages"))


def arbiter_choice(raw: Column, engines: Column) -> Column:
    """struct(engine, text) of an arbiter's answer, JSON with selected (from 1) and text; null without a text."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "selected int, text string")
    engine = F.when(found["selected"].between(1, F.size(engines)), F.get(engines, found["selected"] - 1)).otherwise("llm-merged")
    return F.when(~is_blank(found["text"]), F.struct(engine.alias("engine"), found["text"].alias("text")))


def top_readings(attempts: DataFrame, n: int = 3) -> DataFrame:
    """KEYS, score, rank of the n viable readings of each page with the highest ungrounded score; the texts stay where they are."""
    rows = scored(attempts).where("viable").select(*KEYS, "score").dropDuplicates(KEYS)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy(F.desc("score"), "attempt_seq"))).where(F.col("rank") <= n)


def arbiter_prompt(texts: Column, engines: Column) -> Column:
    """What an arbiter is asked: the readings, numbered from 1, and an answer in JSON with selected and text."""
    part = F.transform(F.arrays_zip(texts.alias("t"), engines.alias("e")), lambda x, i: F.concat(F.lit("Reading "), (i + 1).cast("string"), F.lit(" ("), x["e"], F.lit("):\n"), x["t"]))
    return F.concat(F.lit("Several readings of one page follow. Choose the one that is most faithful, or merge them.\nAnswer in JSON: {\"selected\": number, \"text\": text}.\n\n"), F.array_join(part, "\n\n"))


def arbitrated(attempts: DataFrame, ask, n: int = 3) -> DataFrame:
    """doc_id, page_num, engine, text of each page's choice: the arbiter's among the n best readings, where there are at least two and it answers; else the best by score.

    ask: a function prompt -> answer, called batch by batch on the executors; an exception counts as no answer.
    """
    page = ["doc_id", "page_num"]
    top = top_readings(attempts, n)
    with_text = attempts.select(*KEYS, F.lower("engine").alias("engine"), "text").join(top, KEYS).dropDuplicates(KEYS)
    ranked = with_text.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("rank", "engine", "text"))).alias("r"))  # at most n
    asked = ranked.where(F.size("r") >= 2).select(*page, F.col("r.engine").alias("engines"), arbiter_prompt(F.col("r.text"), F.col("r.engine")).alias("prompt"))

    def make():
        def answer(prompt: str) -> tuple:
            try:
                return (ask(prompt),)
            except Exception:
                return (None,)

        return answer

    said = per_row(asked, [*page, "engines"], ["prompt"], make, [("answer", "string")]).select(*page, arbiter_choice(F.col("answer"), F.col("engines")).alias("c"))
    best = best_reading(attempts).join(attempts.select(*KEYS, "text").dropDuplicates(KEYS), KEYS).select(*page, F.lower("engine").alias("_e"), F.col("text").alias("_t"))
    return best.join(said, page, "left").select(*page, F.coalesce("c.engine", "_e").alias("engine"), F.coalesce("c.text", "_t").alias("text"))
