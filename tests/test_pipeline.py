import datetime
import json

import pytest
from pyspark.sql import functions as F

from leafwright.operators import benchmark, figures, latex, pipeline, state
from leafwright.operators.incremental import due_files
from leafwright.sources import providers
from leafwright.sources.readers import Settings

GOOD = " ".join(f"Sentence number {i} says something new about the matter at hand." for i in range(12))
READING = "doc_id string, page_num int, attempt_seq int, engine string, text string, status string, failure_mode string, audit_passed boolean, confidence double"
PAGES = "doc_id string, page_num int, is_born_digital boolean, native_text string, needs_ocr_enhancement boolean"


def register(name, answer):
    providers.register_engine(name, answer)


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([("digital", 4), ("long", 45), ("short", 3)], "doc_id string, n_pages int")
    pages = spark.createDataFrame([("digital", 1, True, "prose one", False), ("digital", 2, True, "with a table", True), ("digital", 3, True, "fails", True), ("long", 1, True, "one page", False)], PAGES)
    contents = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_num")).withColumn("content", F.concat("doc_id", F.lit(" "), "page_num"))
    states = state.page_states(docs, pages, state.flags_of(spark.createDataFrame([], READING)))
    return docs, pages, contents, states


def test_routes(tables):
    docs, _, _, states = tables
    route = lambda *a, **k: {r.doc_id: r.route for r in pipeline.backbone_routes(docs, states, *a, **k).collect()}
    assert route("deepseek", ["deepseek"]) == {"digital": "native_first", "long": "chunked", "short": "whole"}
    assert route("gemini-api", ["gemini-api"]) == {"digital": "native_first", "long": "per_page", "short": "per_page"}
    assert route("deepseek", [], native_first=False) == {"digital": "unavailable", "long": "unavailable", "short": "unavailable"}


def test_backbone(spark, tables):
    docs, pages, contents, states = tables

    def vision(content):
        if content == "digital 3":
            raise TimeoutError("slow")
        return f"seen {content}", 0.85

    register("gemini-api", vision)
    register("deepseek", lambda parts: ("" if parts[0] == "long 21" else " / ".join(parts), 0.9))
    available = ["deepseek", "gemini-api"]
    tasks = pipeline.backbone_tasks(states, pipeline.backbone_routes(docs, states, "deepseek", available), "deepseek", available)
    rows = pipeline.run_tasks(tasks, contents, pages, available).collect()
    got = sorted((r.doc_id, r.page_num, r.engine, r.status, r.failure_mode) for r in rows)
    assert got == [
        ("digital", 1, "native", "success", "none"), ("digital", 2, "gemini-api", "success", "none"), ("digital", 3, "gemini-api", "error", "timeout"), ("digital", 3, "native", "success", "none"), ("digital", 4, "gemini-api", "success", "none"),
        ("long", 0, "deepseek", "success", "none"), ("short", 0, "deepseek", "success", "none"),
    ]
    text = {(r.doc_id, r.page_num, r.engine): r.text for r in rows}
    assert text["short", 0, "deepseek"] == "short 1 / short 2 / short 3"
    assert text["long", 0, "deepseek"].split("\n\n") == [" / ".join(f"long {p}" for p in range(a, b)) for a, b in ((1, 21), (41, 46))]  # the middle chunk gave nothing
    tasks = pipeline.backbone_tasks(states, pipeline.backbone_routes(docs, states, "deepseek", []), "deepseek", [])
    rows = pipeline.run_tasks(tasks, contents, pages, []).collect()
    assert sorted((r.doc_id, r.page_num, r.engine, r.failure_mode, r.audit_passed) for r in rows) == [
        ("digital", 1, "native", "none", True), ("digital", 2, "native", "none", True), ("digital", 3, "native", "none", True), ("digital", 4, "gemini-api", "model_unavailable", False),
        ("long", 0, "deepseek", "model_unavailable", False), ("short", 0, "deepseek", "model_unavailable", False),
    ]


def test_several_engines(tables):
    docs, _, _, states = tables
    tasks = pipeline.multi_engine_tasks(docs, states, ["gemini", "gemini-api", "vllm", "other"], ["gemini", "gemini-api", "vllm"]).collect()
    assert {r.engine for r in tasks} == {"gemini", "gemini-api"} and len(tasks) == 3 + 4 + 45 + 3
    assert pipeline.by_priority(["vllm", "mistral", "gemini-api", "gemini", "glm", "new"]) == ["glm", "gemini-api", "gemini", "mistral", "vllm", "new"]


def test_repair_rounds(spark):
    docs = spark.createDataFrame([("a", 3), ("b", 10), ("c", 2), ("d", 1)], "doc_id string, n_pages int")
    calls = []
    register("gemini", lambda c: ("too short" if c == "a 2" else (GOOD + " ") * (12 if isinstance(c, list) else 1), 0.8))
    register("mistral", lambda c: (GOOD, 0.7))
    register("nougat", lambda c: calls.append(c) or ("never", 0.1))
    contents = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_num")).withColumn("content", F.concat("doc_id", F.lit(" "), "page_num"))
    rows = [("a", 1, 1, "deepseek", GOOD, "success", "none", True, 0.5), ("a", 2, 1, "deepseek", "bad", "success", "low_word_count", False, 0.5), ("b", 0, 1, "gemini", "cut off", "success", "truncated", False, 0.5), ("c", 0, 1, "deepseek", GOOD, "success", "none", True, 0.5)]
    pages = spark.createDataFrame([("a", 3, True, "native", False), ("d", 1, True, "native", False)], PAGES)
    out = pipeline.repaired(docs, pages, spark.createDataFrame(rows, READING), contents, ["gemini", "mistral"], "deepseek", ["gemini", "mistral"])
    got = sorted((r.doc_id, r.page_num, r.attempt_seq, r.engine, r.audit_passed) for r in out.collect())
    assert got == [
        ("a", 1, 1, "deepseek", True), ("a", 2, 1, "deepseek", False), ("a", 2, 2, "gemini", False), ("a", 2, 3, "mistral", True),
        ("b", 0, 1, "gemini", False), ("b", 0, 2, "gemini", True), ("c", 0, 1, "deepseek", True),
    ]
    assert pipeline.repaired(docs, pages, spark.createDataFrame(rows, READING), contents, ["gemini"], "deepseek", []).count() == 4


def test_standard_results(spark):
    rows = [("a", 1, "Deepseek", "success", GOOD), ("b", 1, "deepseek", "success", "short"), ("b", 2, "mistral", "success", "x"), ("b", 3, "gemini", "error", None), ("c", 1, "deepseek", "success", "short"), ("d", 1, "deepseek", "error", None), ("d", 2, "gemini", "success", GOOD), ("e", 1, "gemini", "success", GOOD)]
    df = spark.createDataFrame(rows * 2, "doc_id string, run_seq int, engine string, status string, text string")
    out = {r.doc_id: (r.engine, r.status, r.failure, r.saved) for r in pipeline.standard_results(df, ["gemini", "deepseek", "mistral"], "deepseek").collect()}
    assert out == {"a": ("deepseek", "success", "none", True), "b": ("mistral", "success", "none", True), "c": ("deepseek", "audit_failed", "low_word_count", False), "d": ("deepseek", "error", "empty_output", False)}


def test_batch_and_ledger(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    listing = spark.createDataFrame([(1, "a", "AA", at(1)), (1, "b", "sha256:bb", at(1)), (1, "c", "cc", at(1))], "scan_id int, name string, checksum string, listed_at timestamp")
    ledger = spark.createDataFrame([("b", "BB", "Completed", "x", 1.0, 1, at(0), "o", 1, at(0))], "name string, checksum string, status string, engine string, processing_time double, pages int, ts timestamp, output_path string, log_id long, recorded_at timestamp")
    assert {r.name for r in due_files(listing, ledger).collect()} == {"a", "c"}
    results = spark.createDataFrame([("a", "AA", "success", "x", 1.239, 3, at(2), "out/a"), ("c", "cc", "error", "x", 1.0, 3, at(2), "out/c")], "name string, checksum string, status string, engine string, processing_time double, pages int, ts timestamp, output_path string")
    entries = pipeline.ledger_entries(results)
    assert [(r.name, r.checksum, r.processing_time) for r in entries.collect()] == [("a", "sha256:aa", 1.24)]
    after = pipeline.upserted(ledger, entries)
    assert {r.name for r in after.collect()} == {"a", "b"} and after.columns == entries.columns
    both = after.withColumns({"log_id": F.lit(1), "recorded_at": F.col("ts")})
    assert {r.name for r in due_files(listing, both).collect()} == {"c"}


def test_document_scores(spark):
    rows = [("a", 1, 1, "X", "one two", None), ("a", 1, 2, "x", "one two three", None), ("a", 2, 1, "x", "five", None), ("a", 3, 1, "x", "no truth", None), ("b", 0, 1, "x", "one two three four five", None), ("c", 1, 1, "x", None, None)]
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id string, page_num int, attempt_seq int, engine string, text string")
    truth = spark.createDataFrame([(d, p, t) for d in "ab" for p, t in ((1, "one two three four"), (2, "five"))] + [("c", 1, "")], "doc_id string, page_num int, truth string")
    out = {r.doc_id: r for r in benchmark.document_scores(df, truth).collect()}
    assert out["a"].wer == pytest.approx(0.2) and out["a"].pages == 2 and out["b"].wer == 0.0 and out["c"].wer == 0.0
    matrix = benchmark.run_matrix(df.select("doc_id"), ["x", "y"], ["x"], spark.createDataFrame([("a", 1, "x", "success", "none", 2.0), ("b", 1, "x", "error", "timeout", 9.0)], "doc_id string, run_seq int, engine string, status string, failure_mode string, processing_time double"), benchmark.document_scores(df, truth))
    got = {(r.doc_id, r.engine): (r.status, r.failure_mode, r.wer is not None) for r in matrix.collect()}
    assert got == {("a", "x"): ("success", "none", True), ("b", "x"): ("error", "timeout", False), ("c", "x"): ("error", "model_unavailable", False), **{(d, "y"): ("error", "model_unavailable", False) for d in "abc"}}


def test_scores_as_json(spark):
    pages = spark.createDataFrame([("p", "x", 2, 0.5, 0.1, float("inf")), ("p", "x", 1, 0.0, 0.0, 1.0)], "doc_id string, engine string, page_num int, wer double, cer double, word_ratio double")
    whole = spark.createDataFrame([("p", "x", 0.25, 0.05, None), ("q", "x", 1.0, 1.0, 3.0)], "doc_id string, engine string, wer double, cer double, processing_time double")
    rows = benchmark.scores_to_json(whole, pages)
    assert json.loads(rows.where("doc_id = 'p'").first().score)["overall_wer"] == 0.25
    back = {r.paper_name: r for r in benchmark.scores_from_json(rows.unionByName(spark.createDataFrame([("z", "x", "not json")], rows.schema))).collect()}
    assert set(back) == {"p", "q"} and [p.page_num for p in back["p"].pages] == [1, 2] and back["p"].processing_time == 0.0 and back["q"].pages == []


def test_settings_of_a_calibration(spark):
    order = spark.createDataFrame([("new", {"_all": 0.01}), ("nougat", {"_all": 0.2, "m": 0.2}), ("gemini", {"_all": 0.1}), ("glm", None)], "engine string, category_wer map<string,double>")
    chosen = benchmark.applied(benchmark.overall_order(order), Settings())
    assert (chosen.primary_engine, chosen.fallback_chain) == ("gemini", ("nougat", "glm"))
    assert benchmark.applied(benchmark.overall_order(order.limit(0)), Settings()) == Settings()


def test_pages_nobody_read(spark):
    df = spark.createDataFrame([("a", 1, 1, "nougat", "x", 0.5), ("a", 2, 1, "nougat", "", 0.5)], "doc_id string, page_num int, attempt_seq int, engine string, text string, confidence double")
    known = spark.createDataFrame([("a", p) for p in (1, 2, 3)], "doc_id string, page_num int")
    assert {r.page_num: (r.engine, r.status) for r in latex.reconciled(df, pages=known).collect()} == {1: ("reconciled(nougat)", "success"), 2: ("reconciled(nougat)", "error"), 3: (None, "error")}


@pytest.mark.parametrize("most", (5, 4000))
def test_pages_of_any_number_of_boxes(spark, monkeypatch, most):
    monkeypatch.setattr(figures, "MOST_BOXES", most)
    rows = [(1, i, 40.0 * i, 0.0, 40.0 * i + 15, 10.0) for i in range(9)] + [(2, 1, 0.0, 0.0, 1.0, 1.0), (2, 2, 100.0, 0.0, 101.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0)]
    out = figures.clustered(spark.createDataFrame(rows * 2, "page int, box_id int, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert sorted((r.page or 0, r.n_boxes) for r in out) == [(0, 1), (1, 9), (2, 1), (2, 1)]
