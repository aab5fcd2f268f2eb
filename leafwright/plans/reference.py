"""Queries of the document operators over the project's tables, and their SQL.

The SQL is written independently, for DuckDB: RE2 expressions, list functions, windows where Spark aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import new_folder, spread, table
from ..functions import audit, pages, text
from ..operators import assembly, benchmark, consensus, figures, images, latex, pipeline, routing, state
from ..operators.incremental import VersionedTable, checksum, listing_manifest
from ..sources.readers import Settings
from ..streaming import incremental as stream

KEYS = ["doc_id", "page_num", "attempt_seq"]
PAGE = ["doc_id", "page_num"]
CHAIN, PRIMARY = ["gemini", "mistral"], "deepseek"
#: Engines taken to be at hand where a query asks for it.
AVAILABLE = ["nougat", "deepseek", "gemini", "mistral", "gemini-api"]


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As delivered: rows may come twice.  Queries drop the second of what they computed, not of the texts."""
    return spread(table(spark, sf_dir, "attempts"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_documents(table(spark, sf_dir, "handles"))


def _page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).withColumnRenamed("n_pages", "pages")


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "page_assessment"))


def _audited(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Only whole-document texts are held against the number of pages.  The texts are measured where they are read; what is joined is narrow."""
    kept = [*KEYS, *columns]
    narrow = audit.measured(_attempts(spark, sf_dir).select(*kept, "text"), "text").drop("text").dropDuplicates(KEYS)
    return audit.judged(narrow.join(_page_counts(spark, sf_dir), "doc_id", "left"), F.when(F.col("page_num") == 0, F.col("pages")))


def q_word_statistics(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(t).alias("n_words"), F.round(audit.mean_word_length(t), 6).alias("mean_word_length"), F.round(audit.math_ratio(t), 6).alias("math_ratio"))


def q_garbage_ratio(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _attempts(spark, sf_dir).select(*KEYS, F.round(audit.garbage_ratio(t), 6).alias("garbage_ratio"), F.array_join(audit.unicode_issues(t), ",").alias("issues")).dropDuplicates(KEYS)


def q_audit(spark, sf_dir):
    return _audited(spark, sf_dir).select(*KEYS, "n_words", F.array_join("errors", ",").alias("errors"), F.array_join("modes", ",").alias("modes"), "primary_failure", "passed")


def q_audit_warnings(spark, sf_dir):
    return _audited(spark, sf_dir).select(*KEYS, F.array_join("warnings", ",").alias("warnings"), F.array_join("patterns", ",").alias("patterns"), "confidence")


def q_audit_details(spark, sf_dir):
    """What failed in each text, a row for each failure mode."""
    rows = _audited(spark, sf_dir)
    return rows.where("not passed").select(*KEYS, F.explode(audit.details(F.when(F.col("page_num") == 0, F.col("pages")))).alias("mode", "detail")).withColumn("detail", F.regexp_replace("detail", r"\d+\.\d%", "%"))


def q_audit_messages(spark, sf_dir):
    rows = _audited(spark, sf_dir)
    return rows.select(*KEYS, F.regexp_replace(F.array_join(audit.messages(), "; "), r"\d+\.\d", "n").alias("messages"))


def q_failure_rollup(spark, sf_dir):
    """Texts by engine and primary failure, by engine, and in all."""
    return _audited(spark, sf_dir, "engine").withColumn("engine", F.lower("engine")).rollup("engine", "primary_failure").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def q_structure(spark, sf_dir):
    return _attempts(spark, sf_dir).select(*KEYS, text.structure_count(F.col("text")).alias("n_structure"), audit.has_structure(F.coalesce("text", F.lit(""))).alias("has_structure")).dropDuplicates(KEYS)


def q_page_classes(spark, sf_dir):
    rows = pages.classified(_native(spark, sf_dir).select(*PAGE, "native_text", "font_count"), "native_text", "font_count")
    return rows.select(*PAGE, "is_native", "native_confidence", "reason", pages.has_equations(F.coalesce("native_text", F.lit(""))).alias("equations")).dropDuplicates(PAGE)


def q_document_pages(spark, sf_dir):
    out = pages.by_document(table(spark, sf_dir, "page_assessment"), "doc_id", "page_num", "is_born_digital")
    return out.withColumn("native_pages", F.array_join("native_pages", ","))


def q_enhancement(spark, sf_dir):
    return _native(spark, sf_dir).select(*PAGE, pages.enhanced("is_born_digital", "has_tables", "has_figures", "has_equations").alias("enhance")).dropDuplicates(PAGE)


def q_engine_texts(spark, sf_dir):
    """Texts less what their engine added, as lengths and hashes."""
    rows = _attempts(spark, sf_dir).where("lower(engine) in ('deepseek', 'deepseek-vllm', 'glm')")
    cleaned = text.without_grounding(F.col("text"))
    return rows.select(*KEYS, F.length(cleaned).alias("n_chars"), F.md5(cleaned).alias("hash")).dropDuplicates(KEYS)


def q_normalized(spark, sf_dir):
    """Texts in their plain form, as lengths and hashes."""
    rows = _attempts(spark, sf_dir).select(*KEYS, text.normalized(F.col("text"), F.col("engine")).alias("t"))
    return rows.select(*KEYS, F.length("t").alias("n_chars"), F.md5("t").alias("hash")).dropDuplicates(KEYS)


def q_normalized_ascii(spark, sf_dir):
    """The same for texts of ASCII characters alone, which need no composition."""
    rows = _attempts(spark, sf_dir).where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    rows = rows.select(*KEYS, text.normalized(F.col("text"), F.col("engine")).alias("t"))
    return rows.select(*KEYS, F.length("t").alias("n_chars"), F.md5("t").alias("hash")).dropDuplicates(KEYS)


def q_cli_texts(spark, sf_dir):
    """Documents of ASCII characters as a command-line tool writes them, with front matter and a block of metadata, and read out again."""
    rows = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    head = F.concat(F.lit("---\nsource: x\n---\n"), F.when(F.col("doc_id") % 2 == 0, "# OCR Results\n\n**Original File:** a.pdf\n**Processed:** now\n\n---\n").otherwise(""))
    out = text.cli_text(F.concat(head, "text"), F.lit("vllm"))
    return rows.select("doc_id", F.length(out).alias("n_chars"), F.md5(out).alias("hash"))


def q_file_stems(spark, sf_dir):
    return table(spark, sf_dir, "handles").select("path", text.file_stem(F.element_at(F.split("path", "/"), -1)).alias("stem")).distinct()


def q_markdown_tables(spark, sf_dir):
    """The sections of each document as a table in Markdown; of equal pages the titles by name, null titles are empty cells."""
    rows = table(spark, sf_dir, "outline").where("page_num is not null").select("doc_id", "page_num", "title").distinct()
    cells = F.array_sort(F.collect_list(F.struct("page_num", "title")))  # a document's outline
    body = rows.groupBy("doc_id").agg(cells.alias("r"))
    grid = F.concat(F.array(F.array(F.lit("page"), F.lit("title"))), F.transform("r", lambda x: F.array(x["page_num"].cast("string"), x["title"])))
    return body.select("doc_id", text.markdown_table(grid).alias("markdown"))


def q_plain_formulas(spark, sf_dir):
    """Inline formulas of the readings in their plain form."""
    rows = _attempts(spark, sf_dir).where(F.col("text").contains("$"))
    found = rows.select(*KEYS, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$([^$\n]+)\$"), F.lit(1)))).alias("formula"))
    return found.select(*KEYS, "formula", text.latex_plain(F.col("formula")).alias("plain")).distinct()


def q_phantom_images(spark, sf_dir):
    rows = _attempts(spark, sf_dir).where("contains(text, '![')")
    return rows.select(*KEYS, text.without_phantom_images(F.col("text")).alias("text")).dropDuplicates(KEYS)


def q_missing_images(spark, sf_dir):
    """Image references that name no file of the folder's listing, taken out: how many references each text had and keeps."""
    rows = _attempts(spark, sf_dir).where("contains(text, '![')").select(*KEYS, "text").dropDuplicates(KEYS)
    files = table(spark, sf_dir, "file_listing").select(F.col("name").alias("target"))
    count = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\([^)]+\)"), F.lit(0)))
    left = images.without_missing_images(rows, KEYS, "text", files)
    return rows.select(*KEYS, count(F.col("text")).alias("had")).join(left.select(*KEYS, count(F.col("text")).alias("keeps")), KEYS)


def q_best_reading(spark, sf_dir):
    rows = consensus.best_reading(_attempts(spark, sf_dir))
    return rows.select("doc_id", "page_num", "attempt_seq", "viable", "n_attempts", "any_passed", F.round("score", 6).alias("score"))


def q_grounded_reading(spark, sf_dir):
    """The best reading where the page's text layer is the reference."""
    reference = _native(spark, sf_dir).select(*PAGE, F.col("native_text").alias("reference")).dropDuplicates(PAGE)
    return consensus.best_reading(_attempts(spark, sf_dir), reference)


def q_agreement(spark, sf_dir):
    return consensus.agreement(table(spark, sf_dir, "attempts"))


def q_discrepancies(spark, sf_dir):
    return consensus.discrepancies(table(spark, sf_dir, "attempts").withColumn("engine", F.lower("engine"))).withColumns({"spread": F.round("spread", 6), "messages": F.array_join("messages", "; ")})


def q_top_readings(spark, sf_dir):
    return consensus.top_readings(_attempts(spark, sf_dir)).select(*KEYS, "rank", F.round("score", 6).alias("score"))


def q_arbiter_choices(spark, sf_dir):
    """An arbiter's answers, made of the readings themselves, and what they choose."""
    rows = _attempts(spark, sf_dir).select(*KEYS, F.lower("engine").alias("engine"), F.col("text").alias("t")).dropDuplicates(KEYS)
    answer = F.concat(F.lit("The answer: "), F.to_json(F.struct(F.col("attempt_seq").alias("selected"), F.trim(F.coalesce("t", F.lit(""))).alias("text"))), F.lit(" - done"))
    chosen = consensus.arbiter_choice(answer, F.array("engine", F.lit("other")))
    return rows.select(*KEYS, chosen["engine"].alias("chosen"), F.length(chosen["text"]).alias("n_chars"))


def q_page_states(spark, sf_dir):
    return state.page_states(_documents(spark, sf_dir), _native(spark, sf_dir), state.flags_of(_attempts(spark, sf_dir)))


def q_whole_states(spark, sf_dir):
    return state.whole_states(state.flags_of(_attempts(spark, sf_dir)))


def _scores(spark, sf_dir):
    return state.scores(_attempts(spark, sf_dir), _documents(spark, sf_dir))


def q_scored_pages(spark, sf_dir):
    return state.scored_pages(q_page_states(spark, sf_dir), _scores(spark, sf_dir))


def q_scored_multi(spark, sf_dir):
    return state.scored_pages(q_page_states(spark, sf_dir), _scores(spark, sf_dir), every=True)


def q_scored_documents(spark, sf_dir):
    runs = _attempts(spark, sf_dir).where("lower(coalesce(status, '')) <> 'error'")
    return state.scored_documents(runs, _scores(spark, sf_dir))


def q_consensus_gate(spark, sf_dir):
    return state.consensus_gate(q_page_states(spark, sf_dir), q_whole_states(spark, sf_dir))


def q_consensus(spark, sf_dir):
    """The readings chosen where there are several; SQL has all but the agreement."""
    out = state.consensus_winners(_attempts(spark, sf_dir), q_page_states(spark, sf_dir), q_whole_states(spark, sf_dir))
    return out.select(*PAGE, "attempt_seq", F.lower("engine").alias("engine"), "n_viable", "any_passed", "note")


def q_consensus_agreement(spark, sf_dir):
    """Whole documents scored against their text layers, with the agreement of the readings."""
    out = state.consensus_winners(_attempts(spark, sf_dir), q_page_states(spark, sf_dir), q_whole_states(spark, sf_dir), _native(spark, sf_dir))
    return out.withColumn("agreement", F.round("agreement", 6))


def q_text_sources(spark, sf_dir):
    return state.text_sources(q_page_states(spark, sf_dir), q_whole_states(spark, sf_dir))


def q_assembled(spark, sf_dir):
    """Every document put together: its status, cost, engines and text."""
    documents, attempts, native = _documents(spark, sf_dir), _attempts(spark, sf_dir), _native(spark, sf_dir)
    states, whole = q_page_states(spark, sf_dir), q_whole_states(spark, sf_dir)
    texts = state.document_texts(state.text_sources(states, whole), attempts, native)
    out = state.assembled(documents, states, whole, texts, table(spark, sf_dir, "engine_runs"))
    return out.select("doc_id", "status", "pages_ok", "n_repair", "n_words", F.array_join("engines", ",").alias("engines"), F.round("cost", 4).alias("cost"), F.round("processing_time", 4).alias("processing_time"), F.md5(text.without_phantom_images(F.col("text"))).alias("hash"))


def _routes(spark, sf_dir):
    return pipeline.backbone_routes(_documents(spark, sf_dir), q_page_states(spark, sf_dir), PRIMARY, AVAILABLE)


def q_backbone_routes(spark, sf_dir):
    return _routes(spark, sf_dir)


def q_backbone_tasks(spark, sf_dir):
    return pipeline.backbone_tasks(q_page_states(spark, sf_dir), _routes(spark, sf_dir), PRIMARY, AVAILABLE)


def q_backbone_without_vision(spark, sf_dir):
    """The same where the engine for single pages is missing, by route and action."""
    few = [e for e in AVAILABLE if e != pipeline.VISION]
    states = q_page_states(spark, sf_dir)
    tasks = pipeline.backbone_tasks(states, pipeline.backbone_routes(_documents(spark, sf_dir), states, PRIMARY, few), PRIMARY, few)
    return tasks.groupBy("doc_id", "engine", "action").agg(F.count("*").alias("n"))


def q_multi_engine_tasks(spark, sf_dir):
    tasks = pipeline.multi_engine_tasks(_documents(spark, sf_dir), q_page_states(spark, sf_dir), ["gemini", "gemini-api", "vllm", "marker"], AVAILABLE)
    return tasks.groupBy("doc_id", "engine").agg(F.count("*").alias("n"), F.max("last_page").alias("last_page"))


def _whole_runs(spark, sf_dir):
    """Runs with the texts of whole documents, from the run itself."""
    return table(spark, sf_dir, "engine_runs").select("doc_id", "run_seq", "engine", "status", F.col("markdown").alias("text"))


def q_standard_results(spark, sf_dir):
    return pipeline.standard_results(_whole_runs(spark, sf_dir), ["gemini", "mistral", "nougat"], PRIMARY)


def q_batch_ledger(spark, sf_dir):
    """The ledger after a batch over the files that are due, each of which ends at the time it was listed."""
    listing, ledger = table(spark, sf_dir, "file_listing"), table(spark, sf_dir, "processed_files")
    last = listing.agg(F.max("scan_id").alias("scan_id"))
    due = pipeline_due(listing, ledger)
    seen = listing.join(F.broadcast(last), "scan_id").groupBy("name").agg(F.max("listed_at").alias("ts"))
    results = due.join(seen, "name").select("name", "checksum", F.when(F.length("name") % 5 == 0, "error").otherwise("success").alias("status"), F.lit(PRIMARY).alias("engine"), F.lit(1.234).alias("processing_time"), F.lit(1).alias("pages"), "ts", F.concat(F.lit("out/"), "name").alias("output_path"))
    entries = pipeline.ledger_entries(results)
    done = ledger.where("lower(trim(status)) = 'completed' and name is not null").withColumn("status", F.lit("completed"))
    return pipeline.upserted(done, entries).select("name", checksum(F.col("checksum")).alias("checksum"), "engine", "ts", "pages")


def pipeline_due(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    from ..operators.incremental import due_files

    return due_files(listing, ledger).select("name").join(listing_manifest(listing), "name")


def q_repair_plan(spark, sf_dir):
    plan = routing.repair_plan(table(spark, sf_dir, "attempts"), CHAIN, PRIMARY)
    return plan.select(*PAGE, "failure", F.array_join("tried", ",").alias("tried"), "engine")


def q_repair_needed(spark, sf_dir):
    """The plan for the pages that need a reading by their state, those never read among them."""
    need = q_page_states(spark, sf_dir).where("needs_repair")
    return routing.repair_plan(table(spark, sf_dir, "attempts"), CHAIN, PRIMARY, need=need).select(*PAGE, "failure", F.array_join("tried", ",").alias("tried"), "engine", "reason")


def q_repairs_by_engine(spark, sf_dir):
    return routing.repair_plan(table(spark, sf_dir, "attempts"), CHAIN, PRIMARY).groupBy("engine", "failure").agg(F.count("*").alias("n_pages"))


def q_document_texts(spark, sf_dir):
    """Each document put together of its pages: a passing best reading, else the text layer, else a failing one."""
    attempts = _attempts(spark, sf_dir).where("page_num > 0")
    best = consensus.best_reading(attempts).select(*KEYS)
    chosen = attempts.select(*KEYS, "text", F.coalesce(F.col("audit_passed"), F.lit(False)).alias("audit_passed")).join(best, KEYS).dropDuplicates(KEYS).select(*PAGE, "text", "audit_passed")
    whole = assembly.joined(assembly.page_texts(_native(spark, sf_dir).select(*PAGE, "native_text"), chosen), ["doc_id"], "page_num", "text")
    return whole.select("doc_id", "n_parts", "n_words", F.md5("text").alias("hash"))


def q_split_documents(spark, sf_dir):
    """Documents put together of their text layers and taken apart again."""
    rows = _native(spark, sf_dir).where("trim(native_text) <> ''").select(*PAGE, "native_text").dropDuplicates(PAGE)
    whole = assembly.joined(rows, ["doc_id"], "page_num", "native_text")
    return assembly.split_pages(whole, ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def q_chunks(spark, sf_dir):
    limits = Settings()
    return assembly.fixed_chunks(assembly.needs_chunking(_page_counts(spark, sf_dir), "pages", limits.chunk_threshold), "pages", limits.chunk_size)


def q_engines_used(spark, sf_dir):
    return assembly.engines_used(table(spark, sf_dir, "engine_runs")).select("doc_id", F.array_join("engines", ",").alias("engines"), "n_runs", F.round("processing_time", 4).alias("processing_time"))


def q_figure_blocks(spark, sf_dir):
    """Blocks for the first sections of each document, as if they were figures; every third has no image."""
    rows = table(spark, sf_dir, "outline").where("page_num is not null and title is not null").groupBy("doc_id", "page_num").agg(F.min("title").alias("description"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num"))
    figs = rows.withColumn("figure_num", number).withColumn("path", F.when(F.col("figure_num") % 3 != 0, F.concat(F.lit("figures/"), F.col("figure_num"), F.lit(".png"))))
    return assembly.figure_blocks(figs)


def q_figure_contexts(spark, sf_dir):
    figs = table(spark, sf_dir, "outline").where("page_num is not null").select(*PAGE).distinct()
    out = state.figure_contexts(figs, q_page_states(spark, sf_dir), _attempts(spark, sf_dir))
    return out.select(*PAGE, F.md5("context").alias("hash"), F.length("context").alias("n_chars"))


def q_formulas(spark, sf_dir):
    rows = _attempts(spark, sf_dir).where(F.col("text").contains("$") | F.col("text").contains("\\begin")).select(*KEYS, "text")
    return rows.select(*KEYS, latex.formula_blocks("text").alias("b")).dropDuplicates(KEYS).select(*KEYS, F.explode("b").alias("b")).select(*KEYS, "b.*")


def q_formula_counts(spark, sf_dir):
    """Displayed formulas between double dollars, and environments, of each text: how many, and the hash of each kind's bodies in order."""
    blocks = q_formulas(spark, sf_dir).where("display")
    kind = F.when(F.col("content").startswith("$$"), "dollars").otherwise("environment")
    return blocks.groupBy(*KEYS, kind.alias("kind")).agg(F.count("*").alias("n"))


def q_reconciled(spark, sf_dir):
    return latex.reconciled(table(spark, sf_dir, "attempts"), "gemini-api", "deepseek-vllm").select(*PAGE, F.array_join("engines", ",").alias("engines"), "n_merged", "confidence", F.md5("text").alias("hash"))


def q_two_engine_pages(spark, sf_dir):
    """Every page of every document with what two engines gave of it; pages that neither read are errors."""
    known = _documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_num"))
    two = _attempts(spark, sf_dir).where("page_num > 0 and lower(engine) in ('gemini-api', 'deepseek-vllm')").join(known, PAGE, "left_semi")
    return latex.reconciled(two, "gemini-api", "deepseek-vllm", known).select(*PAGE, "engine", "status", "error")


def _boxes(spark, sf_dir):
    """Boxes on pages: the items of an order placed by their numbers."""
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    item = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), number.alias("box_id"), ((F.col("l_partkey") * 7) % 500).cast("double").alias("x0"), ((F.col("l_suppkey") * 13) % 700).cast("double").alias("y0"), F.col("l_quantity").cast("double").alias("q")
    )
    return item.select("page", "box_id", "x0", "y0", (F.col("x0") + 20 + 3 * F.col("q")).alias("x1"), (F.col("y0") + 20 + 4 * F.col("q")).alias("y1"))


def q_figure_clusters(spark, sf_dir):
    return figures.clustered(_boxes(spark, sf_dir), ["page"])


def _regions(spark, sf_dir, width=1000.0, height=800.0):
    sized = figures.clustered(_boxes(spark, sf_dir), ["page"]).withColumns({"width": F.lit(width), "height": F.lit(height)})
    return figures.figure_regions(sized, "width", "height").select("page", *figures.CORNERS, "n_boxes")


def q_figure_regions(spark, sf_dir):
    """Clusters on landscape pages that may be figures."""
    return _regions(spark, sf_dir)


def q_upright_regions(spark, sf_dir):
    """Clusters on upright pages that may be figures."""
    return _regions(spark, sf_dir, 800.0, 1000.0)


def q_slide_figures(spark, sf_dir):
    """Landscape pages of many boxes without a region, of which most is taken."""
    drawn = _boxes(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n_drawings")).withColumns({"width": F.lit(1000.0), "height": F.lit(800.0), "doc": (F.col("page") / 100).cast("bigint")})
    regions = _regions(spark, sf_dir).where("n_boxes > 4").withColumn("doc", (F.col("page") / 100).cast("bigint"))
    return figures.whole_page_figures(drawn, regions, "doc", "page", 4)


def q_figures_numbered(spark, sf_dir):
    regions = figures.image_regions(_boxes(spark, sf_dir)).withColumns({"doc": (F.col("page") / 100).cast("bigint")})
    return figures.numbered(regions, "doc", "page").select("doc", "page", "box_id", "figure_num")


def q_new_images(spark, sf_dir):
    """Image boxes that aren't figure regions already."""
    doc = (F.col("page") / 100).cast("bigint")
    return figures.new_image_regions(_boxes(spark, sf_dir).withColumn("doc", doc), q_upright_regions(spark, sf_dir).withColumn("doc", doc), "doc", "page").select("page", "box_id")


def q_embedded_images(spark, sf_dir):
    sized = _boxes(spark, sf_dir).withColumn("size_bytes", (F.col("x1") - F.col("x0")) * 40)
    return figures.embedded_images(sized).select("page", "box_id", "size_bytes")


def _runs(spark, sf_dir):
    """Readings of pages with a text layer as benchmark runs; as error rate the share of the layer's different words that a reading lacks."""
    category = table(spark, sf_dir, "handles").groupBy("doc_id").agg(F.max_by("paper_category", F.struct("added_at", "page_count")).alias("category"))
    # Hashes of words move, once, and copies of rows go after the rate is known.
    words = lambda c: F.array_distinct(F.transform(text.words(F.lower(F.coalesce(F.col(c), F.lit("")))), lambda w: F.xxhash64(w)))
    truth = _native(spark, sf_dir).where("is_born_digital").select(*PAGE, words("native_text").alias("truth"))
    read = _attempts(spark, sf_dir).select(*KEYS, F.lower("engine").alias("engine"), "failure_mode", "processing_time", F.coalesce("status", F.lit("")).alias("status"), words("text").alias("words"))
    lacks = F.size(F.array_except("truth", "words")) / F.size("truth")
    rows = read.join(truth, PAGE, "left").select(*KEYS, "engine", "failure_mode", "processing_time", F.when((F.col("status") != "error") & (F.size("truth") > 0), lacks).alias("wer")).dropDuplicates(KEYS)
    return rows.join(category, "doc_id", "left")


def q_engine_summary(spark, sf_dir):
    return benchmark.engine_summary(_runs(spark, sf_dir)).withColumns({"mean_wer": F.round("mean_wer", 6), "mean_time": F.round("mean_time", 6)})


def q_engine_rollup(spark, sf_dir):
    return benchmark.summary_by_grouping(_runs(spark, sf_dir).withColumn("category", F.coalesce("category", F.lit("_unknown")))).withColumn("mean_wer", F.round("mean_wer", 6))


def q_recovery(spark, sf_dir):
    return benchmark.recovery(_runs(spark, sf_dir)).withColumn("recovered", F.round("recovered", 6))


def q_engine_profiles(spark, sf_dir):
    """The profiles, a row for each entry of their maps."""
    profiles = benchmark.profiles(_runs(spark, sf_dir))
    rates = profiles.select("engine", F.lit("category").alias("kind"), F.explode("category_wer").alias("key", "value"))
    modes = profiles.select("engine", F.lit("failure").alias("kind"), F.explode("recovery").alias("key", "value"))
    times = profiles.select("engine", F.lit("time").alias("kind"), F.lit("_all").alias("key"), F.col("mean_time").alias("value"))
    return rates.unionByName(modes).unionByName(times).withColumn("value", F.round("value", 6))


def q_engine_ranking(spark, sf_dir):
    return benchmark.ranking(_runs(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def q_engine_chains(spark, sf_dir):
    return benchmark.chains(benchmark.ranking(_runs(spark, sf_dir))).withColumn("chain", F.array_join("chain", ","))


def q_engine_settings(spark, sf_dir):
    """What calibration sets: the best engine first, the others as its chain."""
    chosen = benchmark.applied(benchmark.overall_order(benchmark.profiles(_runs(spark, sf_dir))), Settings())
    return spark.createDataFrame([(chosen.primary_engine, ",".join(chosen.fallback_chain))], "primary_engine string, fallback_chain string")


def _truth(spark, sf_dir):
    return _native(spark, sf_dir).where("is_born_digital").select(*PAGE, F.col("native_text").alias("truth"))


def q_page_scores(spark, sf_dir):
    """Word and character error rates of the readings against the text layer of born-digital pages."""
    return benchmark.page_scores(_attempts(spark, sf_dir), _truth(spark, sf_dir))


def q_document_scores(spark, sf_dir):
    """The same over all pages of a document that an engine read, of documents with a text layer throughout."""
    digital = pages.by_document(_native(spark, sf_dir), "doc_id", "page_num", "is_born_digital").where("all_native").select("doc_id")
    return benchmark.document_scores(table(spark, sf_dir, "attempts").join(digital, "doc_id", "left_semi"), _truth(spark, sf_dir).join(digital, "doc_id", "left_semi"))


def q_run_matrix(spark, sf_dir):
    """Documents of a category by engines, with the runs there are; the scores stand in by the share of words missing on a document's pages."""
    runs = table(spark, sf_dir, "engine_runs")
    scores = _runs(spark, sf_dir).where("wer is not null").groupBy("doc_id", "engine").agg(benchmark.exact_mean("wer").alias("wer")).withColumn("cer", F.lit(None).cast("double"))
    papers = table(spark, sf_dir, "handles").where("paper_category is not null").select("doc_id")
    out = benchmark.run_matrix(papers, ["nougat", "deepseek", "gemini", "marker"], ["nougat", "deepseek", "gemini"], runs, scores)
    return out.select("doc_id", "engine", "status", "failure_mode", F.round("processing_time", 4).alias("processing_time"), F.round("wer", 6).alias("wer"))


def q_score_json(spark, sf_dir):
    """Scores written as JSON and read again: what comes back of each."""
    runs = _runs(spark, sf_dir).where("wer is not null and page_num > 0").dropDuplicates(["doc_id", "engine", "page_num"]).select("doc_id", "engine", "page_num", F.lit(0.25).alias("wer"), F.lit(0.5).alias("cer"), F.lit(1.0).alias("word_ratio"))
    whole = runs.groupBy("doc_id", "engine").agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.lit(2.5).alias("processing_time"))
    back = benchmark.scores_from_json(benchmark.scores_to_json(whole, runs))
    return back.select("paper_name", "engine", "overall_wer", "overall_cer", "processing_time", F.size("pages").alias("n_pages"), F.array_join(F.col("pages.page_num"), ",").alias("pages"))


def q_responses(spark, sf_dir):
    """Texts wrapped in a model's response and read out again."""
    status = F.when(F.coalesce("status", F.lit("")) == "error", 500).otherwise(200)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    rows = _attempts(spark, sf_dir).select(*KEYS, status.alias("code"), body.alias("body"))
    return rows.select(*KEYS, text.response_failure(F.col("code"), F.col("body")).alias("failure"), F.length(text.response_text(F.col("body"))).alias("n_chars")).dropDuplicates(KEYS)


def q_figure_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.figure_type(F.coalesce("text", F.lit(""))).alias("figure_type"))


def q_event_windows(spark, sf_dir):
    return stream.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def q_event_stream(spark, sf_dir):
    """The same windows counted by a stream with a watermark that no row falls behind."""
    rows = stream.read_stream(spark, f"{sf_dir}/events.parque[t]")
    return stream.collected(stream.windowed_counts(rows, "ts", "event_type", late="36500 days"), new_folder(spark, "windows"), "update", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def q_first_events(spark, sf_dir):
    """Each user's kinds of event, seen first by a stream that forgets nothing."""
    rows = stream.read_stream(spark, f"{sf_dir}/events.parque[t]")
    return stream.collected(stream.first_seen(rows.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "36500 days"), new_folder(spark, "seen"), "append").select("user_id", "event_type")


def q_stream_totals(spark, sf_dir):
    """Readings audited as a stream into a versioned table, and counted from it."""
    source = f"{sf_dir}/attempts.parque[t]"  # a pattern: a file by itself is no source of a stream
    sink = VersionedTable(spark, new_folder(spark, "streamed"))

    def judged(rows: DataFrame) -> DataFrame:
        return audit.audited(rows, "text").select(*KEYS, F.lower("engine").alias("engine"), "primary_failure")

    stream.run_into(stream.read_stream(spark, source), sink, judged, new_folder(spark, "progress")).awaitTermination()
    return sink.read().dropDuplicates(KEYS).groupBy("engine", "primary_failure").agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

# --- SQL

_S = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _words(t: str) -> str:
    return _count(t, f"[^{_S}]+")


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_ATTEMPTS = "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, attempt_seq ORDER BY engine) AS rn FROM attempts) WHERE rn = 1)"
_PAGES = "p AS (SELECT doc_id, page_count AS pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, page_count DESC NULLS LAST) AS rn FROM handles) WHERE rn = 1 AND page_count > 0)"
_NATIVE = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY char_count) AS rn FROM page_assessment) WHERE rn = 1)"


def _q(s: str) -> str:
    return s.replace("'", "''")


_GARBAGE = f"(CASE WHEN length(t) > 0 THEN ({_count('t', '[^' + _q(audit.NOT_GARBAGE) + ']')} + {_count('t', '[' + _S + ']{4,}')})::DOUBLE / length(t) ELSE 0.0 END)"
_MATH = r"(CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, '\{}^_$', '')))::DOUBLE / length(t) ELSE 0.0 END)"
_REFUSE = _q("(?i)" + "|".join(audit.REFUSALS))
_FORMAT = " + ".join(f"regexp_matches(t, '{_q('(?i)' + p)}')::INT" for p in audit.FORMATTING)
_AUDIT = rf"""WITH {_ATTEMPTS}, {_PAGES},
base AS (SELECT a.doc_id, a.page_num, a.attempt_seq, lower(a.engine) AS engine, coalesce(text, '') AS t, CASE WHEN a.page_num = 0 THEN coalesce(p.pages, 0) ELSE 0 END AS pages FROM a LEFT JOIN p USING (doc_id)),
parts AS (SELECT *, {_words('t')} AS n, list_transform(regexp_split_to_array(t, '[.!?][{_S}]+'), lambda x: {_strip('x')}) AS s FROM base),
found AS (SELECT *, NOT regexp_matches(t, '[^{_S}]') AS blank, regexp_matches(CASE WHEN n < 200 THEN t ELSE substr(t, 1, 500) END, '{_REFUSE}') AS refusal,
  len(s) >= 6 AND len(list_filter(range(1, greatest(len(s) - 1, 1)), lambda i: length(s[i]) >= 20 AND s[i] = s[i + 1] AND s[i] = s[i + 2])) > 0 AS loops FROM parts),
errs AS (SELECT *, CASE WHEN blank THEN ['empty'] WHEN refusal THEN ['refusal'] ELSE list_filter([
  CASE WHEN regexp_matches(t, '\(cid:\d+\)') THEN 'cid' END, CASE WHEN loops THEN 'loops' END, CASE WHEN {_FORMAT} >= 2 THEN 'formatting' END,
  CASE WHEN n < 50 THEN 'word_count' END, CASE WHEN pages > 5 AND n > 0 AND n::DOUBLE / pages < 100 THEN 'truncation' END,
  CASE WHEN {_GARBAGE} > 0.15 AND {_MATH} <= 0.3 THEN 'garbage' END], lambda x: x IS NOT NULL) END AS e FROM found),
modes AS (SELECT *, list_transform(e, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.MODE_OF.items())} END) AS m0 FROM errs),
done AS (SELECT *, list_filter(m0, lambda x, i: list_position(m0, x) = i) AS m FROM modes),
audited AS (SELECT *, coalesce({' '.join(f"CASE WHEN list_contains(m, '{x}') THEN '{x}' END," for x in reversed(audit.PRIORITY))} 'none') AS primary_failure, len(e) = 0 AS passed FROM done)
"""
_HIGH = "(1 + n_structure)"
_STRUCTURE = f"len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')}), lambda x: regexp_matches(x, '^(?:#|\\|.*\\|$|[-*+]\\s|\\d+\\.\\s)')))"
_SCORED = f"""WITH {_ATTEMPTS}, s AS (SELECT *, {_words("coalesce(text, '')")} AS n, {_STRUCTURE} AS n_structure,
  coalesce(regexp_matches(text, '[^{_S}]'), false) AND coalesce(lower(status), '') <> 'error' AS viable FROM a),
scored AS (SELECT *, ln(1.0 + n) + 5 * ln(1.0 + n_structure) + 10 * coalesce(audit_passed, false)::INT + 5 * coalesce(confidence, 0.0) AS score FROM s)
"""
_ENGINES = "[" + ", ".join(f"'{e}'" for e in routing.ENGINES) + "]"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FAMILY = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in routing.FAMILY.items()) + " END"
_REPAIR = f"""WITH {_ATTEMPTS}, r AS (SELECT *, lower(engine) AS e FROM a WHERE page_num > 0),
g AS (SELECT doc_id, page_num, coalesce(arg_max(failure_mode, attempt_seq) FILTER (WHERE failure_mode <> 'none'), 'empty_output') AS failure,
  list_sort(coalesce(list(DISTINCT e) FILTER (WHERE list_contains({_ENGINES}, e)), []::VARCHAR[])) AS tried, arg_max(coalesce(audit_passed, false), attempt_seq) AS passed FROM r GROUP BY doc_id, page_num),
c AS (SELECT *, list_filter({_list([*dict.fromkeys([*CHAIN, PRIMARY, *routing.ENGINES])])}, lambda x: NOT list_contains(tried, x)) AS cands, list_transform(tried, lambda x: {_FAMILY.format('x')}) AS used FROM g WHERE NOT passed),
plan AS (SELECT doc_id, page_num, failure, array_to_string(tried, ',') AS tried, coalesce(CASE
  WHEN failure = 'hallucination' THEN list_filter(cands, lambda x: {_FAMILY.format('x')} IS NOT NULL AND NOT coalesce(list_contains(used, {_FAMILY.format('x')}), false))[1]
  WHEN failure = 'refusal' THEN list_filter(cands, lambda x: list_contains({_list(routing.CLOUD)}, x))[1]
  WHEN failure IN ('garbage', 'low_word_count', 'truncated') THEN list_filter({_list(routing.CAPABLE)}, lambda x: list_contains(cands, x))[1]
  WHEN failure = 'timeout' THEN list_filter({_list(routing.LIGHT)}, lambda x: list_contains(cands, x))[1] END, cands[1]) AS engine FROM c)
"""
_BOXES = """boxes AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS box_id, ((l_partkey * 7) % 500)::DOUBLE AS x0, ((l_suppkey * 13) % 700)::DOUBLE AS y0,
  ((l_partkey * 7) % 500)::DOUBLE + 20 + 3 * l_quantity AS x1, ((l_suppkey * 13) % 700)::DOUBLE + 20 + 4 * l_quantity AS y1 FROM lineitem)"""
_CLUSTERS = f"""WITH RECURSIVE {_BOXES},
edges AS (SELECT a.page, a.box_id AS u, b.box_id AS v FROM boxes a JOIN boxes b ON a.page = b.page
  WHERE greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 30 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 30),
reach(page, u, v) AS (SELECT page, u, v FROM edges UNION SELECT r.page, r.u, e.v FROM reach r JOIN edges e ON r.page = e.page AND r.v = e.u),
roots AS (SELECT page, u AS box_id, min(v) AS root FROM reach GROUP BY page, u),
clusters AS (SELECT b.page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM boxes b JOIN roots r ON b.page = r.page AND b.box_id = r.box_id GROUP BY b.page, root)
"""
_SPELT = "nullif(regexp_replace(lower(trim({})), '^sha-?256:', ''), '')"
_MEAN = "sum(CAST({0} AS DECIMAL(24, 12)))::DOUBLE / count({0})"


def _distinct(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({column}, '')), '[^{_S}]+'))"


_RUNS = f"""WITH {_ATTEMPTS}, {_NATIVE}, c AS (SELECT doc_id, paper_category AS category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, page_count DESC NULLS LAST) AS rn FROM handles) WHERE rn = 1),
truth AS (SELECT doc_id, page_num, {_distinct('native_text')} AS truth FROM n WHERE is_born_digital),
runs AS (SELECT a.doc_id, a.page_num, a.attempt_seq, lower(engine) AS engine, failure_mode, processing_time, CASE WHEN coalesce(status, '') <> 'error' AND len(truth) > 0
  THEN len(list_filter(truth, lambda x: NOT list_contains({_distinct('text')}, x)))::DOUBLE / len(truth) END AS wer, coalesce(category, '_unknown') AS category
  FROM a LEFT JOIN truth ON a.doc_id = truth.doc_id AND a.page_num = truth.page_num LEFT JOIN c ON a.doc_id = c.doc_id)
"""
_RANKED = (
    _RUNS
    + """, overall AS (SELECT engine, """ + _MEAN.format("wer") + """ AS all_wer FROM runs GROUP BY engine), own AS (SELECT engine, category, """ + _MEAN.format("wer") + """ AS own_wer FROM runs GROUP BY engine, category),
ranked AS (SELECT c.category, o.engine, row_number() OVER (PARTITION BY c.category ORDER BY w.own_wer IS NULL, coalesce(own_wer, all_wer, 1.0), o.engine) AS rank, coalesce(own_wer, all_wer, 1.0) AS rate
  FROM overall o CROSS JOIN (SELECT DISTINCT category FROM runs) c LEFT JOIN own w ON w.engine = o.engine AND w.category = c.category)
"""
)
_CLASS = rf"""WITH {_NATIVE}, x AS (SELECT doc_id, page_num, coalesce(font_count, 0) AS fonts, coalesce(native_text, '') AS t, {_words("coalesce(native_text, '')")} AS w,
  length({_strip("coalesce(native_text, '')")}) AS c, regexp_extract_all(coalesce(native_text, ''), '[^{_S}]+') AS words FROM n),
y AS (SELECT *, CASE WHEN w > 0 THEN list_sum(list_transform(words, lambda v: length(v)))::DOUBLE / w ELSE 0.0 END AS m,
  CASE WHEN length(t) > 0 THEN {_count('t', '[' + _S + ']')}::DOUBLE / length(t) ELSE 0.0 END AS s,
  CASE WHEN length(t) > 0 THEN {_count('t', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffd}\\x{e000}-\\x{f8ff}]')}::DOUBLE / length(t) ELSE 0.0 END AS b FROM x),
z AS (SELECT *, CASE WHEN c < 50 THEN 'chars' WHEN w < 15 THEN 'words' WHEN regexp_matches(t, '\(cid:\d+\)') THEN 'cid' WHEN b > 0.05 THEN 'broken' WHEN s > 0.6 THEN 'blanks' WHEN m < 2.5 THEN 'short_words' WHEN m > 20 THEN 'long_words' END AS reason FROM y)
SELECT doc_id, page_num, reason IS NULL AS is_native, reason, round(CASE reason WHEN 'chars' THEN 0.95 WHEN 'words' THEN 0.85 WHEN 'cid' THEN 0.95 WHEN 'broken' THEN 0.8 WHEN 'blanks' THEN 0.75 WHEN 'short_words' THEN 0.7 WHEN 'long_words' THEN 0.7
  ELSE least(1.0, 0.8::DOUBLE + (w > 100)::INT * 0.05 + (w > 300)::INT * 0.05 + (b < 0.01)::INT * 0.03 + (fonts >= 2)::INT * 0.03 + (fonts >= 4)::INT * 0.02 + (m BETWEEN 3.5 AND 7.0)::INT * 0.02) END::DOUBLE, 6) AS native_confidence,
  regexp_matches(t, '{pages.MATH}') OR regexp_matches(t, '(?s)\$\$.+?\$\$') OR regexp_matches(t, '(?s)\\\[.+?\\\]') AS equations FROM z"""
_TEMPLATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.DETAILS.items())
_STATES = f"""WITH {_ATTEMPTS}, {_PAGES},
fl AS (SELECT doc_id, page_num, attempt_seq, lower(engine) AS engine, coalesce(audit_passed, false) AND coalesce(lower(status), '') <> 'error' AS ok FROM a),
known AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page_num FROM p),
cls AS (SELECT doc_id, page_num, max(coalesce(is_born_digital, false)::INT) = 1 AS native, max((coalesce(is_born_digital, false) AND coalesce(native_text, '') <> '')::INT) = 1 AS has_text,
  max((coalesce(is_born_digital, false) AND coalesce(needs_ocr_enhancement, false))::INT) = 1 AS enhance FROM page_assessment GROUP BY doc_id, page_num),
rd AS (SELECT doc_id, page_num, count(*) AS n, min(attempt_seq) FILTER (WHERE ok) AS best, max(attempt_seq) AS last FROM fl WHERE page_num > 0 GROUP BY doc_id, page_num),
st0 AS (SELECT k.doc_id, k.page_num, coalesce(native, false) AS born_digital, coalesce(has_text, false) AS has_text, coalesce(enhance, false) AS enhance, coalesce(n, 0) AS n_attempts, best AS best_seq, last AS last_seq
  FROM known k LEFT JOIN cls c ON k.doc_id = c.doc_id AND k.page_num = c.page_num LEFT JOIN rd r ON k.doc_id = r.doc_id AND k.page_num = r.page_num),
st AS (SELECT *, CASE WHEN has_text THEN enhance AND best_seq IS NULL AND n_attempts = 0 ELSE best_seq IS NULL END AS needs_repair FROM st0),
wh AS (SELECT doc_id, count(*) AS n_whole, max(attempt_seq) FILTER (WHERE ok) AS passing_seq, max(attempt_seq) AS last_seq FROM fl WHERE page_num = 0 GROUP BY doc_id)
"""
# The audit with whole documents over the threshold not held against their pages, then what scoring makes of the states.
_SCORED_STATES = (
    _STATES
    + ", "
    + _AUDIT.split(",\n", 1)[1].replace("CASE WHEN a.page_num = 0 THEN coalesce(p.pages, 0) ELSE 0 END AS pages", f"CASE WHEN a.page_num = 0 AND p.pages <= {state.CHUNK_THRESHOLD} THEN p.pages ELSE 0 END AS pages").rstrip()
    + """,
lastly AS (SELECT doc_id, page_num, arg_max(passed, attempt_seq) AS ok, arg_max(primary_failure, attempt_seq) AS failure, min(attempt_seq) FILTER (WHERE passed) AS first_ok FROM audited WHERE page_num > 0 GROUP BY doc_id, page_num)
"""
)
_RESCORED = """ SELECT doc_id, page_num, born_digital, has_text, enhance, n_attempts, last_seq, failure, b AS best_seq, CASE WHEN has_text THEN enhance AND b IS NULL AND n_attempts = 0 ELSE b IS NULL END AS needs_repair FROM (
  SELECT s.doc_id, s.page_num, born_digital, has_text, enhance, n_attempts, last_seq, failure, {} AS b FROM st s LEFT JOIN lastly l ON s.doc_id = l.doc_id AND s.page_num = l.page_num)"""
_SOURCES = """, bd AS (SELECT doc_id, max((best_seq IS NOT NULL)::INT) = 1 AS any_best, max(has_text::INT) = 1 AS any_text FROM st GROUP BY doc_id),
rt AS (SELECT bd.doc_id, passing_seq, wh.last_seq, CASE WHEN any_best OR n_whole IS NULL THEN 'pages' WHEN passing_seq IS NOT NULL THEN 'passing' WHEN any_text THEN 'native' ELSE 'last' END AS route FROM bd LEFT JOIN wh ON bd.doc_id = wh.doc_id),
src AS (SELECT doc_id, 0 AS page_num, 'reading' AS source, CASE WHEN route = 'passing' THEN passing_seq ELSE last_seq END AS attempt_seq FROM rt WHERE route IN ('passing', 'last') UNION ALL
  SELECT st.doc_id, page_num, CASE WHEN route = 'pages' AND best_seq IS NOT NULL THEN 'reading' ELSE 'native' END, CASE WHEN route = 'pages' THEN best_seq END FROM st JOIN rt ON st.doc_id = rt.doc_id
  WHERE route IN ('pages', 'native') AND (route = 'pages' AND best_seq IS NOT NULL OR has_text))
"""
_VIABLE_SCORE = _SCORED.split(", s AS", 1)[1]
_ROUTES = ", dg AS (SELECT doc_id, count(*) FILTER (WHERE born_digital) AS n_digital FROM st GROUP BY doc_id), routes AS (SELECT p.doc_id, pages AS n_pages, coalesce(n_digital, 0) AS n_digital, CASE WHEN coalesce(n_digital, 0)::DOUBLE / greatest(pages, 1) >= 0.5 THEN 'native_first' WHEN pages > 30 THEN 'chunked' ELSE 'whole' END AS route FROM p LEFT JOIN dg ON p.doc_id = dg.doc_id)"
_TASKS = """, tasks AS (SELECT st.doc_id, page_num, page_num AS first_page, page_num AS last_page, CASE WHEN {native} THEN 'native' ELSE 'gemini-api' END AS engine, CASE WHEN {native} THEN 'native' ELSE '{call}' END AS action, born_digital AND enhance AND has_text AS fallback
  FROM st JOIN routes r ON st.doc_id = r.doc_id WHERE route = 'native_first' {keep} UNION ALL
  SELECT doc_id, 0, (k - 1) * 20 + 1, least(k * 20, n_pages), 'deepseek', 'call', false FROM (SELECT doc_id, n_pages, unnest(range(1, ((n_pages + 19) // 20) + 1)) AS k FROM routes WHERE route = 'chunked') UNION ALL
  SELECT doc_id, 0, 1, n_pages, 'deepseek', 'call', false FROM routes WHERE route = 'whole')"""
_PROSE = "born_digital AND NOT enhance AND has_text"
_HASHED = "length({0}) AS n_chars, md5({0}) AS hash"


def _tidy(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    return _strip(rf"regexp_replace(regexp_replace({t}, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_HEADER = r"regexp_replace(regexp_replace(t, '^#\s*OCR Results\s*\n+', ''), '(?m)^\*\*(?:Original File|Full Path|Processed|Processing Time):\*\*[^\n]*\n?', '', 'g')"
_PREAMBLE = r"regexp_replace(regexp_replace(t, '(?s)^\\documentclass(?:\[.*?\])?\{.*?\}(?:.*?\\begin\{document\})?', '', 'g'), '\\end\{document\}\s*$', '', 'g')"
_MARKERS = r"regexp_replace(t, '\[MISSING_PAGE_(?:POST|EMPTY)(?::\w+)?\]', '', 'g')"
_DROPPED = "t"
for _p in (r"<\|ref\|>.*?<\|/ref\|>", r"<\|det\|>\[\[.*?\]\]<\|/det\|>", r"<\|[^|]+\|>", r"\[\[\d+,\s*\d+,\s*\d+,\s*\d+\]\]"):
    _DROPPED = f"regexp_replace({_DROPPED}, '{_p}', '', 'g')"
_DROPPED = rf"regexp_replace(regexp_replace({_DROPPED}, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_BY_ENGINE = f"CASE WHEN e IN ('deepseek', 'deepseek-vllm', 'glm') THEN {_DROPPED} WHEN e = 'mistral' THEN {_HEADER} WHEN e = 'nougat' THEN {_PREAMBLE} WHEN e = 'marker' THEN {_MARKERS} ELSE t END"
_RUN_OF = "list_filter(range(1, length(t)), lambda i: {})"

SQL = {
    "q_word_statistics": f"""SELECT doc_id, {_words('t')} AS n_words, round(CASE WHEN {_words('t')} > 0 THEN list_sum(list_transform(regexp_extract_all(t, '[^{_S}]+'), lambda x: length(x)))::DOUBLE / {_words('t')} ELSE 0.0 END, 6) AS mean_word_length,
  round({_MATH}, 6) AS math_ratio FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "q_garbage_ratio": rf"""WITH {_ATTEMPTS} SELECT doc_id, page_num, attempt_seq, round({_GARBAGE}, 6) AS garbage_ratio, concat_ws(',', CASE WHEN regexp_matches(t, '\x{{fffd}}') THEN 'replacement chars' END,
  CASE WHEN regexp_matches(t, '[\x{{e000}}-\x{{f8ff}}]') THEN 'private use chars' END, CASE WHEN regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control chars' END) AS issues FROM (SELECT *, coalesce(text, '') AS t FROM a)""",
    "q_audit": _AUDIT + "SELECT doc_id, page_num, attempt_seq, n AS n_words, array_to_string(e, ',') AS errors, array_to_string(m, ',') AS modes, primary_failure, passed FROM audited",
    "q_failure_rollup": _AUDIT + "SELECT engine, primary_failure, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM audited GROUP BY ROLLUP (engine, primary_failure)",
    "q_structure": rf"""WITH {_ATTEMPTS} SELECT doc_id, page_num, attempt_seq, {_STRUCTURE} AS n_structure, regexp_matches(t, '(?m)^#+\s+[\p{{L}}\p{{N}}_]') OR regexp_matches(t, '(?m)^\d+\.\s+[\p{{L}}\p{{N}}_]') OR regexp_matches(t, '(?m)^[-*•]\s+[\p{{L}}\p{{N}}_]')
  OR len(string_split(t, chr(10) || chr(10))) > 2 AS has_structure FROM (SELECT *, coalesce(text, '') AS t FROM a)""",
    "q_page_classes": _CLASS,
    "q_document_pages": """WITH one AS (SELECT doc_id, page_num, max(coalesce(is_born_digital, false)::INT) = 1 AS n FROM page_assessment GROUP BY doc_id, page_num)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE n) AS n_native, bool_and(n) AS all_native, bool_and(NOT n) AS none_native, NOT bool_and(n) AND NOT bool_and(NOT n) AS mixed,
  coalesce(string_agg(page_num::VARCHAR, ',' ORDER BY page_num) FILTER (WHERE n), '') AS native_pages FROM one GROUP BY doc_id""",
    "q_enhancement": f"WITH {_NATIVE} SELECT doc_id, page_num, coalesce(is_born_digital, false) AND (coalesce(has_tables, false) OR coalesce(has_figures, false) OR coalesce(has_equations, false)) AS enhance FROM n",
    "q_engine_texts": f"WITH {_ATTEMPTS}, x AS (SELECT *, text AS t FROM a WHERE lower(engine) IN ('deepseek', 'deepseek-vllm', 'glm')) SELECT doc_id, page_num, attempt_seq, length({_DROPPED}) AS n_chars, md5({_DROPPED}) AS hash FROM x",
    "q_missing_images": rf"""WITH {_ATTEMPTS}, x AS (SELECT doc_id, page_num, attempt_seq, regexp_extract_all(text, '!\[[^\]]*\]\(\s*([^)]+?)\s*\)', 1) AS refs FROM a WHERE contains(text, '![')),
r AS (SELECT doc_id, page_num, attempt_seq, unnest(refs) AS ref FROM x)
SELECT x.doc_id, x.page_num, x.attempt_seq, len(refs) AS had, (SELECT count(*) FROM r WHERE r.doc_id = x.doc_id AND r.page_num = x.page_num AND r.attempt_seq = x.attempt_seq
  AND (regexp_matches(ref, '^(?:https?://|data:)') OR ref IN (SELECT name FROM file_listing))) AS keeps FROM x""",
    "q_best_reading": _SCORED
    + """SELECT doc_id, page_num, attempt_seq, viable, n_attempts, any_passed, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY viable DESC, CASE WHEN viable THEN score END DESC NULLS LAST, attempt_seq) AS k,
  count(*) OVER (PARTITION BY doc_id, page_num) AS n_attempts, max(coalesce(audit_passed, false)::INT) OVER (PARTITION BY doc_id, page_num) = 1 AS any_passed FROM scored) WHERE k = 1""",
    "q_discrepancies": f"""WITH {_ATTEMPTS}, s AS (SELECT *, lower(engine) AS eng, coalesce(audit_passed, false) AS ok, {_words("coalesce(text, '')")} AS n FROM a),
e AS (SELECT doc_id, page_num, eng, count(*) AS k, max(n) AS most, arg_max(ok, attempt_seq) AS ok FROM s GROUP BY doc_id, page_num, eng),
g AS (SELECT doc_id, page_num, count(*) AS k, CASE WHEN avg(n) > 0 THEN (max(n) - min(n)) / avg(n) ELSE 0.0 END AS spread FROM s GROUP BY doc_id, page_num),
l AS (SELECT doc_id, page_num, max(ok::INT) = 1 AS any_ok, min(ok::INT) = 1 AS all_ok, string_agg(eng || '=' || most, ', ' ORDER BY most DESC, eng) AS words,
  coalesce(string_agg(eng, ', ' ORDER BY eng) FILTER (WHERE ok), '') AS p, coalesce(string_agg(eng, ', ' ORDER BY eng) FILTER (WHERE NOT ok), '') AS f FROM e GROUP BY doc_id, page_num)
SELECT g.doc_id, g.page_num, round(CASE WHEN k > 1 THEN spread ELSE 0.0 END, 6) AS spread, k > 1 AND spread > 0.3 AS wide, k > 1 AND any_ok AND NOT all_ok AS divided,
  concat_ws('; ', CASE WHEN k > 1 AND spread > 0.3 THEN 'Word count spread: ' || words END, CASE WHEN k > 1 AND any_ok AND NOT all_ok THEN 'Audit divergence: passed=[' || p || '], failed=[' || f || ']' END) AS messages
FROM g JOIN l ON g.doc_id = l.doc_id AND g.page_num = l.page_num""",
    "q_top_readings": _SCORED
    + "SELECT doc_id, page_num, attempt_seq, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY score DESC, attempt_seq) AS rank FROM scored WHERE viable) WHERE rank <= 3",
    "q_repair_plan": _REPAIR + "SELECT * FROM plan",
    "q_repairs_by_engine": _REPAIR + "SELECT engine, failure, count(*) AS n_pages FROM plan GROUP BY engine, failure",
    "q_document_texts": _SCORED
    + f""", best AS (SELECT doc_id, page_num, text, coalesce(audit_passed, false) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY viable DESC, CASE WHEN viable THEN score END DESC NULLS LAST, attempt_seq) AS k FROM scored WHERE page_num > 0) WHERE k = 1),
{_NATIVE}, pg AS (SELECT n.doc_id, n.page_num, CASE WHEN b.ok THEN b.text WHEN regexp_matches(native_text, '[^{_S}]') THEN native_text ELSE b.text END AS t FROM n LEFT JOIN best b ON n.doc_id = b.doc_id AND n.page_num = b.page_num),
w AS (SELECT doc_id, count(*) AS n_parts, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num) AS t FROM pg WHERE t <> '' GROUP BY doc_id)
SELECT doc_id, n_parts, {_words('t')} AS n_words, md5(t) AS hash FROM w""",
    "q_split_documents": f"WITH {_NATIVE} SELECT doc_id, count(*) AS n_pages, sum(length(native_text)) AS n_chars FROM n WHERE regexp_matches(native_text, '[^{_S}]') GROUP BY doc_id",
    "q_chunks": f"WITH {_PAGES} SELECT doc_id, k AS chunk, (k - 1) * 20 + 1 AS first_page, least(k * 20, pages) AS last_page, least(k * 20, pages) - (k - 1) * 20 AS n_pages FROM (SELECT doc_id, pages, unnest(range(1, ((pages + 19) // 20) + 1)) AS k FROM p WHERE pages > 30)",
    "q_engines_used": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run_seq ORDER BY engine) AS rn FROM engine_runs) WHERE rn = 1),
e AS (SELECT doc_id, lower(engine) AS engine, min(run_seq) AS first, count(*) AS n, sum(processing_time) AS t FROM r GROUP BY doc_id, lower(engine))
SELECT doc_id, string_agg(engine, ',' ORDER BY first, engine) AS engines, sum(n) AS n_runs, round(sum(t), 4) AS processing_time FROM e GROUP BY doc_id""",
    "q_figure_clusters": _CLUSTERS + "SELECT * FROM clusters",
    "q_figure_regions": _CLUSTERS
    + """SELECT DISTINCT ON (page, x0::BIGINT, y0::BIGINT, x1::BIGINT, y1::BIGINT) page, x0, y0, x1, y1, n_boxes FROM clusters WHERE (x1 - x0) * (y1 - y0) >= 6400 AND x1 - x0 >= 50 AND y1 - y0 >= 50
  AND (x1 - x0) * (y1 - y0) / 800000.0 BETWEEN 0.025 AND 0.98 AND n_boxes >= 3""",
    "q_figures_numbered": f"""WITH {_BOXES}, f AS (SELECT *, page // 100 AS doc, x1 - x0 AS w, y1 - y0 AS h FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 6400 AND (x1 - x0) / greatest(y1 - y0, 1.0) BETWEEN 0.125 AND 8),
p AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0, y1, x1) AS k FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, k) AS figure_num FROM p WHERE k <= 3) SELECT doc, page, box_id, figure_num FROM d WHERE figure_num <= 25""",
    "q_engine_summary": _RUNS + f"SELECT engine, count(*) AS n_runs, count(wer) AS n_scored, round({_MEAN.format('wer')}, 6) AS mean_wer, round(coalesce({_MEAN.format('processing_time')}, 0.0), 6) AS mean_time FROM runs GROUP BY engine",
    "q_engine_rollup": _RUNS + f"SELECT engine, category, count(*) AS n_runs, round({_MEAN.format('wer')}, 6) AS mean_wer FROM runs GROUP BY ROLLUP (engine, category)",
    "q_engine_profiles": _RUNS
    + f"""SELECT engine, 'category' AS kind, category AS key, round({_MEAN.format('wer')}, 6) AS value FROM runs WHERE wer IS NOT NULL GROUP BY engine, category UNION ALL
SELECT engine, 'category', '_all', round({_MEAN.format('wer')}, 6) FROM runs WHERE wer IS NOT NULL GROUP BY engine UNION ALL
SELECT engine, 'failure', failure_mode, round(count(*) FILTER (WHERE wer < 0.5) / count(*)::DOUBLE, 6) FROM runs WHERE failure_mode <> 'none' GROUP BY engine, failure_mode UNION ALL
SELECT engine, 'time', '_all', round(coalesce({_MEAN.format('processing_time')}, 0.0), 6) FROM runs GROUP BY engine""",
    "q_engine_settings": _RUNS
    + f""", r AS (SELECT engine, category, {_MEAN.format('wer')} AS w FROM runs WHERE wer IS NOT NULL GROUP BY GROUPING SETS ((engine, category), (engine))),
o AS (SELECT e.engine, coalesce(avg(w), 1.0) AS rate FROM (SELECT DISTINCT engine FROM runs) e LEFT JOIN r ON r.engine = e.engine GROUP BY e.engine),
k AS (SELECT engine, row_number() OVER (ORDER BY rate, engine) AS k FROM o WHERE list_contains({_ENGINES}, engine))
SELECT max(engine) FILTER (WHERE k = 1) AS primary_engine, string_agg(engine, ',' ORDER BY k) FILTER (WHERE k > 1) AS fallback_chain FROM k""",
    "q_run_matrix": _RUNS
    + f""", papers AS (SELECT DISTINCT doc_id FROM handles WHERE paper_category IS NOT NULL), grid AS (SELECT doc_id, unnest(['nougat', 'deepseek', 'gemini', 'marker']) AS engine FROM papers),
l AS (SELECT doc_id, lower(engine) AS engine, status, failure_mode, processing_time FROM engine_runs QUALIFY row_number() OVER (PARTITION BY doc_id, lower(engine) ORDER BY run_seq DESC, status DESC NULLS LAST, failure_mode DESC NULLS LAST, processing_time DESC NULLS LAST) = 1),
sc AS (SELECT doc_id, engine, {_MEAN.format('wer')} AS wer FROM runs WHERE wer IS NOT NULL GROUP BY doc_id, engine),
j AS (SELECT g.doc_id, g.engine, l.doc_id IS NOT NULL AND g.engine <> 'marker' AS usable, coalesce(lower(l.status), 'pending') AS st, failure_mode, processing_time, sc.wer FROM grid g LEFT JOIN l ON g.doc_id = l.doc_id AND g.engine = l.engine LEFT JOIN sc ON g.doc_id = sc.doc_id AND g.engine = sc.engine)
SELECT doc_id, engine, CASE WHEN usable THEN st ELSE 'error' END AS status, CASE WHEN usable THEN coalesce(failure_mode, 'none') ELSE 'model_unavailable' END AS failure_mode,
  round(CASE WHEN usable THEN coalesce(processing_time, 0.0) ELSE 0.0 END, 4) AS processing_time, round(CASE WHEN usable AND st = 'success' THEN wer END, 6) AS wer FROM j""",
    "q_score_json": _RUNS
    + """, p AS (SELECT DISTINCT doc_id, engine, page_num FROM runs WHERE wer IS NOT NULL AND page_num > 0)
SELECT doc_id AS paper_name, engine, 0.25::DOUBLE AS overall_wer, 0.5::DOUBLE AS overall_cer, 2.5::DOUBLE AS processing_time, count(*)::INT AS n_pages, string_agg(page_num::VARCHAR, ',' ORDER BY page_num) AS pages FROM p GROUP BY doc_id, engine""",
    "q_recovery": _RUNS + "SELECT engine, failure_mode, count(*) AS n, round(count(*) FILTER (WHERE wer < 0.5) / count(*)::DOUBLE, 6) AS recovered FROM runs WHERE failure_mode <> 'none' GROUP BY engine, failure_mode",
    "q_engine_ranking": _RANKED + "SELECT category, engine, rank, round(rate, 6) AS rate FROM ranked",
    "q_engine_chains": _RANKED + "SELECT category, string_agg(engine, ',' ORDER BY rank) AS chain FROM ranked GROUP BY category",
    "q_responses": f"""WITH {_ATTEMPTS}, x AS (SELECT *, coalesce(trim(text, ' '), '') AS t FROM a) SELECT doc_id, page_num, attempt_seq, CASE WHEN coalesce(status, '') = 'error' THEN 'api_error' WHEN length(t) < 10 THEN 'empty_output' ELSE 'none' END AS failure, length(t) AS n_chars FROM x""",
    "q_figure_types": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(w)}') THEN '{t}'" for t, w in text.FIGURE_TYPES.items()) + " ELSE 'unknown' END AS figure_type FROM documents",
    "q_event_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q_stream_totals": _AUDIT.replace("CASE WHEN a.page_num = 0 THEN coalesce(p.pages, 0) ELSE 0 END AS pages", "0 AS pages") + "SELECT engine, primary_failure, count(*) AS n FROM audited GROUP BY engine, primary_failure",
    "q_audit_warnings": _AUDIT
    + rf"""SELECT doc_id, page_num, attempt_seq, array_to_string(w, ',') AS warnings, array_to_string(r, ',') AS patterns, CASE WHEN len(e) >= 2 THEN 0.95 WHEN len(e) = 1 AND len(w) >= 1 THEN 0.85 WHEN len(e) = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence FROM (
  SELECT *, CASE WHEN blank OR refusal THEN []::VARCHAR[] ELSE list_filter([CASE WHEN NOT (mwl BETWEEN 2.0 AND 15.0) THEN 'mean_word_length' END, CASE WHEN regexp_matches(t, '[\x{{fffd}}\x{{e000}}-\x{{f8ff}}\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'unicode' END, CASE WHEN len(r) > 0 THEN 'patterns' END], lambda x: x IS NOT NULL) END AS w FROM (
  SELECT *, CASE WHEN n > 0 THEN list_sum(list_transform(v, lambda x: length(x)))::DOUBLE / n ELSE 0.0 END AS mwl, list_filter([
    CASE WHEN len(list_filter(range(1, length(t) - 3), lambda i: t[i] <> chr(10) AND t[i] <> chr(13) AND t[i:i + 4] = repeat(t[i], 5))) > 0 THEN 'repeated chars' END,
    CASE WHEN len(list_filter(range(1, greatest(len(lw) - 1, 1)), lambda i: lw[i] <> '' AND regexp_matches(lw[i], '[\p{{L}}\p{{N}}_]$') AND regexp_extract(lw[i], '[\p{{L}}\p{{N}}_]+$') = lw[i + 1] AND regexp_extract(lw[i + 2], '^[\p{{L}}\p{{N}}_]+') = lw[i + 1])) > 0 THEN 'repeated words' END,
    CASE WHEN len(list_filter(range(1, length(t) - 6), lambda i: NOT contains(t[i:i + 1], chr(10)) AND t[i:i + 7] = repeat(t[i:i + 1], 4))) > 0 THEN 'alternating patterns' END], lambda x: x IS NOT NULL) AS r FROM (
  SELECT *, regexp_extract_all(t, '[^{_S}]+') AS v, list_transform(regexp_split_to_array(t, '[ \t\n\r\f\x0b]+'), lambda x: lower(x)) AS lw FROM audited)))""",
    "q_audit_details": _AUDIT
    + f"""SELECT doc_id, page_num, attempt_seq, x.mode AS mode, x.detail AS detail FROM (SELECT doc_id, page_num, attempt_seq, unnest(list_filter(list_transform(e, lambda k, i: {{'mode': CASE k {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.MODE_OF.items())} END, 'at': i,
  'detail': CASE k {_TEMPLATES} END || ' (' || CASE k {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.VALUES.items())} WHEN 'formatting' THEN ({_FORMAT})::VARCHAR || ' formatting instruction patterns detected' WHEN 'word_count' THEN n::VARCHAR
  WHEN 'truncation' THEN (round_even(n::DOUBLE / pages, 0)::BIGINT)::VARCHAR || ' words/page (' || n || ' words / ' || pages || ' pages)' WHEN 'garbage' THEN '%' END || ')'}}),
  lambda q: NOT list_contains(list_transform(list_filter(list_transform(e, lambda k2, j: {{'m': CASE k2 {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.MODE_OF.items())} END, 'j': j}}), lambda z: z.j > q.at), lambda z: z.m), q.mode))) AS x FROM audited WHERE NOT passed)""",
    "q_normalized_ascii": rf"WITH {_ATTEMPTS}, x AS (SELECT *, text AS t, lower(engine) AS e FROM a WHERE NOT regexp_matches(text, '[^\x00-\x7f]')), y AS (SELECT *, CASE WHEN text = '' THEN '' ELSE {_tidy(_BY_ENGINE)} END AS u FROM x) SELECT doc_id, page_num, attempt_seq, {_HASHED.format('u')} FROM y",
    "q_cli_texts": rf"WITH x AS (SELECT doc_id, {_tidy('text')} AS t FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7f]')) SELECT doc_id, {_HASHED.format('t')} FROM x",
    "q_file_stems": r"SELECT DISTINCT path, trim(regexp_replace(string_split(path, '/')[-1], '[^\p{L}\p{N}._\- ]', '_', 'g')) AS stem FROM handles",
    "q_markdown_tables": """WITH o AS (SELECT DISTINCT doc_id, page_num, title FROM outline WHERE page_num IS NOT NULL)
SELECT doc_id, '| page | title |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || page_num || ' | ' || coalesce(trim(title), '') || ' |', chr(10) ORDER BY page_num, title NULLS FIRST) AS markdown FROM o GROUP BY doc_id""",
    "q_plain_formulas": rf"""WITH {_ATTEMPTS}, f AS (SELECT DISTINCT doc_id, page_num, attempt_seq, unnest(regexp_extract_all(text, '\$([^$\n]+)\$', 1)) AS formula FROM a WHERE contains(text, '$'))
SELECT doc_id, page_num, attempt_seq, formula, replace(replace(regexp_replace({_strip('formula')}, '[ \t\n\r\f\x0b]+', ' ', 'g'), '\ ', ' '), '\,', ' ') AS plain FROM f""",
    "q_phantom_images": rf"""WITH {_ATTEMPTS}, x AS (SELECT doc_id, page_num, attempt_seq, text, list_distinct(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)')) AS refs FROM a WHERE contains(text, '!['))
SELECT doc_id, page_num, attempt_seq, regexp_replace(list_reduce(list_prepend(text, list_filter(refs, lambda r: NOT regexp_matches(r, '^!\[[^\]]*\]\(\s*(?:https?://|data:|/)'))), lambda t, r: replace(t, r, '')), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM x""",
    "q_arbiter_choices": f"""WITH {_ATTEMPTS} SELECT doc_id, page_num, attempt_seq, CASE WHEN b THEN CASE attempt_seq WHEN 1 THEN lower(engine) WHEN 2 THEN 'other' ELSE 'llm-merged' END END AS chosen, CASE WHEN b THEN length(trim(text, ' ')) END AS n_chars
FROM (SELECT *, coalesce(regexp_matches(trim(text, ' '), '[^{_S}]'), false) AS b FROM a)""",
    "q_page_states": _STATES + "SELECT * FROM st",
    "q_whole_states": _STATES + "SELECT * FROM wh",
    "q_scored_pages": _SCORED_STATES + _RESCORED.format("CASE WHEN has_text OR n_attempts = 0 THEN best_seq WHEN ok THEN coalesce(best_seq, last_seq) WHEN best_seq = last_seq THEN NULL ELSE best_seq END"),
    "q_scored_multi": _SCORED_STATES + _RESCORED.format("coalesce(best_seq, first_ok)"),
    "q_scored_documents": _SCORED_STATES + "SELECT d.doc_id, d.attempt_seq, CASE WHEN passed THEN 'success' ELSE 'audit_failed' END AS status, primary_failure AS failure FROM audited d JOIN a ON a.doc_id = d.doc_id AND a.page_num = d.page_num AND a.attempt_seq = d.attempt_seq WHERE d.page_num = 0 AND lower(coalesce(a.status, '')) <> 'error'",
    "q_consensus_gate": _STATES + "SELECT doc_id, page_num FROM st WHERE n_attempts >= 2 AND NOT has_text UNION ALL SELECT doc_id, 0 FROM wh WHERE n_whole >= 2",
    "q_consensus": _STATES
    + f""", gate AS (SELECT doc_id, page_num FROM st WHERE n_attempts >= 2 AND NOT has_text UNION ALL SELECT doc_id, 0 FROM wh WHERE n_whole >= 2), s AS{_VIABLE_SCORE},
k AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY viable DESC, CASE WHEN viable THEN score END DESC NULLS LAST, attempt_seq) AS k, count(*) FILTER (WHERE viable) OVER (PARTITION BY doc_id, page_num) AS n_viable,
  max(coalesce(audit_passed, false)::INT) OVER (PARTITION BY doc_id, page_num) = 1 AS any_passed FROM scored s SEMI JOIN gate g ON s.doc_id = g.doc_id AND s.page_num = g.page_num)
SELECT k.doc_id, k.page_num, attempt_seq, 'consensus(' || lower(engine) || ')' AS engine, n_viable, any_passed, CASE WHEN NOT viable THEN 'all readings failed or are empty' END AS note FROM k WHERE k = 1""",
    "q_text_sources": _STATES + _SOURCES + "SELECT * FROM src",
    "q_assembled": _STATES
    + _SOURCES
    + rf""", {_NATIVE}, parts AS (SELECT src.doc_id, src.page_num, CASE WHEN source = 'reading' THEN a.text ELSE n.native_text END AS t FROM src LEFT JOIN a ON src.source = 'reading' AND a.doc_id = src.doc_id AND a.page_num = src.page_num AND a.attempt_seq = src.attempt_seq
  LEFT JOIN n ON src.source = 'native' AND n.doc_id = src.doc_id AND n.page_num = src.page_num),
txt AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num) AS t FROM parts WHERE t <> '' GROUP BY doc_id),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run_seq ORDER BY engine) AS rn FROM engine_runs) WHERE rn = 1),
en AS (SELECT doc_id, lower(engine) AS engine, min(run_seq) AS first, sum(processing_time) AS t, sum(cost) AS c FROM rr GROUP BY doc_id, lower(engine)),
us AS (SELECT doc_id, string_agg(engine, ',' ORDER BY first, engine) AS engines, sum(t) AS time, sum(c) AS cost FROM en GROUP BY doc_id),
nd AS (SELECT doc_id, count(*) FILTER (WHERE needs_repair) AS n_repair FROM st GROUP BY doc_id),
al AS (SELECT p.doc_id, coalesce(n_repair, 0) AS n_repair, coalesce(n_repair, 0) = 0 OR passing_seq IS NOT NULL AS ok, coalesce(regexp_matches(txt.t, '[^{_S}]'), false) AS has_text, txt.t, engines, time, us.cost FROM p LEFT JOIN nd ON p.doc_id = nd.doc_id LEFT JOIN wh ON p.doc_id = wh.doc_id LEFT JOIN txt ON p.doc_id = txt.doc_id LEFT JOIN us ON p.doc_id = us.doc_id),
im AS (SELECT *, CASE WHEN contains(t, '![') THEN regexp_replace(list_reduce(list_prepend(t, list_filter(list_distinct(regexp_extract_all(t, '!\[[^\]]*\]\([^)]+\)')), lambda r: NOT regexp_matches(r, '^!\[[^\]]*\]\(\s*(?:https?://|data:|/)'))), lambda u, r: replace(u, r, '')), '\n{{3,}}', chr(10) || chr(10), 'g') ELSE t END AS clean FROM al)
SELECT doc_id, CASE WHEN has_text AND ok THEN 'success' WHEN has_text THEN 'audit_failed' ELSE 'error' END AS status, ok AS pages_ok, n_repair, CASE WHEN t IS NULL THEN 0 ELSE {_words('t')} END AS n_words, coalesce(engines, '') AS engines, round(coalesce(cost, 0.0), 4) AS cost, round(coalesce(time, 0.0), 4) AS processing_time, md5(clean) AS hash FROM im""",
    "q_backbone_routes": _STATES + _ROUTES + "SELECT * FROM routes",
    "q_backbone_tasks": _STATES + _ROUTES + _TASKS.format(native=_PROSE, call="call", keep="") + "SELECT * FROM tasks",
    "q_backbone_without_vision": _STATES + _ROUTES + _TASKS.format(native=f"({_PROSE} OR born_digital AND enhance AND has_text)", call="error", keep="AND NOT (born_digital AND enhance AND NOT has_text)") + "SELECT doc_id, engine, action, count(*) AS n FROM tasks GROUP BY doc_id, engine, action",
    "q_multi_engine_tasks": f"WITH {_PAGES} SELECT doc_id, 'gemini' AS engine, 1 AS n, pages AS last_page FROM p UNION ALL SELECT doc_id, 'gemini-api', pages, pages FROM p",
    "q_standard_results": _AUDIT.replace(_ATTEMPTS, "a AS (SELECT doc_id, 1 AS page_num, run_seq AS attempt_seq, engine, status, markdown AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run_seq ORDER BY engine) AS rn FROM engine_runs) WHERE rn = 1)")
    + """, r AS (SELECT d.doc_id, d.attempt_seq AS run_seq, d.engine, NOT blank AND lower(coalesce(a.status, '')) = 'success' AS gave, passed, primary_failure AS failure, CASE d.engine WHEN 'deepseek' THEN 0 WHEN 'gemini' THEN 1 WHEN 'mistral' THEN 2 WHEN 'nougat' THEN 3 END AS place FROM audited d JOIN a ON a.doc_id = d.doc_id AND a.attempt_seq = d.attempt_seq),
pr AS (SELECT * FROM r WHERE place = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run_seq DESC) = 1), fb AS (SELECT * FROM r WHERE place > 0 AND gave QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, run_seq) = 1),
x AS (SELECT pr.doc_id, pr.gave AND NOT pr.passed AND fb.doc_id IS NOT NULL AS other, pr.run_seq AS pseq, pr.engine AS pe, pr.gave, pr.passed, pr.failure, fb.run_seq AS fseq, fb.engine AS fe FROM pr LEFT JOIN fb ON pr.doc_id = fb.doc_id),
y AS (SELECT doc_id, CASE WHEN other THEN fseq ELSE pseq END AS run_seq, CASE WHEN other THEN fe ELSE pe END AS engine, CASE WHEN NOT gave THEN 'error' WHEN other OR passed THEN 'success' ELSE 'audit_failed' END AS status, CASE WHEN other THEN 'none' ELSE failure END AS failure FROM x)
SELECT *, status = 'success' AS saved FROM y""",
    "q_repair_needed": _STATES
    + f""", r AS (SELECT *, lower(engine) AS e FROM a WHERE page_num > 0), g0 AS (SELECT doc_id, page_num, arg_max(failure_mode, attempt_seq) FILTER (WHERE failure_mode <> 'none') AS failure, list_sort(coalesce(list(DISTINCT e) FILTER (WHERE list_contains({_ENGINES}, e)), []::VARCHAR[])) AS tried FROM r GROUP BY doc_id, page_num),
g AS (SELECT st.doc_id, st.page_num, coalesce(failure, 'empty_output') AS failure, coalesce(tried, []::VARCHAR[]) AS tried, false AS passed FROM st LEFT JOIN g0 ON st.doc_id = g0.doc_id AND st.page_num = g0.page_num WHERE needs_repair)"""
    + ",\nc AS" + _REPAIR.split("\nc AS", 1)[1]
    + "SELECT *, 'failure=' || failure || ', tried=[' || replace(tried, ',', ', ') || '], selected=' || coalesce(engine, 'none') AS reason FROM plan",
    "q_figure_blocks": """WITH o AS (SELECT doc_id, page_num, min(title) AS d FROM outline WHERE page_num IS NOT NULL AND title IS NOT NULL GROUP BY doc_id, page_num), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS k FROM o)
SELECT doc_id, string_agg('**Figure ' || k || '** (page ' || page_num || '): ' || d || chr(10) || chr(10) || '![Figure ' || k || '](figures/' || k || '.png)', chr(10) || chr(10) ORDER BY k) AS blocks FROM f WHERE k % 3 <> 0 GROUP BY doc_id""",
    "q_figure_contexts": _STATES
    + """, f AS (SELECT DISTINCT doc_id, page_num FROM outline WHERE page_num IS NOT NULL), w0 AS (SELECT doc_id, arg_min(substr(text, 1, 500), attempt_seq) AS t FROM a WHERE page_num = 0 AND text <> '' GROUP BY doc_id),
x AS (SELECT f.doc_id, f.page_num, coalesce(substr(a.text, 1, 500), w0.t, '') AS c FROM f LEFT JOIN st ON f.doc_id = st.doc_id AND f.page_num = st.page_num LEFT JOIN a ON a.doc_id = st.doc_id AND a.page_num = st.page_num AND a.attempt_seq = st.best_seq LEFT JOIN w0 ON f.doc_id = w0.doc_id)
SELECT doc_id, page_num, md5(c) AS hash, length(c)::INT AS n_chars FROM x""",
    "q_formula_counts": rf"""WITH {_ATTEMPTS}, x AS (SELECT doc_id, page_num, attempt_seq, len(regexp_extract_all(text, '\$\$[^$]+\$\$')) AS d, len(regexp_extract_all(text, '(?s)\\begin\{{equation\*?\}}.+?\\end\{{equation\*?\}}')) + len(regexp_extract_all(text, '(?s)\\begin\{{align\*?\}}.+?\\end\{{align\*?\}}'))
  + len(regexp_extract_all(text, '(?s)\\begin\{{gather\*?\}}.+?\\end\{{gather\*?\}}')) + len(regexp_extract_all(text, '(?s)\\begin\{{multline\*?\}}.+?\\end\{{multline\*?\}}')) AS v FROM a)
SELECT doc_id, page_num, attempt_seq, 'dollars' AS kind, d AS n FROM x WHERE d > 0 UNION ALL SELECT doc_id, page_num, attempt_seq, 'environment', v FROM x WHERE v > 0""",
    "q_two_engine_pages": f"""WITH {_ATTEMPTS}, {_PAGES}, known AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page_num FROM p), r AS (SELECT *, lower(engine) AS e FROM a WHERE page_num > 0 AND lower(engine) IN ('gemini-api', 'deepseek-vllm')),
g AS (SELECT doc_id, page_num, arg_max(text, attempt_seq) FILTER (WHERE e = 'gemini-api') AS pt, max(attempt_seq) FILTER (WHERE e = 'gemini-api') AS p, arg_min(text, attempt_seq) AS ft, arg_min(e, attempt_seq) AS fe, max(attempt_seq) FILTER (WHERE e = 'deepseek-vllm') AS s, arg_max(text, attempt_seq) FILTER (WHERE e = 'deepseek-vllm') AS sx FROM r GROUP BY doc_id, page_num),
b AS (SELECT doc_id, page_num, CASE WHEN p IS NOT NULL THEN 'gemini-api' ELSE fe END AS be, s FROM g),
z AS (SELECT a.doc_id, a.page_num, max(a.attempt_seq) AS q FROM r a GROUP BY a.doc_id, a.page_num),
t AS (SELECT b.*, CASE WHEN be = 'gemini-api' THEN (SELECT max_by(coalesce(text, ''), attempt_seq) FROM r WHERE r.doc_id = b.doc_id AND r.page_num = b.page_num AND e = 'gemini-api') ELSE (SELECT min_by(coalesce(text, ''), attempt_seq) FROM r WHERE r.doc_id = b.doc_id AND r.page_num = b.page_num) END AS bt,
  (SELECT max_by(coalesce(text, ''), attempt_seq) FROM r WHERE r.doc_id = b.doc_id AND r.page_num = b.page_num AND e = 'deepseek-vllm') AS st FROM b)
SELECT k.doc_id, k.page_num, CASE WHEN be IS NULL THEN NULL WHEN s IS NOT NULL AND be <> 'deepseek-vllm' THEN 'reconciled(' || be || ',deepseek-vllm)' ELSE 'reconciled(' || be || ')' END AS engine,
  CASE WHEN be IS NULL THEN 'error' WHEN bt <> '' THEN 'success' ELSE 'error' END AS status, CASE WHEN be IS NULL THEN 'no engine gave output' END AS error FROM known k LEFT JOIN t ON k.doc_id = t.doc_id AND k.page_num = t.page_num""",
    "q_upright_regions": _CLUSTERS + """SELECT DISTINCT ON (page, x0::BIGINT, y0::BIGINT, x1::BIGINT, y1::BIGINT) page, x0, y0, x1, y1, n_boxes FROM clusters WHERE (x1 - x0) * (y1 - y0) >= 6400 AND x1 - x0 >= 50 AND y1 - y0 >= 50
  AND (x1 - x0) * (y1 - y0) / 800000.0 BETWEEN 0.05 AND 0.85 AND n_boxes >= 5 AND NOT (((y0 + y1) / 2 < 100 OR (y0 + y1) / 2 > 900) AND n_boxes < 20)""",
    "q_slide_figures": _CLUSTERS + """, f AS (SELECT DISTINCT page FROM clusters WHERE (x1 - x0) * (y1 - y0) >= 6400 AND x1 - x0 >= 50 AND y1 - y0 >= 50 AND (x1 - x0) * (y1 - y0) / 800000.0 BETWEEN 0.025 AND 0.98 AND n_boxes > 4),
d AS (SELECT page, count(*) AS n FROM boxes GROUP BY page) SELECT page // 100 AS doc, page, 50.0::DOUBLE AS x0, 120.0::DOUBLE AS y0, 950.0::DOUBLE AS x1, 720.0::DOUBLE AS y1 FROM d WHERE n >= 4 AND page NOT IN (SELECT page FROM f)""",
    "q_new_images": _CLUSTERS + """, u AS (SELECT DISTINCT page, x0::BIGINT AS a, y0::BIGINT AS b, x1::BIGINT AS c, y1::BIGINT AS d FROM clusters WHERE (x1 - x0) * (y1 - y0) >= 6400 AND x1 - x0 >= 50 AND y1 - y0 >= 50
  AND (x1 - x0) * (y1 - y0) / 800000.0 BETWEEN 0.05 AND 0.85 AND n_boxes >= 5 AND NOT (((y0 + y1) / 2 < 100 OR (y0 + y1) / 2 > 900) AND n_boxes < 20)),
i AS (SELECT * FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 6400 AND (x1 - x0) / greatest(y1 - y0, 1.0) BETWEEN 0.125 AND 8)
SELECT page, min(box_id) AS box_id FROM i ANTI JOIN u ON i.page = u.page AND i.x0::BIGINT = a AND i.y0::BIGINT = b AND i.x1::BIGINT = c AND i.y1::BIGINT = d GROUP BY page, x0::BIGINT, y0::BIGINT, x1::BIGINT, y1::BIGINT""",
    "q_embedded_images": f"WITH {_BOXES} SELECT page, box_id, (x1 - x0) * 40 AS size_bytes FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 6400 AND (x1 - x0) / greatest(y1 - y0, 1.0) BETWEEN 0.125 AND 8 AND (x1 - x0) * 40 >= 5000",
    "q_event_stream": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q_first_events": "SELECT DISTINCT user_id, event_type FROM events",
    "q_batch_ledger": f"""WITH last AS (SELECT name, {_SPELT.format('checksum')} AS checksum, max(listed_at) OVER (PARTITION BY name) AS ts, row_number() OVER (PARTITION BY name ORDER BY listed_at DESC, checksum DESC NULLS LAST) AS rn FROM file_listing WHERE scan_id = (SELECT max(scan_id) FROM file_listing) AND name IS NOT NULL),
done AS (SELECT name, {_SPELT.format('checksum')} AS checksum, engine, pages, ts, recorded_at, log_id, 0 AS new FROM processed_files WHERE lower(trim(status)) = 'completed' AND name IS NOT NULL),
now AS (SELECT name, checksum FROM done QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC NULLS LAST, recorded_at DESC NULLS LAST, log_id DESC) = 1),
due AS (SELECT l.* FROM last l LEFT JOIN now n ON l.name = n.name WHERE rn = 1 AND (n.name IS NULL OR l.checksum IS NULL OR n.checksum IS NULL OR l.checksum <> n.checksum)),
every AS (SELECT name, checksum, engine, pages, ts, new FROM done UNION ALL SELECT name, checksum, 'deepseek', 1, ts, 1 FROM due WHERE length(name) % 5 <> 0)
SELECT name, checksum, engine, ts, pages FROM every QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, new DESC, checksum DESC NULLS LAST) = 1""",
}
