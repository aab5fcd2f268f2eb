import json

import pytest
from pyspark.sql import functions as F

from leafwright.common import hash_sample, new_folder, per_row
from leafwright.operators.incremental import VersionedTable
from leafwright.sources import providers, readers, writers
from leafwright.streaming import incremental


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b c.pdf").write_bytes(b"x")
    files = readers.scan_files(spark, str(tmp_path), "*").orderBy("path").collect()
    assert [r.stem for r in files] == ["a", "b c"] and len(files[0].file_hash) == 64
    out = {(r.path.rsplit("/")[-1], r.page_num): (r.text, r.error) for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert out["a.txt", 2] == ("two", None) and [v[1] for k, v in out.items() if k[1] is None] == ["no provider for this kind of file"]
    with pytest.raises(ValueError):
        readers.single_document(spark, "a.doc")


def test_ground_truth_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("p", 1, " first "), ("p", 2, ""), ("p", 10, "tenth")], "paper string, page_num int, truth string")
    writers.write_ground_truth(pages, str(tmp_path))
    got = {r.page_num: r.truth for r in readers.read_ground_truth(spark, str(tmp_path)).collect()}
    assert got == {1: "first", 10: "tenth"} and (tmp_path / "p/page_2.txt").read_text() == "" and (tmp_path / "p/full.txt").read_text() == " first \n\ntenth"


def test_markdown_and_engine_output(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "Body", "gemini")], "stem string, text string, engine string")
    head = writers.front_matter(F.lit("x.pdf"), F.col("engine"), F.lit(None).cast("string"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    writers.write_markdown(docs, str(tmp_path), header=head)
    assert (tmp_path / "a_b/a_b.md").read_text() == "---\nsource: x.pdf\nengine: gemini\nprocessed: 2024-01-02T03:04:05\n---\n\nBody"
    (tmp_path / "a_b.md").write_text("second choice")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/other.md").write_text("third choice")
    out = {r.stem: r.text for r in readers.read_engine_output(spark, str(tmp_path)).collect()}
    assert out["a_b"].endswith("Body") and out["c"] == "third choice"


def test_json_and_settings(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1, "b": "x"}]))
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_json(spark, str(tmp_path / "x.json"), "a int, b string").first().b == "x"
    assert readers.read_json(spark, str(tmp_path / "bad.json"), "a int, b string", corrupt_is_empty=True).count() == 0
    (tmp_path / "default.yaml").write_text("chunk_size: 7\nfallback_engine: glm\nunknown: 1\nnative_first: false\n")
    s = readers.read_settings(folder=str(tmp_path))
    assert (s.chunk_size, s.fallback_chain, s.native_first, s.timeout) == (7, ("glm",), False, 1800)
    assert readers.read_settings().chunk_size == 20
    with pytest.raises(ValueError):
        readers.read_settings(folder=str(tmp_path), profile="../x")


def test_missing_files(spark):
    papers = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "pdf_path string")
    with pytest.raises(FileNotFoundError, match="b.pdf"):
        readers.require_files(papers, spark.createDataFrame([("a.pdf",)], "path string"))


def test_engines_fail_as_rows(spark):
    def engine(content):
        if content == "slow":
            raise TimeoutError
        if content == "bad":
            raise RuntimeError("broke")
        return (content, 0.9)

    providers.register_engine("Test", engine)
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate(["fine", "slow", "bad", ""])], "doc_id string, page_num int, content string")
    out = {r.page_num: r for r in providers.run_engine(df, "test").collect()}
    assert [out[i].failure_mode for i in range(4)] == ["none", "timeout", "cli_error", "empty_output"] and [out[i].audit_passed for i in range(4)] == [True, False, False, False]
    with pytest.raises(ValueError):
        providers.engine("nobody")


def test_stream_commits_each_batch_once(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    table, progress = VersionedTable(spark, new_folder(spark, "streamed")), str(tmp_path / "progress")
    run = lambda: incremental.run_into(incremental.read_stream(spark, str(tmp_path / "in")), table, lambda df: df, progress).awaitTermination()
    run()
    spark.range(4, 6).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert sorted(r.id for r in table.read().collect()) == list(range(6))


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, k string")
    assert sorted(r.n for r in incremental.windowed_counts(df, "ts", "k").collect()) == [1, 2]


def test_per_row_and_sample(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    assert [tuple(r) for r in per_row(df, ["k"], ["t"], lambda: lambda t: (len(t),) if t else None, [("n", "int")]).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        per_row(df, ["k"], ["t"], lambda: None, [("k", "int")])
    many = spark.range(5000).withColumn("t", F.col("id").cast("string"))
    assert 50 < hash_sample(many, ["t"], 100).count() <= 200 and hash_sample(df, ["t"], 5).count() == 2
    assert sorted(r.id for r in hash_sample(many, ["t"], 100).collect()) == sorted(r.id for r in hash_sample(many.repartition(7), ["t"], 100).collect())
