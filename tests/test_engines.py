import base64
import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafwright.functions import pages
from leafwright.sources import engines, providers, readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes travel to the workers
JPEG = b"\xff\xd8\xff picture"


def done(code=0, out="", err=""):
    return subprocess.CompletedProcess([], code, out, err)


def test_command_lines():
    assert engines.command_line("gemini", "a.pdf", "out") == ["gemini-ocr", "a.pdf", "-o", "out", "--model", "gemini-3-flash-preview", "-q"]
    assert engines.command_line("deepseek", "a.pdf", "o", {"deepseek_backend": "vllm"}) == ["deepseek-ocr", "process", "a.pdf", "-o", "o", "--task", "ocr", "--vllm-url", "http://localhost:8000/v1"]
    assert engines.command_line("marker", "a.pdf", "o", quiet=False)[-2:] == ["--device", "auto"]
    with pytest.raises(ValueError):
        engines.command_line("vllm", "a.pdf", "o")


def test_availability(monkeypatch):
    monkeypatch.delenv("MISTRAL_API_KEY", raising=False)
    assert not engines.is_available("mistral", lambda c, s: done())
    monkeypatch.setenv("MISTRAL_API_KEY", "k")
    assert engines.is_available("mistral", lambda c, s: done()) and not engines.is_available("mistral", lambda c, s: done(1))

    def gone(c, s):
        raise FileNotFoundError

    assert not engines.is_available("nougat", gone) and "installed" in engines.missing_model("glm-ocr", gone)
    listing = "NAME ID\nglm-ocr:latest 1\n"
    assert engines.missing_model("glm-ocr", lambda c, s: done(0, listing)) is None and engines.missing_model("deepseek-ocr", lambda c, s: done(0, listing))


def writes(text, folder="document"):
    def run(command, seconds):
        out = command[command.index("-o") + 1]
        if text is not None:
            import os

            os.makedirs(f"{out}/{folder}", exist_ok=True)
            with open(f"{out}/{folder}/document.md", "w") as f:
                f.write(text)
        return done()

    return run


def late(command, seconds):
    raise subprocess.TimeoutExpired(command, seconds)


def test_command_engines(spark):
    cases = {"good": writes("# Title\n\ntext"), "other": writes("elsewhere", "deep/er"), "nothing": writes(None), "broken": lambda c, s: done(3, "", "no such font"), "slow": late}
    df = spark.createDataFrame([("a", 0, b"%PDF")], "doc_id string, page_num int, content binary")
    got = {}
    for name, run in cases.items():
        providers.register_engine(name, engines.CommandEngine("nougat", run=run))
        r = providers.run_engine(df, name).first()
        got[name] = (r.status, r.failure_mode, r.text)
    assert got == {"good": ("success", "none", "# Title\n\ntext"), "other": ("success", "none", "elsewhere"), "nothing": ("error", "empty_output", ""), "broken": ("error", "cli_error", ""), "slow": ("error", "timeout", "")}
    with pytest.raises(engines.EngineError) as e:
        engines.CommandEngine("glm", run=lambda c, s: done(1))(b"%PDF")
    assert e.value.failure == "model_unavailable"


def answers(status, body, seen=None):
    def transport(url, data, headers, seconds):
        if seen is not None:
            seen.append((url, json.loads(data) if data else None, headers))
        return status, body

    return transport


def test_http_engines(spark):
    chat = lambda t: json.dumps({"choices": [{"message": {"content": t}}]})
    generate = lambda t: json.dumps({"candidates": [{"content": {"parts": [{"text": t}]}}]})
    seen = []
    text = engines.HttpEngine("generate", "http://h", "m", "key", transport=answers(200, generate(" a page of text "), seen))(JPEG)
    assert text == ("a page of text", 0.85) and seen[0][0] == "http://h/models/m:generateContent?key=key"
    assert base64.b64decode(seen[0][1]["contents"][0]["parts"][0]["inline_data"]["data"]) == JPEG
    seen.clear()
    engines.HttpEngine("chat", "http://h", "m", "key", engines.SHORT_PROMPT, transport=answers(200, chat("a page of text"), seen))(JPEG)
    assert seen[0][2]["Authorization"] == "Bearer key" and seen[0][1]["messages"][0]["content"][1]["text"] == "Free OCR."
    for status, body, failure in ((500, "down", "api_error"), (200, chat("tiny"), "empty_output"), (200, "{}", "empty_output"), (200, "not json", "empty_output")):
        with pytest.raises(engines.EngineError) as e:
            engines.HttpEngine("chat", "http://h", "m", transport=answers(status, body))(JPEG)
        assert e.value.failure == failure
    with pytest.raises(engines.EngineError):
        engines.figures_only(JPEG)

    def slow(*a):
        raise TimeoutError

    df = spark.createDataFrame([("a", 1, JPEG)], "doc_id string, page_num int, content binary")
    providers.register_engine("slow-http", engines.HttpEngine("chat", "http://h", "m", transport=slow))
    assert providers.run_engine(df, "slow-http").first().failure_mode == "timeout"
    assert engines.HttpEngine("chat", "u", "m", transport=answers(200, '{"data": [{"id": "x"}]}')).available() and not engines.HttpEngine("chat", "u", "m", transport=answers(200, '{"data": []}')).available()
    assert not engines.HttpEngine("generate", "u", "m", transport=answers(200, "{}")).available() and not engines.HttpEngine("generate", "u", "m", "k", transport=slow).available()


def test_figures_are_described(spark):
    seen = []
    body = json.dumps({"choices": [{"message": {"content": "A scatter plot of prices against years."}}]})
    df = spark.createDataFrame([("a", 1, JPEG, None, "c" * 600, "kept"), ("a", 2, JPEG, "table", None, "kept")], "doc_id string, n int, image binary, figure_type string, context string, description string")
    out = {r.n: r for r in engines.described_figures(df, ["doc_id", "n"], engines.HttpEngine("chat", "u", "m", transport=answers(200, body))).collect()}
    assert (out[1].figure_type, out[2].figure_type) == ("graph", "graph") and out[1].description.startswith("A scatter")
    failed = engines.described_figures(df, ["doc_id", "n"], engines.HttpEngine("chat", "u", "m", transport=answers(503, ""))).collect()
    assert {(r.n, r.figure_type, r.description) for r in failed} == {(1, "unknown", "API error (503)"), (2, "table", "API error (503)")}
    prompts = [r.p for r in df.select(engines.figure_prompt(F.col("figure_type"), F.col("context")).alias("p")).collect()]
    assert prompts[0].endswith("text: " + "c" * 500) and prompts[1].startswith("This appears to be a table. Describe")
    ask = engines.ask_local("m", transport=answers(200, '{"response": "x"}', seen))
    assert ask("p") == "x" and seen[0][1]["stream"] is False and engines.ask_local("m", transport=answers(500, ""))("p") is None


@pytest.mark.parametrize(("text", "kind"), [("A heatmap", "map"), ("a notable formula", "table"), ("scatter plot of prices", "graph"), ("a flowchart", "chart"), ("its architecture", "diagram"), ("the formula", "equation"), ("nothing", "unknown"), (None, "unknown")])
def test_figure_types(one, text, kind):
    from leafwright.functions.text import figure_type

    assert one(figure_type, text) == kind


def test_structured_pages(spark):
    blocks = [("a", 1, 1, 0.0, 0.0, 100.0, 10.0, [" Title "]), ("a", 1, 2, 0.0, 20.0, 100.0, 40.0, ["cell 1", "cell 2"]), ("a", 1, 3, 0.0, 50.0, 100.0, 60.0, ["after", " "]), ("a", 1, 4, 0.0, 70.0, 100.0, 80.0, None), ("b", 1, 1, 0.0, 0.0, 9.0, 9.0, ["plain"])]
    tables = [("a", 1, 0.0, 18.0, 100.0, 42.0, [["h", None], ["1", "2"]]), ("a", 1, 0.0, 90.0, 100.0, 99.0, [["last"]]), ("a", 1, 0.0, 50.0, 100.0, 60.0, []), ("c", 1, 0.0, 0.0, 1.0, 1.0, [["only"]])]
    b = spark.createDataFrame(blocks, "doc_id string, page_num int, block_id int, x0 double, y0 double, x1 double, y1 double, lines array<string>")
    t = spark.createDataFrame(tables, "doc_id string, page_num int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>")
    out = {r.doc_id: r.text for r in pages.structured_text(b, t).collect()}
    assert out == {"a": "Title\n\n| h |  |\n| --- | --- |\n| 1 | 2 |\n\nafter\n\n| last |\n| --- |", "b": "plain", "c": "| only |\n| --- |"}
    assert pages.structured_text(b, t.limit(0)).count() == 2 and pages.structured_text(b.limit(0), t.limit(0)).count() == 0


def test_one_page(spark):
    df = spark.createDataFrame([("a", 1, True)], "doc_id string, page_num int, is_born_digital boolean")
    assert pages.one_page(df, "a", 1).first().is_born_digital
    with pytest.raises(ValueError):
        pages.one_page(df, "a", 2)


def test_settings_file(spark, tmp_path):
    writers.write_settings(spark, readers.Settings(primary_engine="nougat", fallback_chain=("glm", "gemini")), f"{tmp_path}/set/default.yaml")
    back = readers.read_settings(f"{tmp_path}/set/default.yaml")
    assert (back.primary_engine, back.fallback_chain) == ("nougat", ("glm", "gemini"))
    assert writers.settings_yaml(readers.Settings(fallback_chain=())).endswith("fallback_chain: []\n")
