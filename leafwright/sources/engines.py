"""Engines behind command lines and HTTP, as functions for ``providers.register_engine``.

Each is made with its settings and travels to the executors; what it needs there (a program, a key, a server) is looked for
where it runs.  A failure is an EngineError with its failure mode, which ``providers.run_engine`` makes a row of.
"""

from __future__ import annotations

import base64
import io
import json
import os
import subprocess
import tempfile
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import per_row
from ..functions.text import figure_type

# Programs, their arguments ({pdf}, {out} and settings), whether they know a quiet flag, keys of which one must be set, and the local model they need.
COMMANDS = {
    "gemini": ("gemini-ocr", "{pdf} -o {out} --model {gemini_model}", True, ("GEMINI_API_KEY", "GOOGLE_API_KEY"), None),
    "mistral": ("mistral-ocr", "{pdf} -o {out} --model {mistral_model}", False, ("MISTRAL_API_KEY",), None),
    "nougat": ("nougat-ocr", "{pdf} -o {out} --model {nougat_model}", True, (), None),
    "marker": ("marker-ocr", "{pdf} -o {out} --device {marker_device}", True, (), None),
    "deepseek": ("deepseek-ocr", "process {pdf} -o {out} --task ocr", False, (), "deepseek-ocr"),
    "glm": ("glm-ocr", "process {pdf} -o {out} --backend {glm_backend}", False, (), "glm-ocr"),
}
# What the commands are set to.
DEFAULTS = {"gemini_model": "gemini-3-flash-preview", "mistral_model": "mistral-ocr-latest", "nougat_model": "0.1.0-small", "marker_device": "auto", "glm_backend": "ollama", "deepseek_backend": "ollama", "deepseek_vllm_url": "http://localhost:8000/v1"}
# Prompts for pages and figures.
PAGE_PROMPT = "Extract all text from this page. Preserve formatting, equations, tables, and structure. Output as clean markdown."
SHORT_PROMPT = "Free OCR."
FIGURE_PROMPT = (
    "Describe this figure in detail. What does the chart, graph, table, or diagram show? Explain the axes, data, key findings, and any notable patterns or trends. "
    "Be specific about numbers, labels, and relationships shown."
)
#: A shorter answer is no text.
LEAST_CHARS = 10
CONFIDENCE = 0.85

#: (url, body or None, headers, seconds) -> status and body
Transport = Callable[[str, bytes | None, dict, float], tuple[int, str]]


class EngineError(Exception):
    def __init__(self, failure: str, message: str):
        super().__init__(message)
        self.failure = failure


def _run(command: list[str], seconds: float) -> subprocess.CompletedProcess:
    return subprocess.run(command, capture_output=True, text=True, timeout=seconds)


def command_line(name: str, pdf: str, out: str, settings: dict | None = None, quiet: bool = True) -> list[str]:
    """The command of an engine; unknown engines and those without one are an error."""
    if name not in COMMANDS:
        raise ValueError(f"no command-line engine: {name}")
    program, arguments, knows_quiet, _, _ = COMMANDS[name]
    values = DEFAULTS | (settings or {}) | {"pdf": pdf, "out": out}
    line = [program, *(a.format(**values) for a in arguments.split())]
    if name == "deepseek" and values["deepseek_backend"] == "vllm":
        line += ["--vllm-url", values["deepseek_vllm_url"]]
    return line + ["-q"] * (quiet and knows_quiet)


def is_available(name: str, run=_run) -> bool:
    """Whether the engine's program answers within ten seconds, and one of its keys is set where it needs one."""
    program, _, _, keys, _ = COMMANDS[name]
    if keys and not any(os.environ.get(k) for k in keys):
        return False
    try:
        return run([program, "--version"], 10).returncode == 0
    except (subprocess.SubprocessError, OSError):
        return False


def missing_model(model: str, run=_run) -> str | None:
    """Why a local model can't be used; None if it is there."""
    try:
        found = run(["ollama", "list"], 10)
    except FileNotFoundError:
        return "the model server isn't installed"
    except subprocess.TimeoutExpired:
        return "the model server doesn't answer"
    if found.returncode != 0:
        return "the model server isn't running"
    names = {line.split()[0].split(":")[0] for line in found.stdout.strip().splitlines()[1:] if line.split()}
    return None if model in names else f"model {model} isn't there"


def output_text(out: str, stem: str) -> str | None:
    """The Markdown a program wrote: <stem>/<stem>.md, else <stem>.md, else the first other file below out; links that lead out of it don't count."""
    root = Path(out).resolve()
    others = sorted(p for p in root.rglob("*.md"))
    for p in [root / stem / f"{stem}.md", root / f"{stem}.md", *others]:
        if p.is_file() and root in p.resolve().parents:
            return p.read_text(encoding="utf-8", errors="replace")
    return None


@dataclass
class CommandEngine:
    """A program that reads the bytes of a PDF and leaves Markdown in a folder of its own."""

    name: str
    settings: dict = field(default_factory=dict)
    seconds: float = 1800
    run: Callable = _run

    def __call__(self, content: bytes) -> tuple[str, float]:
        model = COMMANDS[self.name][4]
        if model and (DEFAULTS | self.settings).get(f"{self.name}_backend") == "ollama" and (why := missing_model(model, self.run)):
            raise EngineError("model_unavailable", why)
        with tempfile.TemporaryDirectory() as folder:  # scratch of one call, gone with it
            pdf, out = f"{folder}/document.pdf", f"{folder}/out"
            os.mkdir(out)
            Path(pdf).write_bytes(bytes(content))
            try:
                done = self.run(command_line(self.name, pdf, out, self.settings), self.seconds)
            except subprocess.TimeoutExpired as e:
                raise TimeoutError(f"timeout after {self.seconds} s") from e
            if done.returncode != 0:
                raise EngineError("cli_error", f"exit code {done.returncode}: {(done.stderr or 'unknown error').strip()[:500]}")
            text = output_text(out, "document")
        if text is None:
            raise EngineError("empty_output", "no Markdown was written")
        return text, 1.0


def send(url: str, body: bytes | None, headers: dict, seconds: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError(str(e)) from e
        raise


def jpeg_base64(image: bytes, quality: int = 90) -> str:
    """An image as JPEG in base64; other formats need an image library."""
    if bytes(image[:2]) != b"\xff\xd8":
        from PIL import Image

        out = io.BytesIO()
        Image.open(io.BytesIO(bytes(image))).convert("RGB").save(out, format="JPEG", quality=quality)
        image = out.getvalue()
    return base64.b64encode(bytes(image)).decode()


@dataclass
class HttpEngine:
    """A model behind HTTP that reads the image of a page; kind: "generate" (contents of parts) or "chat" (messages)."""

    kind: str
    url: str
    model: str
    key: str = ""
    prompt: str = PAGE_PROMPT
    seconds: float = 120.0
    most_tokens: int = 8192
    transport: Transport = send

    def available(self) -> bool:
        """Whether the list of models can be had, with a key where one is needed; a chat server must serve at least one."""
        if self.kind == "generate" and not self.key:
            return False
        try:
            status, body = self.transport(f"{self.url}/models" + (f"?key={self.key}" if self.kind == "generate" else ""), None, self._headers(), 15.0)
            return status == 200 and (self.kind == "generate" or bool(json.loads(body).get("data")))
        except Exception:
            return False

    def _headers(self) -> dict:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.kind == "chat" and self.key else {})

    def ask(self, image: bytes, prompt: str, most_tokens: int | None = None) -> tuple[int, str]:
        """Status and body of the answer."""
        data, n = jpeg_base64(image), most_tokens or self.most_tokens
        if self.kind == "generate":
            url = f"{self.url}/models/{self.model}:generateContent?key={self.key}"
            body = {"contents": [{"parts": [{"inline_data": {"mime_type": "image/jpeg", "data": data}}, {"text": prompt}]}], "generationConfig": {"maxOutputTokens": n, "temperature": 0.1}}
        else:
            url = f"{self.url}/chat/completions"
            content = [{"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{data}"}}, {"type": "text", "text": prompt}]
            body = {"model": self.model, "messages": [{"role": "user", "content": content}], "max_tokens": n, "temperature": 0.1}
        return self.transport(url, json.dumps(body).encode(), self._headers(), self.seconds)

    def __call__(self, image: bytes) -> tuple[str, float]:
        try:
            status, body = self.ask(image, self.prompt)
        except TimeoutError as e:
            raise TimeoutError(f"timeout after {self.seconds} s") from e
        except Exception as e:
            raise EngineError("api_error", f"{type(e).__name__}: {e}") from e
        if status != 200:
            raise EngineError("api_error", f"status {status}: {body[:200]}")
        text = answer_text(body)
        if len(text) < LEAST_CHARS:
            raise EngineError("empty_output", "no text or hardly any")
        return text, CONFIDENCE


def answer_text(body: str) -> str:
    """The text of an answer of either kind; empty where there is none."""
    try:
        data = json.loads(body)
        if data.get("candidates"):
            return (data["candidates"][0].get("content", {}).get("parts") or [{}])[0].get("text", "").strip()
        return ((data.get("choices") or [{}])[0].get("message") or {}).get("content", "").strip()
    except (ValueError, AttributeError, TypeError):
        return ""


def figures_only(image: object) -> tuple[str, float]:
    """An engine that describes figures but reads no pages."""
    raise EngineError("api_error", "this engine only describes figures")


def ask_local(model: str, url: str = "http://localhost:11434", seconds: float = 120.0, transport: Transport = send) -> Callable[[str], str | None]:
    """A function prompt -> answer of a local model, None for any failure; for ``consensus.arbitrated``."""

    def ask(prompt: str) -> str | None:
        try:
            status, body = transport(f"{url}/api/generate", json.dumps({"model": model, "prompt": prompt, "stream": False}).encode(), {"Content-Type": "application/json"}, seconds)
            return json.loads(body).get("response", "") if status == 200 else None
        except Exception:
            return None

    return ask


def figure_prompt(kind: Column, context: Column) -> Column:
    """What is asked about a figure of a kind (unless unknown) in a context (its first 500 characters)."""
    named = F.when(F.coalesce(kind, F.lit("unknown")).isin("unknown", ""), F.lit("")).otherwise(F.concat(F.lit("This appears to be a "), kind, F.lit(". ")))
    around = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\nContext from surrounding text: "), F.substring(context, 1, 500))).otherwise("")
    return F.concat(named, F.lit(FIGURE_PROMPT), around)


def described_figures(figures: DataFrame, keys: list[str], engine: HttpEngine, image: str = "image", kind: str = "figure_type", context: str = "context") -> DataFrame:
    """keys, figure_type, description of each figure; every failure is a description, never an exception."""
    asked = figures.select(*keys, F.col(image).alias("_image"), F.coalesce(kind, F.lit("unknown")).alias("_kind"), figure_prompt(F.col(kind), F.col(context)).alias("_prompt"))

    def describe(data: bytes, prompt: str) -> tuple:
        try:
            status, body = engine.ask(data, prompt, 1024)
            text = answer_text(body) if status == 200 else f"API error ({status})"
            return (text if len(text) >= LEAST_CHARS else "Unable to generate meaningful description", status == 200 and len(text) >= LEAST_CHARS)
        except Exception as e:
            return f"API error: {type(e).__name__}: {e}", False

    said = per_row(asked, [*keys, "_kind"], ["_image", "_prompt"], lambda: describe, [("description", "string"), ("_ok", "boolean")])
    found = F.coalesce(figure_type(F.col("description"), None), F.col("_kind"))
    return said.select(*keys, F.when(F.col("_ok"), found).otherwise(F.col("_kind")).alias("figure_type"), "description")
