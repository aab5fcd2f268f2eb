"""Reading documents, pages, ground truth, benchmark sets, engine output and configuration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem, is_blank, strip

#: What turns a file into pages: content -> (page_num, text, n_fonts, n_images, n_tables) rows.
PageProvider = Callable[[bytes], Iterator[tuple[int, str, int, int, int]]]
_PROVIDERS: dict[str, PageProvider] = {}


def register_page_provider(extension: str, provider: PageProvider) -> None:
    _PROVIDERS[extension.lower().lstrip(".")] = provider


def _text_pages(content: bytes) -> Iterator[tuple[int, str, int, int, int]]:
    """Plain text with form feeds between pages."""
    for i, t in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield i, t, 1, 0, 0


register_page_provider("txt", _text_pages)


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """doc_id, path, stem, file_hash, size_bytes, modified_at of the files; hashed on the executors, contents dropped at once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.sha2("content", 256).alias("file_hash"), "path", F.regexp_replace(file_stem(name), r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).withColumn("doc_id", F.col("file_hash"))


def single_document(spark: SparkSession, path: str) -> DataFrame:
    """One PDF; another extension or a missing file is an error."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    return scan_files(spark, path, "*")


def read_pages(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, page_num, text, n_fonts, n_images, n_tables, error: what the provider of each file's extension gives.

    A provider's failure is a row with an error, not a failure of the task; so is a file without a provider.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    providers = dict(_PROVIDERS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_num", "text", "n_fonts", "n_images", "n_tables", "error"]
        for part in parts:
            rows = []
            for p, content in zip(part["path"], part["content"]):
                provider = providers.get(p.rsplit(".", 1)[-1].lower())
                try:
                    if provider is None:
                        raise ValueError("no provider for this kind of file")
                    rows += [(p, *page, None) for page in provider(bytes(content))]
                except Exception as e:
                    rows.append((p, None, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names if c == "page_num" or c.startswith("n_")})

    return files.mapInPandas(run, "path string, page_num int, text string, n_fonts int, n_images int, n_tables int, error string")


def _whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """value, f: content and path of each file; Spark leaves out files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.decode("content", "UTF-8").alias("value"), F.col("path").alias("f"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """paper, page_num, truth of the files <paper>/page_<n>.txt under path; an empty file is no truth."""
    rows = _whole_files(spark, path, "page_*.txt").withColumnRenamed("f", "_f")
    found = F.regexp_extract("_f", r"([^/]+)/page_(\d+)\.txt$", 2)
    return rows.where(found != "").select(F.regexp_extract("_f", r"([^/]+)/page_\d+\.txt$", 1).alias("paper"), found.cast("int").alias("page_num"), strip(F.col("value")).alias("truth"))


def read_engine_output(spark: SparkSession, path: str) -> DataFrame:
    """stem, text: of each document's Markdown the file <stem>/<stem>.md, else <stem>.md, else the first other one in its folder."""
    rows = _whole_files(spark, path, "*.md")
    name, folder = F.regexp_extract("f", r"([^/]+)\.md$", 1), F.regexp_extract("f", r"([^/]+)/[^/]+\.md$", 1)
    root = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
    stem = F.when(folder == root, name).otherwise(folder)
    rank = F.when((folder == name) & (folder != root), 0).when(folder == root, 1).otherwise(2)
    return rows.select(stem.alias("stem"), "value", rank.alias("r"), "f").groupBy("stem").agg(F.min_by("value", F.struct("r", "f")).alias("text"))


def read_json(spark: SparkSession, path: str, schema: str, corrupt_is_empty: bool = False) -> DataFrame:
    """A JSON file of one object or an array; corrupt_is_empty leaves out what can't be read (a ledger starts fresh)."""
    if not corrupt_is_empty:
        return spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(path)
    whole = spark.read.format("binaryFile").load(path).select(F.from_json(F.decode("content", "UTF-8"), f"array<struct<{', '.join(f'{n}: {t}' for n, t in _columns(schema))}>>").alias("rows"))
    return whole.selectExpr("inline(filter(rows, r -> r is not null))")


def _columns(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema).fields]


def require_files(papers: DataFrame, files: DataFrame, path: str = "pdf_path") -> DataFrame:
    """papers, or an error that lists those whose file is missing from files."""
    missing = papers.join(files.select(F.col("path").alias(path)), path, "left_anti").select(path).orderBy(path).limit(100).collect()
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(r[0] for r in missing))
    return papers


@dataclass(frozen=True)
class Settings:
    """Configuration of a run; files may set any of the fields."""

    primary_engine: str = "deepseek"
    fallback_chain: tuple[str, ...] = ("gemini",)
    native_first: bool = True
    timeout: int = 1800
    max_retries: int = 2
    truncation_retries: int = 1
    chunk_threshold: int = 30
    chunk_size: int = 20
    figures_max_total: int = 25
    figures_max_per_page: int = 3
    audit_min_words: int = 50
    multi_engine: tuple[str, ...] = field(default=())


def read_settings(path: str | None = None, folder: str | None = None, profile: str | None = None) -> Settings:
    """The settings in a YAML file: the path given, else the profile's or the default file in the folder, else the defaults."""
    if path is None and folder is not None:
        root = Path(folder).resolve()
        at = (root / f"{profile or 'default'}.yaml").resolve()
        if root not in at.parents:
            raise ValueError(f"profile outside its folder: {profile}")
        path = str(at) if at.exists() else None
        if profile and path is None:
            raise FileNotFoundError(profile)
    if path is None:
        return Settings()
    return settings_from(_yaml(Path(path).read_text(encoding="utf-8")))


def settings_from(values: dict) -> Settings:
    if "fallback_engine" in values:
        values = {**values, "fallback_chain": [values["fallback_engine"]]}
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known and v is not None})


def _yaml(text: str) -> dict:
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:  # flat files of scalars and one-line or dashed lists
        out: dict = {}
        key = None
        for line in text.splitlines():
            line = line.split(" #")[0].rstrip()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if line.lstrip().startswith("- ") and key:
                out[key] = [*(out[key] or []), _scalar(line.lstrip()[2:])]
            elif ":" in line:
                key, _, v = (x.strip() for x in line.partition(":"))
                out[key] = [_scalar(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else _scalar(v)
        return out


def _scalar(v: str):
    v = v.strip().strip("\"'")
    if v.lower() in ("", "null", "~"):
        return None
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v


def non_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(~is_blank(F.col(text)))
