"""Writing documents as Markdown, ground truth as text, results as JSON, figures as images."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..operators.assembly import joined


def front_matter(source: Column, engine: Column, version: Column, processed: Column) -> Column:
    """YAML front matter; fields that are null are left out."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    lines = F.concat_ws("\n", line("source", source), line("engine", engine), line("model_version", version), line("processed", F.date_format(processed, "yyyy-MM-dd'T'HH:mm:ss")))
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"))


def _files(df: DataFrame, root: str) -> None:
    """Writes the column data to the file named by the column file under a folder all executors share (a path, or a URI of a
    file system that Arrow knows: file, hdfs, s3, gs); each appears whole or not at all."""

    def write(rows: Iterable) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for r in rows:
            path = posixpath.normpath(f"{base}/{r.file}")
            if not path.startswith(base.rstrip("/") + "/"):
                raise ValueError(f"outside {root}: {r.file}")
            system.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(bytes(r.data))
            system.move(part, path)

    df.select("file", "data").foreachPartition(write)


def write_markdown(documents: DataFrame, root: str, stem: str = "stem", text: str = "text", header: Column | None = None) -> None:
    """<root>/<stem>/<stem>.md of each document."""
    s = file_stem(F.col(stem))
    body = F.coalesce(F.col(text), F.lit(""))
    _files(documents.select(F.concat(s, F.lit("/"), s, F.lit(".md")).alias("file"), F.encode(body if header is None else F.concat(header, body), "UTF-8").alias("data")), root)


def write_ground_truth(pages: DataFrame, root: str) -> None:
    """<root>/<paper>/page_<n>.txt of each page (paper, page_num, truth), and full.txt of those that aren't empty."""
    p = file_stem(F.col("paper"))
    _files(pages.select(F.concat(p, F.lit("/page_"), "page_num", F.lit(".txt")).alias("file"), F.encode(F.coalesce("truth", F.lit("")), "UTF-8").alias("data")), root)
    full = joined(pages, ["paper"], "page_num", "truth", "\n\n")
    _files(full.select(F.concat(p, F.lit("/full.txt")).alias("file"), F.encode("text", "UTF-8").alias("data")), root)


def write_figures(figures: DataFrame, root: str) -> None:
    """<root>/<stem>/figure_<n>_page<p>.png (stem, figure_num, page_num, image)."""
    _files(figures.select(F.concat(file_stem(F.col("stem")), F.lit("/figure_"), "figure_num", F.lit("_page"), "page_num", F.lit(".png")).alias("file"), F.col("image").alias("data")), root)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def settings_yaml(settings) -> str:
    """The engines of the settings as YAML, the form that ``readers.read_settings`` reads."""
    lines = [f"primary_engine: {settings.primary_engine}", "fallback_chain:" + ("" if settings.fallback_chain else " []"), *(f"- {e}" for e in settings.fallback_chain)]
    return "\n".join(lines) + "\n"


def write_settings(spark, settings, path: str) -> None:
    """settings_yaml in one file."""
    folder, _, name = path.rpartition("/")
    _files(spark.createDataFrame([(name, settings_yaml(settings).encode())], "file string, data binary"), folder)
