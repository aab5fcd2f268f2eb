"""Engines as table functions: registered by name, called batch by batch, failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What an engine does: the content or text of a page, or a list of those of several pages -> (text, confidence).
Engine = Callable[[object], tuple[str, float]]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, engine: Engine) -> None:
    _ENGINES[name.lower()] = engine


def engine(name: str) -> Engine:
    if name.lower() not in _ENGINES:
        raise ValueError(f"unknown engine: {name}")
    return _ENGINES[name.lower()]


def run_engine(pages: DataFrame, name: str, content: str = "content") -> DataFrame:
    """doc_id, page_num, engine, text, status, failure_mode, confidence, processing_time, error, audit_passed of each page.

    A timeout, another exception (of the mode in its attribute failure, else cli_error) and an empty result are rows with their failure mode, never a failure of the task; they
    don't pass the audit.  Filter the pages before: what is below a Python function isn't pushed down further.
    """
    call = engine(name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page_num", "engine", "text", "status", "failure_mode", "confidence", "processing_time", "error", "audit_passed"]
        for part in parts:
            rows = []
            for d, p, c in zip(part["doc_id"], part["page_num"], part[content]):
                began = time.monotonic()
                text, confidence, failure, error = "", 0.0, "none", None
                try:
                    text, confidence = call(list(c) if isinstance(c, np.ndarray) else c)
                    failure = "none" if text and text.strip() else "empty_output"
                except TimeoutError as e:
                    failure, error = "timeout", str(e)[:500]
                except Exception as e:
                    failure, error = getattr(e, "failure", "cli_error"), str(e)[:500]
                ok = failure == "none"
                rows.append((d, p, name.lower(), text, "success" if ok else "error", failure, confidence if ok else 0.0, time.monotonic() - began, error, ok))
            yield pd.DataFrame(rows, columns=names)

    schema = f"doc_id {dict(pages.dtypes)['doc_id']}, page_num int, engine string, text string, status string, failure_mode string, confidence double, processing_time double, error string, audit_passed boolean"
    return pages.selectExpr("doc_id", "cast(page_num as int) as page_num", content).mapInPandas(run, schema)
