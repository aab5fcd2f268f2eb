"""python -m leafwright: list the queries, run one, audit a folder of texts, rank engines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import audit
from .plans import incremental, reference
from .sources import readers

QUERIES = reference.QUERIES | incremental.QUERIES


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="leafwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query and show or write its rows")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("tables", help="folder of the Parquet tables")
    run.add_argument("--out", help="folder to write Parquet to")
    check = commands.add_parser("audit", help="audit the text files of a folder")
    check.add_argument("folder")
    check.add_argument("--min-words", type=int, default=50)
    options = parser.parse_args(args)
    if options.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("leafwright").getOrCreate()
    if options.command == "run":
        out = QUERIES[options.name](spark, options.tables)
    else:
        pages = readers.read_pages(spark, options.folder, "*.txt", recursive=True)
        out = audit.audited(pages, "text", min_words=options.min_words).select("path", "page_num", "n_words", "primary_failure", "passed", F.array_join("errors", ",").alias("errors"))
    if getattr(options, "out", None):
        out.write.mode("overwrite").parquet(options.out)
    else:
        out.show(50, False)


if __name__ == "__main__":
    main()
