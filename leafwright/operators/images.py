"""Image references held against the files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_references(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, target of each image reference; a target that a text names twice comes out once."""
    targets = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"!\[[^\]]*\]\(\s*([^)]+?)\s*\)"), F.lit(1)))
    return texts.where(F.contains(F.col(text), F.lit("!["))).select(*keys, F.explode(targets).alias("target"))


def without_missing_images(texts: DataFrame, keys: list[str], text: str, files: DataFrame) -> DataFrame:
    """texts, less the references to local files that aren't in files (target), and the blank lines these leave.

    References to the web and to inline data stay.  Only the targets and the keys of texts with references are shuffled
    before the texts meet what they miss.  keys must name a row; null texts stay null.
    """
    local = image_references(texts, keys, text).where(~F.col("target").rlike(r"^(?:https?://|data:)"))
    missing = local.join(files.select("target").distinct(), "target", "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_set("target")).alias("_missing"))
    less = F.aggregate("_missing", F.col(text), lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"!\[[^\]]*\]\(\s*\Q"), m, F.lit(r"\E\s*\)")), F.lit("")))
    joined = texts.join(missing, keys, "left")
    return joined.withColumn(text, F.when(F.col("_missing").isNull(), F.col(text)).otherwise(F.regexp_replace(less, r"\n{3,}", "\n\n"))).drop("_missing")
