"""Queries of problem 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import new_folder, table
from ..operators.incremental import VersionedTable, checksum, diff_manifests, listing_manifest, process, take_due


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = VersionedTable(spark, new_folder(spark, "folder")), VersionedTable(spark, new_folder(spark, "taken"))
    return take_due(table(spark, sf_dir, "file_listing"), table(spark, sf_dir, "processed_files"), source, sink).select("name")


def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, name, change: what each scan found added, changed or removed against the one before."""
    listing = table(spark, sf_dir, "file_listing").withColumn("checksum", checksum(F.col("checksum")))
    held = listing.groupBy("scan_id", "name").agg(F.max_by("checksum", F.struct("listed_at", "checksum")).alias("checksum"))
    step = lambda df, by: df.select((F.col("scan_id") + by).alias("scan_id"), "name", "checksum").withColumn("entry", F.struct("scan_id", "name"))
    scans = listing.select("scan_id").distinct()
    changes = diff_manifests(step(held, 1), step(held, 0), "entry", "checksum").select("entry.scan_id", "entry.name", "change")
    return changes.join(scans, "scan_id", "left_semi")


def processed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n_added, n_removed: entries of the folder as an output table sees them that processes a versioned table after each scan."""
    listing = table(spark, sf_dir, "file_listing")
    source, sink = VersionedTable(spark, new_folder(spark, "listing")), VersionedTable(spark, new_folder(spark, "taken"))
    numbers = sorted(r.scan_id for r in listing.select("scan_id").distinct().collect())  # one for each run over the folder
    for n in numbers:
        now = listing_manifest(listing.where(F.col("scan_id") == n))
        source.merge(now, "name", "checksum")
        process(source, sink, lambda delta: delta.select("name", "checksum", "_change"))
    return sink.read().groupBy("name").agg(F.count_if(F.col("_change") == "added").alias("n_added"), F.count_if(F.col("_change") == "removed").alias("n_removed"))


QUERIES = {"p2_found": found, "p2_scan_changes": scan_changes, "p2_processed_records": processed_records}

_SPELT = "nullif(regexp_replace(lower(trim({})), '^sha-?256:', ''), '')"
_HELD = f"""held AS (SELECT scan_id, name, {_SPELT.format('checksum')} AS checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, name ORDER BY listed_at DESC, checksum DESC NULLS LAST) AS rn FROM file_listing) WHERE rn = 1)"""
_STEPS = f"""WITH {_HELD}, scans AS (SELECT DISTINCT scan_id FROM file_listing),
pairs AS (SELECT coalesce(b.scan_id, a.scan_id + 1) AS scan_id, coalesce(b.name, a.name) AS name,
  CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed'
       WHEN a.checksum IS NULL OR b.checksum IS NULL OR a.checksum <> b.checksum THEN 'changed' END AS change
  FROM held a FULL JOIN held b ON b.scan_id = a.scan_id + 1 AND b.name = a.name)
"""
SQL = {
    "p2_found": f"""WITH last AS (SELECT name, {_SPELT.format('checksum')} AS checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY listed_at DESC, checksum DESC NULLS LAST) AS rn
  FROM file_listing WHERE scan_id = (SELECT max(scan_id) FROM file_listing)) WHERE rn = 1 AND name IS NOT NULL),
done AS (SELECT name, {_SPELT.format('checksum')} AS checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC NULLS LAST, recorded_at DESC NULLS LAST, log_id DESC, checksum DESC NULLS LAST) AS rn
  FROM processed_files WHERE lower(trim(status)) = 'completed') WHERE rn = 1)
SELECT last.name FROM last LEFT JOIN done ON last.name = done.name
WHERE done.name IS NULL OR last.checksum IS NULL OR done.checksum IS NULL OR last.checksum <> done.checksum""",
    "p2_scan_changes": _STEPS + "SELECT scan_id, name, change FROM pairs WHERE change IS NOT NULL AND scan_id IN (SELECT scan_id FROM scans)",
    "p2_processed_records": _STEPS
    + """SELECT name, count(*) FILTER (WHERE change IN ('added', 'changed')) AS n_added, count(*) FILTER (WHERE change IN ('removed', 'changed')) AS n_removed
FROM pairs WHERE change IS NOT NULL AND scan_id IN (SELECT scan_id FROM scans) GROUP BY name""",
}
