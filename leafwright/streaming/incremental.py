"""The incremental run as a stream: new files audited as they arrive, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import VersionedTable


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder with the schema of those already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_into(stream: DataFrame, table: VersionedTable, function: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Applies the function to each batch and commits it with the batch's number: a batch run again after a failure is known and left out."""

    def batch(rows: DataFrame, number: int) -> None:
        if table.manifest()["processed"].get(name, -1) < number:
            table.commit(added=function(rows), processed={name: number})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, kind, n in tumbling windows, for rows at most ``late`` behind; works on streams and on tables."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late)
    return rows.groupBy(F.window("_t", window).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key's first row within the watermark; on a table simply the distinct keys' rows."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    return (rows.withWatermark("_t", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)).drop("_t")


def collected(rows: DataFrame, folder: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives until its source is exhausted, as a table under folder; mode: append or update.

    Each batch is written under its number, so one that is run again replaces itself.  With update, the last row of each of
    ``keys`` holds.
    """
    spark, schema = rows.sparkSession, rows.schema

    def batch(part: DataFrame, number: int) -> None:
        part.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/{number:012d}")

    rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    names = [c for c in held.columns if c != "_batch"]
    if keys is None:
        return held.select(*names)
    rest = [c for c in names if c not in keys]
    return held.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*[c if c in keys else F.col(f"r.{c}") for c in names])
