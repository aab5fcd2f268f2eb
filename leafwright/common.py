"""What every module needs: tables by name, the shared folder, cut lineage, batch-wise Python over rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files make fewer partitions than there are; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset a new local one, if the master is local too; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="leafwright-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: they survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def per_row(df: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Callable], fields: list[tuple[str, str]]) -> DataFrame:
    """``keys`` and what a Python function returns for ``inputs``, batch by batch over Arrow.

    make() is called once in each task and gives the function: it takes the inputs of a row and returns a tuple of
    ``fields``, or None for no row.  Only the columns named are read; others, whatever their names, are left behind.
    """
    out = [*keys, *(n for n, _ in fields)]
    if len(set(out)) < len(out):
        raise ValueError(f"an output column has the name of a key: {out}")
    types = dict(df.dtypes)
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    arrow = [_ARROW[t] for _, t in fields]
    picked = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)])
    n_keys, n_in = len(keys), len(inputs)
    assert all(c in types for c in inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            columns = [b.column(n_keys + i).to_pylist() for i in range(n_in)]
            kept, rows = [], []
            for i, row in enumerate(zip(*columns)):
                r = f(*row)
                if r is not None:
                    kept.append(i)
                    rows.append(r)
            at = pa.array(kept, pa.int64())
            left = [b.column(i).take(at) for i in range(n_keys)]
            right = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(left + right, names=out)

    return picked.mapInArrow(run, schema)


def hash_sample(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """About n rows (2 n at most) with different values of ``by``, chosen by a hash: the same for the same rows, however they are partitioned.

    All different rows of a table that has no more.  Copies count once, so a value that fills a third of the table is no
    likelier than another; only what is chosen moves.
    """
    h = F.xxhash64(*by)
    total = df.agg(F.approx_count_distinct(h).alias("n")).first().n
    some = df if total <= n else df.where(h <= int((n / total - 0.5) * 2**64))
    return some.dropDuplicates(by).orderBy(h).limit(2 * n)
