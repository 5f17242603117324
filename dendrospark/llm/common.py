"""Helpers shared by the corpus operators: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where a local master names none (tests) is one made in the temporary folder; on a cluster
    that is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, by: str, kind: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, in as many buckets of ``by`` as a shuffle has partitions.

    Joins on ``by`` then leave its rows where they are.  Rows of each value of ``kind`` are in files of
    their own.  The table's name is gone after the block, its files stay.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").partitionBy(kind).bucketBy(n, by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


MOST_BROADCAST = 1 << 20  #: rows of two numbers, 16 MB, that a join may send to all executors


def checked(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A materialised table for a join: broadcast if it has at most ``most`` rows, else left to Spark."""
    return F.broadcast(keys) if keys.count() <= most else keys


def row_keys(df: DataFrame) -> DataFrame:
    """``df`` with ``_file`` and ``_at``, which tell its rows apart and are the same at every reading.

    They are a row's file (hashed) and place in it; what is not read from Parquet files is written first.
    """
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return row_keys(materialise(df, "rows"))


def own_names(keep: Iterable[str], *names: str) -> None:
    """Raises where a kept column has a name that an operator gives to a column of its own."""
    taken = sorted(k for k in keep if k.startswith("_") or k in names)
    if taken:
        raise ValueError(f"rename these columns to keep them: {', '.join(taken)}")


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8 << 20, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``size`` bytes of texts and blobs, from tuples in column order."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if weight >= size or len(held) >= most:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python values of the named columns, in slices so that a batch is never held twice."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)
