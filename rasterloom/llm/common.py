"""What the operators share: the shared folder, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, in folders by a column if given, and read it back: lineage ends there."""
    spark = df.sparkSession
    at = place(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at, compression=compression)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored = (at, None)
    return out


@contextmanager
def reading_in_order(spark: SparkSession):
    """Within it, Spark knows that the files of bucketed tables are sorted. The session's setting comes back after it."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The same in buckets by the keys, each sorted by them: tables of as many buckets are joined on the keys as they lie.

    df should be dealt by the keys into `buckets` partitions, as an aggregation with so
    many shuffle partitions or a join of such tables leaves it: a bucket is one file then.
    """
    spark = df.sparkSession
    at, table = place(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", at).saveAsTable(table)
    out = spark.table(table)
    out._stored = (at, table)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize and bucketed that nothing will read again."""
    for df in tables:
        at, table = df._stored
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        delete(df.sparkSession, at)


def join_hot_apart(rows: DataFrame, told: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined to told, which has one row for each key; column n tells how many of the `total` rows have the key.

    Keys of over a thousandth of all rows, at most 1,000 of them, are broadcast, so that
    their rows stay where they are; the others meet by sorting. n is dropped.
    """
    hot = F.col(n) * 1000 > total
    some = F.broadcast(told.where(hot).drop(n))
    rest = rows.join(F.broadcast(told.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(some, keys).unionByName(rest.join(told.where(~hot).drop(n).hint("merge"), keys))


def broadcast_if(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint if rows * row_bytes stays under limit; else Spark shuffles and sorts."""
    return F.broadcast(df) if rows * row_bytes <= limit else df.hint("merge")


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values in column hold about `most` bytes; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, the split that held-out rows are told by."""
    return F.crc32(F.col(column).cast("string"))
