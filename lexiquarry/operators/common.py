"""Size checks shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import BROADCAST_BYTES, BROADCAST_ROWS
from ..session import materialize


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows of ``size`` bytes; otherwise Spark joins by shuffle.

    For sides that are cheap to compute: the check runs a job that stops after
    ``rows`` rows. Rows count with the length of their JSON form.
    """
    found = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")
    ).head()
    return F.broadcast(df) if found.rows <= rows and found.size <= size else df


def settled(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written to the shared folder and read back, marked for broadcast if small.

    For the result of an expensive step that is joined to a huge table: with
    its size unknown, Spark would start to shuffle the huge side as well.
    """
    return broadcast_if_small(materialize(df, label), rows)


def _bytes(size: str) -> int:
    """A size setting such as 128MB, 64m or 134217728b as a number."""
    digits = "".join(c for c in size if c.isdigit())
    unit = size[len(digits):].strip().lower()[:1]
    return int(digits) * 1024 ** "bkmgt".index(unit or "b")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small input before work that is heavy per row.

    A file smaller than one split per core, or with a single row group, is
    read by too few tasks. Only such inputs are redistributed, so the shuffle
    is at most one split per core; larger ones pass unchanged.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if df.isStreaming or cores <= 1 or size >= cores * split:
        return df
    return df.repartition(cores, *keys)


#: Bytes of files behind one partition of a shuffle, and most partitions.
PARTITION_BYTES, PARTITIONS = 8 << 20, 20_000


def filled(df: DataFrame) -> int:
    """How many partitions the files behind ``df`` fill, one per core at least; the session's number if their size is not known."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    return parts if parts <= PARTITIONS else int(spark.conf.get("spark.sql.shuffle.partitions"))
