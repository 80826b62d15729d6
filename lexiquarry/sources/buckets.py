"""Stored collections in hash buckets, so that changes rewrite only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.documents import upsert_collection
from ..session import materialize

#: Folder of a bucket, and how many there are unless said otherwise.
BUCKET, BUCKETS = "bucket", 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Store ``df`` with a folder per bucket of its key. A bucket is written by one task, or by as many as its size needs."""
    df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the buckets of ``rows``, which have been computed before: old files go only when all new ones are written."""
    done = materialize(rows, "buckets")
    done.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _touched(spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """The stored rows of the buckets that changes fall in. The numbers of buckets are few, at most ``buckets``."""
    numbers = sorted(r[0] for r in changes.where(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets)).distinct().collect())
    return spark.read.parquet(path).where(F.col(BUCKET).isin(numbers)), numbers


def upsert_stored(spark: SparkSession, path: str, changes: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> None:
    """Add rows or replace those of the same key and a version that is not newer; buckets without changes are not read.

    A run that failed can be started again: the result is the same. Changes with a null key are left out.
    """
    changes = materialize(changes.where(F.col(key).isNotNull()), "changes")
    stored, numbers = _touched(spark, path, changes, key, buckets)
    if numbers:
        merged = upsert_collection(stored.drop(BUCKET), changes.select(*[c for c in stored.columns if c != BUCKET]), key, version)
        _rewrite(merged.withColumn(BUCKET, bucket_of(F.col(key), buckets)), path)


def delete_stored(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Delete the rows of the given keys; buckets without one are left as they are, and those that get empty go."""
    ids = materialize(ids.where(F.col(key).isNotNull()).select(key).distinct(), "ids")
    stored, numbers = _touched(spark, path, ids, key, buckets)
    if not numbers:
        return
    hit = [r[0] for r in stored.join(ids, key, "left_semi").select(BUCKET).distinct().collect()]
    kept = stored.where(F.col(BUCKET).isin(hit)).join(ids, key, "left_anti")
    if hit:
        left = {r[0] for r in kept.select(BUCKET).distinct().collect()}
        _rewrite(kept, path)
        folders = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folders.getFileSystem(spark._jsc.hadoopConfiguration())
        for number in set(hit) - left:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folders, f"{BUCKET}={number}"), True)
