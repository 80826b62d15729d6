"""Named queries over the test tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import once
from ..operators.common import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows on the same tables."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream. The table may be one file or a folder of files; a stream reads either if its path is a pattern."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}[.]parquet")


def documents(spark: SparkSession, folder: str, even: bool = False) -> DataFrame:
    """``even`` spreads a small table over the cores, for expressions that are heavy per row."""
    docs = table(spark, folder, "documents").withColumnRenamed("text", "content")
    return spread(docs) if even else docs


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


def as_long(df: DataFrame, keys: list[str], vec: str, digits: int = 6) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select(*keys, F.posexplode(once(F.col(vec))).alias("pos", "x")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), digits).alias("x")
    )
