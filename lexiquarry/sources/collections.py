"""Collections: Parquet tables of documents with vectors, and saved models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def collection_id(source: Column, chunk: Column) -> Column:
    """Id that is the same whenever the same chunk is written; 128 bits, as 64 collide among many billions."""
    return F.md5(F.concat_ws("#", source, chunk.cast("string")))


def _checked(df: DataFrame, dim: int, vec_col: str) -> DataFrame:
    """Fail a write that holds a vector of another width, without another pass over the data."""
    size = F.size(vec_col)
    message = F.concat(F.lit(f"vector width is not {dim}: "), size.cast("string"))
    return df.withColumn(
        vec_col, F.when(F.col(vec_col).isNull() | (size == dim), F.col(vec_col)).otherwise(F.raise_error(message))
    )


def write_collection(
    df: DataFrame, path: str, dim: int | None = None, mode: str = "append", partition_by: list[str] | None = None,
    vec_col: str = "embedding",
) -> None:
    """Append documents, vectors and metadata to the collection; ``id`` is added if missing."""
    if "id" not in df.columns:
        df = df.withColumn("id", collection_id(F.col("source"), F.col("chunk")))
    if dim is not None:
        df = _checked(df, dim, vec_col)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> str:
    """Save a fitted MLlib model, or a table that acts as one (vocabulary, centroids)."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_word2vec(path: str):
    """A table of word vectors, or an MLlib model, as ``word_table`` takes it."""
    from pyspark.errors import AnalysisException
    from pyspark.ml.feature import Word2VecModel

    try:
        found = SparkSession.active().read.parquet(path)
    except AnalysisException:
        return Word2VecModel.load(path)
    return found if {"word", "vec"} <= set(found.columns) else Word2VecModel.load(path)


def load_kmeans(path: str):
    from pyspark.ml.clustering import KMeansModel

    return KMeansModel.load(path)
