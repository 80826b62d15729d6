"""New documents and new questions as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.search import knn, with_score
from ..operators.vectorize import Encoder, embed
from ..params import EMBEDDING_DIM, TOP_K
from ..plans.flows import prepare_documents
from ..sources.files import clean_utf8


def text_file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive: (source, content, arrived)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        F.col("path").alias("source"), clean_utf8(F.col("content")).alias("content"),
        F.col("modificationTime").alias("arrived"),
    )


def drop_copies(docs: DataFrame, ts: str | None = None, delay: str | None = None, text_col: str = "content") -> DataFrame:
    """Drop contents already seen; state holds hashes, not texts.

    With ``ts`` and ``delay``, hashes are forgotten after the delay, and rows
    later than that are dropped whatever their content. Without them nothing is
    forgotten or late: one hash per content stays, for streams whose rows may
    come in any order of time.
    """
    if (ts is None) != (delay is None):
        raise ValueError("need both ts and delay, or neither")
    hashed = docs.withColumn("content_md5", F.md5(text_col))
    if ts is None:
        return hashed.dropDuplicates(["content_md5"])
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_md5"])


def _batch_path(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def ingest(
    docs: DataFrame, path: str, checkpoint: str, make_encoder: Callable[[], Encoder], dim: int = EMBEDDING_DIM,
    preset="auto", partitions: int | None = None, **chunking,
) -> DataFrame:
    """Chunk, embed and store a stream of documents; failed chunks go to ``<path>_rejects``.

    Files differ in size and encoding is the heavy part, so the texts of a
    batch are first dealt out to ``partitions`` tasks (default: one per core).

    Each batch has its own folder and overwrites it, so a batch that is run
    again after a failure leaves no doubles. Returns the stored collection.
    """
    spark = docs.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        dealt = batch.repartition(partitions or spark.sparkContext.defaultParallelism)
        done = prepare_documents(dealt, make_encoder, preset, dim, **chunking)
        staged = _batch_path(path + "_staged", number)
        done.write.mode("overwrite").parquet(staged)
        again = batch.sparkSession.read.schema(done.schema).parquet(staged)
        again.where(F.col("embed_error").isNull()).drop("embed_error").write.mode("overwrite").parquet(
            _batch_path(path, number)
        )
        again.where(F.col("embed_error").isNotNull()).write.mode("overwrite").parquet(
            _batch_path(path + "_rejects", number)
        )

    query = (
        docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")


def answer_questions(
    questions: DataFrame, collection: DataFrame, path: str, checkpoint: str,
    make_encoder: Callable[[], Encoder] | None = None, k: int = TOP_K, dim: int = EMBEDDING_DIM, doc_id: str = "doc_id",
) -> DataFrame:
    """Search a stored collection for a stream of questions, batch by batch.

    Questions bring ``query_vec`` or, with ``make_encoder``, a ``query`` text.
    """
    spark = questions.sparkSession

    def answer(batch: DataFrame, number: int) -> None:
        vectors = embed(batch, make_encoder, "query", "query_vec", dim=dim) if make_encoder else batch
        with_score(knn(vectors, collection, k, doc_id=doc_id)).write.mode("overwrite").parquet(_batch_path(path, number))

    query = (
        questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")
