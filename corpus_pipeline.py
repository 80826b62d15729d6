"""From raw documents to packed sequences, stage by stage; every stage is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiquarry.llm import jaccard, lines, mixing, packing, quality
from lexiquarry.llm.queries import tokenizer_path
from lexiquarry.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the thresholds of their language and source keep."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; those of which nothing is left go."""
    left = lines.drop_near_lines(docs)
    return left.where((F.col("n_removed") == 0) | (F.col("text") != "")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    ).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    pieces = packing.token_pieces(docs, tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Tokenization has no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
