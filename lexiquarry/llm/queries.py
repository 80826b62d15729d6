"""The queries of this folder, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_path
from . import ann, extract, jaccard, licenses, lines, mixing, packing, pii, quality, repair, sql, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows on the same tables."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_pii_surrogates")
def op1(spark, folder):
    return pii.replace_entities(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_ngram_jaccard", sql.SIMILAR)
def op2(spark, folder):
    return jaccard.similarity_classes(table(spark, folder, "documents").select("doc_id", "text")).drop("text_hash")


@query("op3_best_fit_packing")
def op3(spark, folder):
    pieces = packing.token_pieces(table(spark, folder, "documents"), tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op4_fuzzy_lines")
def op4(spark, folder):
    return lines.drop_near_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query("op5_warc_index", sql.ARCHIVES)
def op5(spark, folder):
    store = work_path(spark, "warc")
    index = warc.write_archives(warc.mark_revisits(table(spark, folder, "pages")), store)
    return warc.read_records(index, store, with_payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_license_scan", sql.LICENSES)
def op6(spark, folder):
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


@query("op7_quality_rules", sql.QUALITY)
def op7(spark, folder):
    return quality.judge(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).drop("lang", "source")


@query("op8_toxicity")
def op8(spark, folder):
    return toxicity.score(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic")
    ).drop("margin")


@query("op9_nearest_neighbours")
def op9(spark, folder):
    return ann.neighbours(table(spark, folder, "embeddings"))


@query("op10_mix_sources", sql.MIX)
def op10(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op11_prefix_trie", sql.TRIE)
def op11(spark, folder):
    return trie.prefix_trie(trie.with_openings(trie.number_turns(table(spark, folder, "conversations"))))


@query("op12_repair_conversations", sql.REPAIR)
def op12(spark, folder):
    return repair.report(repair.repair(repair.damage(table(spark, folder, "conversations"))))


@query("op13_main_text")
def op13(spark, folder):
    return extract.with_main_text(table(spark, folder, "pages").select("page_id", "url", "html")).drop("html")
