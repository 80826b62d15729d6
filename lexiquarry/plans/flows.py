"""Whole jobs: adding documents, answering a table of questions, enhanced retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.answers import build_prompt, classify_nearest_centroid
from ..operators.chunking import split_documents
from ..operators.documents import empty_result_message, normalize_input, route_by_type, route_question
from ..operators.hits import documents_of, hits_by_route, list_answers, list_of_hits
from ..operators.retrieval import multi_query_retrieve, parse_rewrites
from ..operators.search import knn, threshold_filter, with_score
from ..operators.tables import delimited_blocks, delimited_records, markdown_blocks, markdown_rows
from ..operators.vectorize import Encoder, embed
from ..params import EMBEDDING_DIM, MIN_SIMILARITY, ROWS_PER_CHUNK, SEARCH_MULTIPLIER, TOP_K
from ..session import materialize
from ..sources.collections import collection_id, write_collection


def process_files(files: DataFrame, preset="auto", rows_per_chunk: int = ROWS_PER_CHUNK, **chunking) -> tuple[DataFrame, DataFrame]:
    """Files (source, path, mime, content) to chunks (source, kind, chunk, total_chunks, content), and the refused ones.

    Every file comes out once: pipe tables and delimited texts with a row below
    their header as blocks of rows, other texts cut by the preset, and files
    that have no text or need a decoder as refused, with the reason. Kinds,
    reasons and numbers of rows are found once and written, as every kind of
    chunk and the refusals read them.
    """
    routed = route_by_type(files)
    blank = F.col("content").isNull() | (F.col("content") == "")
    routed = routed.withColumn("error", F.coalesce(
        "error", F.when(F.col("kind") == "excel", "a workbook needs a decoder"), F.when(blank, "no content")
    ))
    rows = F.when(F.col("kind") == "csv", F.size(delimited_records(F.col("content"))) - 1).when(
        F.col("kind").isin("markdown", "table_text"), markdown_rows(F.col("content"))
    ).otherwise(0)
    kept = ["source", "kind", "content"]
    routed = materialize(routed.withColumn("_rows", F.when(F.col("error").isNull(), rows)).select("source", "path", "kind", "content", "error", "_rows"), "routed")
    sound = routed.where(F.col("error").isNull())
    parts = [
        markdown_blocks(sound.where("_rows > 0 AND kind <> 'csv'").select(*kept), rows_per_chunk),
        delimited_blocks(sound.where("_rows > 0 AND kind = 'csv'").select(*kept), rows_per_chunk),
    ]
    chunks = split_documents(sound.where("_rows <= 0").select(*kept), preset, **chunking).select(
        "source", "kind", "chunk", "total_chunks", "content"
    )
    for part in parts:
        chunks = chunks.unionByName(part.select("source", "kind", F.col("chunk_index").alias("chunk"), "total_chunks", "content"))
    return chunks, routed.where(F.col("error").isNotNull()).select("source", "path", "error")


def prepare_documents(
    docs: DataFrame, make_encoder: Callable[[], Encoder], preset="auto", dim: int = EMBEDDING_DIM,
    source_col: str = "source", **chunking,
) -> DataFrame:
    """Documents to embedded chunks with ids. No stage shuffles."""
    chunks = split_documents(normalize_input(docs), preset, **chunking)
    chunks = chunks.withColumn("id", collection_id(F.col(source_col).cast("string"), F.col("chunk")))
    return embed(chunks, make_encoder, dim=dim)


def add_documents(docs: DataFrame, path: str, make_encoder: Callable[[], Encoder], dim: int = EMBEDDING_DIM, **options) -> None:
    """Chunk, embed and append; chunks whose encoding failed go to ``<path>_rejects``.

    The encoder runs once: its results are written before they are split, so
    every chunk lands in one of the two tables.
    """
    done = materialize(prepare_documents(docs, make_encoder, dim=dim, **options), "encoded")
    write_collection(done.where(F.col("embed_error").isNull()).drop("embed_error"), path, dim)
    done.where(F.col("embed_error").isNotNull()).select("id", "content", "embed_error").write.mode("append").parquet(
        path + "_rejects"
    )


def ask(
    questions: DataFrame,
    collection: DataFrame,
    make_encoder: Callable[[], Encoder],
    k: int = TOP_K,
    threshold: float = MIN_SIMILARITY,
    centers: DataFrame | None = None,
    dim: int = EMBEDDING_DIM,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Answer inputs for a whole table of questions: (query_id, route, n_hits, prompt, sources, answer).

    ``answer`` is filled only where nothing was found; elsewhere ``prompt`` is
    what a language model would receive.
    """
    vectors = embed(questions, make_encoder, "query", "query_vec", dim=dim).select("query_id", "query", "query_vec")
    hits = materialize(threshold_filter(
        with_score(knn(vectors, collection, k, doc_id=doc_id)), threshold, keep_best=True, k=k, doc_id=doc_id
    ), "hits")
    intents = None
    if centers is not None:
        intents = classify_nearest_centroid(vectors, centers)
    prompts = build_prompt(questions, hits, collection, intents, doc_id=doc_id)
    routed = questions.withColumn("route", route_question(F.col("query")))
    return empty_result_message(routed, hits).join(prompts, "query_id", "left")


def ask_by_route(
    questions: DataFrame, collection: DataFrame, categories: DataFrame, k: int = TOP_K, multiplier: int = SEARCH_MULTIPLIER, doc_id: str = "doc_id", **fields
) -> DataFrame:
    """(query_id, route, n_hits, prompt, sources, answer): every question answered the way its route asks for.

    ``questions`` (query_id, query, query_vec), ``collection`` (doc, content, metadata, category, embedding),
    ``categories`` (category, category_vec). ``k * multiplier`` hits are found once; comparisons then use the extremes
    of a field among them, recommendations the fitting category, other routes the best k. ``answer`` is the list of a
    list question or the message of a question without hits; otherwise ``prompt`` is what a language model would get.
    """
    routed = questions.withColumn("route", route_question(F.col("query")))
    hits = materialize(knn(routed.select("query_id", "query_vec"), collection, k * multiplier, doc_id=doc_id), "hits")
    found = materialize(documents_of(hits, collection.select(doc_id, "content", "metadata", "category"), doc_id=doc_id), "found")
    words = routed.select("query_id", F.col("query_vec").alias("word_vec"))
    chosen = materialize(hits_by_route(routed, found, words, categories, k, doc_id=doc_id, **fields), "chosen")
    prompts = build_prompt(routed, chosen, collection, doc_id=doc_id)
    listed = routed.where("route = 'list'")
    lists = list_answers(listed, list_of_hits(found.join(listed.select("query_id"), "query_id", "left_semi"), doc_id=doc_id))
    out = empty_result_message(routed.drop("query_vec"), chosen).join(prompts, "query_id", "left")
    return out.join(lists.withColumnRenamed("answer", "_list"), "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.when(F.col("n_hits") > 0, F.col("_list")))
    ).drop("_list")


def enhanced_retrieval(
    replies: DataFrame, collection: DataFrame, make_encoder: Callable[[], Encoder], k: int = TOP_K,
    dim: int = EMBEDDING_DIM, doc_id: str = "doc_id",
) -> DataFrame:
    """Rewrites of each question (from model replies), retrieved and merged: (query_id, doc, score, rank)."""
    variants = embed(parse_rewrites(replies), make_encoder, "variant", "query_vec", dim=dim)
    return multi_query_retrieve(variants.select("query_id", "variant_no", "query_vec"), collection, k, k, doc_id=doc_id)
