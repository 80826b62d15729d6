"""Keyword ranking, merging of hit lists, rewritten queries, identity and copies."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import document_identity, strip, tokens
from ..params import BM25_B, BM25_K1, BROADCAST_ROWS, RRF_K, TOP_K
from ..session import materialize
from .common import filled, settled, spread
from .search import knn, with_score


def keywords(df: DataFrame, text_col: str = "query", out_col: str = "keywords") -> DataFrame:
    """Tokens longer than one character."""
    return df.withColumn(out_col, F.filter(tokens(F.col(text_col)), lambda t: F.length(t) > 1))


def bm25(
    queries: DataFrame,
    docs: DataFrame,
    k: int = TOP_K,
    k1: float = BM25_K1,
    b: float = BM25_B,
    query_id: str = "query_id",
    query_text: str = "query",
    doc_id: str = "doc_id",
    doc_text: str = "content",
    stop_words=(),
) -> DataFrame:
    """Top k documents per query by BM25: (query, doc, score, rank); ties by doc id.

    Tokens of the corpus meet the distinct query terms before the only large
    shuffle, by document, into as many partitions as the texts fill, so what a
    task counts and sorts does not grow with the corpus. Counting and scoring use that partitioning, and only
    the k best documents per query and task leave it: pairs of a query and a
    document are never rows. With more than BROADCAST_ROWS terms of questions, the
    questions are taken in blocks of about that many. Every document also sends one empty token, so the number
    of documents and their mean length come from the same pass.
    """
    def usable(ts: Column) -> Column:
        return F.filter(ts, lambda t: ~t.isin(list(stop_words))) if stop_words else ts

    terms = queries.select(
        query_id, F.explode(F.array_distinct(usable(tokens(F.col(query_text))))).alias("term")
    )
    few_terms = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mark = F.broadcast if few_terms else (lambda side: side)

    vocabulary = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    texts = spread(docs.select(doc_id, doc_text)).select(doc_id, tokens(F.col(doc_text)).alias("_tokens"))
    postings = (
        texts.select(
            doc_id, F.size("_tokens").alias("len"), F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("term")
        )
        .join(mark(vocabulary), "term")
        .repartition(filled(docs), doc_id)
        .groupBy(doc_id, "len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.avg("len").alias("mean"))
    # Picked by an aggregate, not a filter: pushed down, a filter would keep the shuffles from being reused.
    whole = frequency.agg(F.max(F.when(F.col("term") == "", F.struct("df", "mean")))).scalar()
    n_docs, mean_len = whole["df"], whole["mean"]
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # The empty term carries the mean length. No question has that term; it is here so that
    # both uses of ``frequency`` need the same columns, and its shuffle is run once.
    weights = frequency.select("term", F.when(F.col("term") == "", F.col("mean")).otherwise(idf).alias("idf"))
    weighted = terms.join(mark(weights), "term")
    # The part of the gain that depends on the document is computed once, before queries multiply it.
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (1 - b + b * F.col("len") / mean_len))
    parts = postings.select(doc_id, "term", part.alias("part"))
    if few_terms:
        scores = _best_in_task(parts, weighted, k, query_id, doc_id)
    else:
        # More questions than one task can hold: the documents pass once per block of them, and pairs still are no rows.
        weighted = materialize(weighted.select(query_id, "term", "idf"), "weights")
        parts, blocks = materialize(parts, "parts"), -(-weighted.count() // BROADCAST_ROWS)
        block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
        passes = [_best_in_task(parts.repartition(filled(docs), doc_id), weighted.where(block == i), k, query_id, doc_id) for i in range(blocks)]
        scores = functools.reduce(DataFrame.unionAll, passes)
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), doc_id)
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(query_id, doc_id, "score", "rank")
    )


#: Pairs of a question and a document that are summed at a time in a task.
PAIRS_AT_ONCE = 2_000_000


def _best_in_task(parts: DataFrame, weighted: DataFrame, k: int, query_id: str, doc_id: str) -> DataFrame:
    """The ``k`` best documents per question of every task: (query, doc, score).

    parts: (doc, term, part), all rows of a document in one partition;
    weighted: (query, term, idf) of a number of terms that has been checked.
    Sums of a question and a document exist only as arrays of one block of
    documents, so no row per pair leaves the task or is shuffled.
    """
    rows = weighted.select(query_id, "term", "idf").toPandas()
    query_kind, doc_kind = (d.schema[c].dataType.simpleString() for d, c in ((weighted, query_id), (parts, doc_id)))
    order = np.argsort(rows["term"].to_numpy(object), kind="stable")
    rows = rows.iloc[order]
    queries, who = np.unique(rows[query_id].to_numpy(), return_inverse=True)
    names, first = np.unique(rows["term"].to_numpy(object), return_index=True)
    model = parts.sparkSession.sparkContext.broadcast(
        ({t: i for i, t in enumerate(names)}, np.append(first, len(rows)), who, rows["idf"].to_numpy(float), queries)
    )

    def best(who: np.ndarray, score: np.ndarray, at: np.ndarray):
        """Of rows in document order, the k best of each question."""
        order = np.lexsort((at, -score, who))
        who, score, at = who[order], score[order], at[order]
        start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
        return who[rank < k], score[rank < k], at[rank < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, first, who, idf, queries = model.value
        ids, kept = None, (np.zeros(0, int), np.zeros(0), np.zeros(0, int))

        def add(docs: pa.Array, term: np.ndarray, part: np.ndarray) -> None:
            """Score whole documents; rows of one stand together."""
            nonlocal ids, kept
            codes = docs.dictionary_encode()
            place = codes.indices.to_numpy()
            base = len(ids) if ids is not None else 0
            width = first[term + 1] - first[term]
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[term], width)
            key, of = np.unique(np.repeat(place, width) * np.int64(len(queries)) + who[at], return_inverse=True)
            score = np.round(np.bincount(of, idf[at] * np.repeat(part, width), minlength=len(key)), 9)
            found = best(key % len(queries), score, key // len(queries) + base)
            ids = codes.dictionary if ids is None else pa.concat_arrays([ids, codes.dictionary])
            kept = best(*[np.concatenate(x) for x in zip(kept, found)])
            used, place = np.unique(kept[2], return_inverse=True)
            ids, kept = ids.take(pa.array(used)), (kept[0], kept[1], place)

        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if batch is not None or rest is not None else None
            if table is None or not len(table):
                continue
            docs = table[doc_id].combine_chunks() if len(table) else None
            docs = docs if isinstance(docs, pa.Array) else docs.chunk(0)
            codes = docs.dictionary_encode().indices.to_numpy()
            term = np.array([terms.get(t, -1) for t in table["term"].to_pylist()])
            part = table["part"].to_numpy()
            # The last document may go on in the next batch.
            stop = len(docs) if batch is None else int(np.searchsorted(codes, codes[-1]))
            rest = table.slice(stop).combine_chunks().to_batches()[0] if stop < len(docs) else None
            width = np.where(term >= 0, first[term + 1] - first[term], 0)[:stop]
            piece = np.cumsum(width) // PAIRS_AT_ONCE
            edges = np.flatnonzero(np.r_[True, codes[1:stop] != codes[: stop - 1]]) if stop else np.zeros(0, int)
            cuts = [0, *[int(e) for e, new in zip(edges[1:], np.diff(piece[edges])) if new], stop]
            for low, high in zip(cuts, cuts[1:]):
                use = np.flatnonzero(term[low:high] >= 0) + low
                if len(use):
                    add(docs.take(pa.array(use)), term[use], part[use])
        if ids is not None and len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(queries[kept[0]]), ids.take(pa.array(kept[2])), pa.array(kept[1])], [query_id, doc_id, "score"])

    return parts.sortWithinPartitions(doc_id).mapInArrow(run, f"`{query_id}` {query_kind}, `{doc_id}` {doc_kind}, score DOUBLE")


def hybrid_fuse(
    left: DataFrame,
    right: DataFrame,
    k: int | None = TOP_K,
    constant: int = RRF_K,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Merge two ranked hit tables by reciprocal ranks: (query, doc, score, rank)."""
    key = [query_id, doc_id]
    merged = left.select(*key, F.col("rank").alias("_l")).join(
        right.select(*key, F.col("rank").alias("_r")), key, "full_outer"
    )

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(constant) + F.col(rank)), F.lit(0.0))

    scored = merged.withColumn("score", part("_l") + part("_r"))
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), doc_id)
    ranked = scored.withColumn("rank", F.row_number().over(order)).select(*key, "score", "rank")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def multi_query_retrieve(
    variants: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    per_variant: int = TOP_K,
    query_id: str = "query_id",
    variant: str = "variant_no",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
) -> DataFrame:
    """Hits of all variants of a query, taken in order until k documents are known, best k by score.

    A document counts with the score of the first variant that finds it.
    """
    keyed = variants.select(F.struct(query_id, variant).alias("_key"), query_vec)
    flat = keyed.select(F.to_json("_key").alias("_qk"), "_key", query_vec)
    hits = with_score(knn(flat, corpus, per_variant, "l2sq", "_qk", doc_id, query_vec, doc_vec))
    key_type = variants.select(query_id, variant).schema.simpleString()
    hits = hits.select(F.from_json("_qk", key_type).alias("_key"), doc_id, "score").select("_key.*", doc_id, "score")
    return merge_variant_hits(hits, k, query_id, variant, doc_id)


def merge_variant_hits(
    hits: DataFrame, k: int, query_id: str = "query_id", variant: str = "variant_no", doc_id: str = "doc_id"
) -> DataFrame:
    """The merge step alone: hits (query, variant, doc, score) to the final (query, doc, score, rank)."""
    first = hits.groupBy(query_id, doc_id).agg(F.min(F.struct(variant, (-F.col("score")).alias("_neg"))).alias("_f"))
    found = first.select(query_id, doc_id, F.col(f"_f.{variant}").alias("_at"), (-F.col("_f._neg")).alias("score"))
    # Rows per query: variants x hits per variant.
    earlier = Window.partitionBy(query_id).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    used = found.withColumn("_before", F.count(F.lit(1)).over(earlier)).where(F.col("_before") < k)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), doc_id)
    return (
        used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(query_id, doc_id, "score", "rank")
    )


def without_thoughts(reply: Column) -> Column:
    """The reply without its first <think>...</think> passage."""
    start, end = F.instr(reply, "<think>"), F.instr(reply, "</think>")
    return F.when(
        (start > 0) & (end > 0),
        F.concat(F.substring(reply, F.lit(1), start - 1), F.substring(reply, end + 8, F.length(reply))),
    ).otherwise(reply)


def parse_rewrites(
    replies: DataFrame, query_id: str = "query_id", query: str = "query", reply: str = "reply"
) -> DataFrame:
    """Rewritten queries in a model's reply, one row per line: (query_id, variant_no, variant).

    Numbering is cut off; a reply without usable lines gives the original query.
    """
    lines = F.transform(F.split(without_thoughts(F.col(reply)), "\n", -1), strip)
    lines = F.filter(lines, lambda l: (l != "") & ~l.contains("<think>") & ~l.contains("</think>"))
    lines = F.transform(lines, lambda l: F.regexp_replace(l, r"^[0-9]+[.)]\s+", ""))
    lines = F.filter(lines, lambda l: l != "")
    cut = replies.select(query_id, query, lines.alias("_lines"))
    usable = F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(F.array(query))
    return cut.select(query_id, F.posexplode(usable).alias("variant_no", "variant"))


def with_identity(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", chunk: str = "chunk", content: str = "content"
) -> DataFrame:
    return df.withColumn(
        "identity", document_identity(F.col(doc_id), F.col(source), F.col(chunk), F.col(content))
    )


def dedup_content(df: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """One row per distinct content, the one with the lowest id.

    Hashes and ids are written once, narrow, and reduced before the shuffle, so
    a content with very many copies costs one row per task. Only the copies that go are looked up again;
    texts are not shuffled unless those are too many to broadcast.
    """
    hashed = materialize(df.select(id_col, F.md5(text_col).alias("content_md5")), "hashes")
    keepers = hashed.groupBy("content_md5").agg(F.min(id_col).alias("_kept"), F.count(F.lit(1)).alias("_copies"))
    losers = hashed.join(keepers.where("_copies > 1"), "content_md5").where(F.col(id_col) != F.col("_kept"))
    losers = settled(losers.select(F.col(id_col).alias("_lost"), F.col("content_md5").alias("_md5")), "copies")
    # Another generator than an expression: the hash is computed once for the join and for the result.
    rows = df.select("*", F.explode(F.array(F.md5(text_col))).alias("content_md5"))
    kept = rows.join(losers, (F.col(id_col) == F.col("_lost")) & (F.col("content_md5") == F.col("_md5")), "left_anti")
    return kept.select(id_col, *[c for c in df.columns if c != id_col], "content_md5")
