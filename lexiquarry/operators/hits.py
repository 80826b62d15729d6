"""Answers from a question's own documents.

The documents of every question's hits are looked up once. All that follows works per question on these few rows: the
extremes of a field, the category that fits best, a numbered list, and which of them a question's route asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import parse_kv, to_number
from ..functions.vectors import cosine
from ..params import FIELD_SIMILARITY, GAMING_QUESTION_WORD, LIST_EMPTY, LIST_INTRO, LIST_UNSUPPORTED, TOP_K
from .answers import asks_extremum, list_item, listed_fields, wants_max
from .common import settled


def documents_of(hits: DataFrame, docs: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query, doc, rank with the columns of the documents. Hits are written first, so a small set is sent to the documents."""
    return settled(hits.select(query_id, doc_id, "rank"), "hits").join(docs, doc_id)


def extremum_of_hits(
    questions: DataFrame, found: DataFrame, default_field: str = "price", k: int = 3, unit_suffix: bool = False, aliases=None,
    query_id: str = "query_id", doc_id: str = "doc_id",
) -> DataFrame:
    """query, field, doc, value, rank: of a question's documents the k with the largest or smallest value of its field.

    ``questions`` (query, query text[, field]); ``found`` as ``documents_of`` gives it. Questions that ask for no extreme
    have no rows. A task hands on at most k rows per question; ties go to the lower document.
    """
    field = F.coalesce("field", F.lit(default_field)) if "field" in questions.columns else F.lit(default_field)
    asked = questions.where(asks_extremum(F.col("query"))).select(query_id, field.alias("field"), wants_max(F.col("query")).alias("_most"))
    value = to_number(F.try_element_at(parse_kv(F.col("content"), aliases), F.col("field")), unit_suffix)
    # A generated column is computed once; the filter and the order would parse a text again.
    valued = found.join(asked, query_id).select(query_id, "field", doc_id, "_most", F.explode(F.array(value)).alias("value")).where("value IS NOT NULL")
    order = Window.partitionBy(query_id).orderBy(F.when(F.col("_most"), -F.col("value")).otherwise(F.col("value")), doc_id)
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_most")


def category_of_hits(
    words: DataFrame, found: DataFrame, categories: DataFrame, threshold: float = FIELD_SIMILARITY, query_id: str = "query_id", doc_id: str = "doc_id"
) -> DataFrame:
    """query, category, doc, rank: a question's documents in or near the one of their categories that fits a word of it best.

    ``words`` (query, word_vec), ``found`` with a category, ``categories`` (category, category_vec). Only categories of
    the question's own documents are compared, so work and output are bounded by its hits. Ranks follow the hits.
    """
    own = found.select(query_id, "category").distinct().join(categories.select("category", "category_vec"), "category")
    fit = own.join(words.select(query_id, "word_vec"), query_id).withColumn("s", cosine(F.col("word_vec"), F.col("category_vec")))
    best = fit.where("s > 0").groupBy(query_id).agg(F.min(F.struct((-F.round("s", 12)).alias("neg"), "category")).alias("b"))
    best = best.select(query_id, F.col("b.category").alias("chosen"))
    chosen = best.join(categories.select(F.col("category").alias("chosen"), F.col("category_vec").alias("chosen_vec")), "chosen")
    near = own.join(chosen, query_id).where((F.col("category") == F.col("chosen")) | (cosine(F.col("category_vec"), F.col("chosen_vec")) >= threshold))
    kept = found.select(query_id, "category", doc_id, "rank").join(near.select(query_id, "category", "chosen"), [query_id, "category"])
    order = Window.partitionBy(query_id).orderBy("rank", doc_id)
    return kept.select(query_id, F.col("chosen").alias("category"), doc_id, F.row_number().over(order).alias("rank"))


def list_of_hits(found: DataFrame, labels: dict[str, str] | None = None, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query, item_no, doc, item: of a question's documents those whose features or graphics name a keyword, numbered in their order."""
    kept = listed_fields(found, labels, keep=[query_id, doc_id, "rank"])
    order = Window.partitionBy(query_id).orderBy("rank", doc_id)
    return kept.withColumn("item_no", F.row_number().over(order)).select(query_id, "item_no", doc_id, list_item().alias("item"))


def hits_by_route(
    questions: DataFrame, found: DataFrame, words: DataFrame, categories: DataFrame, k: int = TOP_K, query_id: str = "query_id", doc_id: str = "doc_id", **fields
) -> DataFrame:
    """query, doc, rank: the documents a question is to be answered from, by its route.

    Comparisons get the extremes of their field, recommendations the documents of the fitting category; both keep all
    hits if there is none. Other routes keep their hits. Each branch sees only its own questions; ``questions`` has a
    route, ``found`` the documents with their category.
    """
    routed = found.join(questions.select(query_id, "route"), query_id)
    compared = extremum_of_hits(questions.where("route = 'comparison'"), routed.where("route = 'comparison'").drop("route"), query_id=query_id, doc_id=doc_id, **fields)
    fitting = category_of_hits(words, routed.where("route = 'recommendation'").drop("route"), categories, query_id=query_id, doc_id=doc_id)
    narrowed = compared.select(query_id, doc_id, "rank").unionAll(fitting.select(query_id, doc_id, "rank"))
    narrowed = settled(narrowed.where(F.col("rank") <= k), "narrowed")
    rest = routed.select(query_id, doc_id, "rank").join(narrowed.select(query_id).distinct(), query_id, "left_anti")
    return narrowed.unionAll(rest.where(F.col("rank") <= k))


def list_answers(questions: DataFrame, items: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query, answer for every question: the head and the items of its own list, or the message for an empty or another kind of list."""
    packed = items.groupBy(query_id).agg(F.array_join(F.array_sort(F.collect_list(F.struct("item_no", "item")))["item"], "\n").alias("_items"))
    gaming = F.col("query").contains(GAMING_QUESTION_WORD)
    whole = F.when(F.col("_items").isNotNull(), F.concat(F.lit(LIST_INTRO + "\n"), "_items")).otherwise(LIST_EMPTY)
    return questions.join(packed, query_id, "left").select(query_id, F.when(gaming, whole).otherwise(LIST_UNSUPPORTED).alias("answer"))


def messages_as_of(
    turns: DataFrame, last: int = 50, system: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turn, pos, role, content: for every user turn the messages a model would get, its question last.

    Before the question come up to ``last`` earlier messages, in order, and before these the ``system`` message. Turns
    are shuffled once, by conversation; the messages of a question are copied to it behind that shuffle. Turns are
    ordered by turn, then role and text; rows of the same turn are messages of their own.
    """
    order = Window.partitionBy(conv_id).orderBy(F.col(turn).asc_nulls_first(), role, text)
    upto = F.collect_list(F.struct(F.col(role).alias("role"), F.col(text).alias("content"))).over(order.rowsBetween(-last, 0))
    asked = turns.select(conv_id, F.col(turn).alias("turn"), F.col(role).alias("_asks"), upto.alias("_upto")).where("_asks = 'user'")
    first = 1
    if system is not None:
        head = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
        asked, first = asked.withColumn("_upto", F.concat(F.array(head), "_upto")), 0
    return asked.select(conv_id, "turn", F.posexplode("_upto").alias("_at", "_message")).select(
        conv_id, "turn", (F.col("_at") + first).cast("bigint").alias("pos"), "_message.role", "_message.content"
    )
