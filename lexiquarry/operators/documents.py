"""Documents and collections: normalizing, metadata, routing, editing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_table_text, strip
from .common import broadcast_if_small
from ..params import DEFAULT_ROUTE, EMPTY_MESSAGES, MIME_KINDS, ROUTE_KEYWORDS, SUFFIX_KINDS


def normalize_input(df: DataFrame) -> DataFrame:
    """``content``, ``page_content`` or ``text`` become ``content``; rows without content are dropped."""
    names = [c for c in ("content", "page_content", "text") if c in df.columns]
    if not names:
        raise ValueError("need a column content, page_content or text")
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.coalesce(*names).alias("content")).where(F.length("content") > 0)


def normalize_all(*parts: DataFrame) -> DataFrame:
    """Inputs of different shapes as one table of documents."""
    first, *others = [normalize_input(p) for p in parts]
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def merge_metadata(own: Column, config: Column, doc_type: Column, extra: Column) -> Column:
    """One map: the document's own entries, under config entries, under ``doc_type``, under extra entries."""
    none = F.create_map().cast("map<string,string>")

    def under(lower: Column, upper: Column) -> Column:
        fresh = F.map_filter(F.coalesce(lower, none), lambda k, _: ~F.map_contains_key(upper, k))
        return F.map_concat(fresh, upper)

    merged = F.coalesce(extra, none)
    for layer in (F.create_map(F.lit("doc_type"), doc_type), config, own):
        merged = under(layer, merged)
    return merged


def route_by_type(df: DataFrame, path: str = "path", mime: str = "mime", content: str = "content") -> DataFrame:
    """Add ``kind`` (csv, excel, markdown, table_text, text) and ``error`` for unsupported MIME types."""
    kind = F.lit(None).cast("string")
    by_mime = F.lit(None).cast("string")
    for name, value in MIME_KINDS.items():
        by_mime = F.when(F.col(mime) == name, value).otherwise(by_mime)
    by_suffix = F.lit(None).cast("string")
    for suffix, value in SUFFIX_KINDS.items():
        by_suffix = F.when(F.lower(path).endswith(suffix), value).otherwise(by_suffix)
    text = F.col(content)
    markdown = text.contains("|") & F.replace(text, F.lit(" "), F.lit("")).contains("-|-")
    unsupported = F.col(mime).isNotNull() & by_mime.isNull()
    kind = (
        F.when(unsupported, F.lit(None).cast("string"))
        .when((by_mime == "csv") | (by_suffix == "csv"), "csv")
        .when((by_mime == "excel") | (by_suffix == "excel"), "excel")
        .when(markdown, "markdown")
        .when(is_table_text(text), "table_text")
        .otherwise("text")
    )
    return df.withColumn("kind", kind).withColumn(
        "error", F.when(unsupported, F.concat(F.lit("unsupported type: "), F.col(mime)))
    )


def route_question(question: Column, rules=ROUTE_KEYWORDS, default: str = DEFAULT_ROUTE) -> Column:
    """The first route, by priority, one of whose keywords occurs in the question."""
    route = F.lit(default)
    for name, words in reversed(tuple(rules)):
        hit = F.lit(False)
        for word in words:
            hit = hit | question.contains(word)
        route = F.when(hit, name).otherwise(route)
    return route


def empty_result_message(
    questions: DataFrame, hits: DataFrame, query_id: str = "query_id", route: str = "route", messages=None
) -> DataFrame:
    """Add ``n_hits`` and, for questions without hits, the fixed answer of their route."""
    messages = EMPTY_MESSAGES if messages is None else messages
    counts = hits.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_hits"))
    message = F.lit(messages["qa"])
    for name, text in messages.items():
        message = F.when(F.col(route) == name, text).otherwise(message)
    joined = questions.join(counts, query_id, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return joined.withColumn("answer", F.when(F.col("n_hits") == 0, message))


def upsert_collection(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version of every key; a version of null is the oldest, and a change wins over an equal version.

    Only the changes and the rows they meet are aggregated; all other rows of
    the collection pass an anti-join with the keys that change.
    """
    keys = broadcast_if_small(changes.select(key).distinct())
    marked = current.join(keys, key, "left_semi").withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in marked.columns if c not in (key, "_new")]
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.col("_new"))
    latest = marked.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    changed = latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return current.join(keys, key, "left_anti").unionByName(changed, allowMissingColumns=True)


def delete_by_id(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def collection_stats(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: status, doc_count, dim_min, dim_max."""
    return df.agg(
        F.when(F.count(F.lit(1)) > 0, "loaded").otherwise("empty").alias("status"),
        F.count(F.lit(1)).alias("doc_count"),
        F.min(F.size(vec_col)).cast("bigint").alias("dim_min"),
        F.max(F.size(vec_col)).cast("bigint").alias("dim_max"),
    )
