"""From hits to prompts, lists and chat messages; intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import (
    detect_format,
    format_prefix,
    parse_kv,
    pretty_json,
    strip,
    to_number,
)
from ..params import (
    DOCUMENT_LABEL,
    GAMING_FEATURE_WORDS,
    GAMING_GRAPHICS_WORDS,
    GAMING_QUESTION_WORD,
    GENERAL_INTENT,
    INTENT_GUIDANCE,
    INTENT_THRESHOLD,
    LIST_EMPTY,
    LIST_FIELDS,
    LIST_INTRO,
    LIST_UNKNOWN_NAME,
    LIST_UNKNOWN_PRICE,
    LIST_UNSUPPORTED,
    MAX_WORDS,
    METADATA_KEYS,
    MIN_WORDS,
    PROMPT_CLOSING,
    PROMPT_DOCUMENTS,
    PROMPT_QUESTION,
    PROMPT_TASK,
    SYSTEM_PROMPT,
)
from ..session import materialize
from .common import broadcast_if_small, settled
from .numbering import number_rows
from .search import nearest
from .vectorize import mean_vectors


# ---- intents --------------------------------------------------------------------

def centroids(df: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (label, vec)."""
    return mean_vectors(df, [label_col], vec_col)


def classify_nearest_centroid(
    df: DataFrame,
    centers: DataFrame,
    threshold: float = INTENT_THRESHOLD,
    default: str = GENERAL_INTENT,
    id_col: str = "query_id",
    vec_col: str = "query_vec",
    label_col: str = "label",
) -> DataFrame:
    """(id, intent, similarity): label of the most similar centroid, or ``default`` below the threshold."""
    best = nearest(df, centers, "cosine", id_col, label_col, vec_col, "vec")
    return best.select(
        id_col,
        F.when(F.col("similarity") >= threshold, F.col(label_col).cast("string")).otherwise(default).alias("intent"),
        "similarity",
    )


def guidance(intent: Column, table=None, default: str = GENERAL_INTENT) -> Column:
    table = INTENT_GUIDANCE if table is None else table
    text = F.lit(table.get(default, ""))
    for name, value in table.items():
        text = F.when(intent == name, value).otherwise(text)
    return text


# ---- prompts --------------------------------------------------------------------

def format_document(number: Column, metadata: Column, content: Column) -> Column:
    """Numbered document with its known metadata, the name of its format and its content."""
    known = F.map_filter(metadata, lambda k, v: k.isin(*METADATA_KEYS) & v.isNotNull())
    items = F.array_join(
        F.transform(F.map_entries(known), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "
    )
    bracket = F.when(F.length(items) > 0, F.concat(F.lit("["), items, F.lit("]"))).otherwise("")
    kind = detect_format(content)
    return F.concat(
        F.lit(DOCUMENT_LABEL + " "), number.cast("string"), F.lit(" "), bracket, F.lit("\n"),
        format_prefix(kind), F.lit("\n"), pretty_json(content, kind),
    )


def build_prompt(
    questions: DataFrame,
    hits: DataFrame,
    docs: DataFrame,
    intents: DataFrame | None = None,
    system: str | None = SYSTEM_PROMPT,
    query_id: str = "query_id",
    query: str = "query",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(query, prompt, sources): the question with its formatted hits in rank order and the guidance.

    Hits are cut to the top k and written before they meet the documents, so a
    small set of hits is broadcast and the documents are only scanned.
    """
    found = settled(hits.select(query_id, doc_id, "rank"), "hits").join(docs.select(doc_id, "content", "metadata"), doc_id)
    formatted = found.select(
        query_id, "rank", F.col(doc_id).cast("string").alias("_src"),
        format_document(F.col("rank"), F.col("metadata"), F.col("content")).alias("_text"),
    )
    # At most k documents per question.
    packed = formatted.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "_src", "_text"))).alias("_docs")
    )
    asked = questions.select(query_id, query).join(packed, query_id)
    if intents is None:
        asked = asked.withColumn("intent", F.lit(GENERAL_INTENT))
    else:
        asked = asked.join(intents.select(query_id, "intent"), query_id, "left").withColumn(
            "intent", F.coalesce("intent", F.lit(GENERAL_INTENT))
        )
    user = F.concat(
        F.lit(PROMPT_QUESTION), F.col(query), F.lit("\n\n" + PROMPT_TASK), F.col("intent"), F.lit("\n"),
        guidance(F.col("intent")), F.lit("\n\n" + PROMPT_DOCUMENTS + "\n"),
        F.array_join("_docs._text", "\n\n"), F.lit("\n\n" + PROMPT_CLOSING),
    )
    prompt = user if system is None else F.concat(F.lit(system + "\n\n"), user)
    return asked.select(query_id, prompt.alias("prompt"), F.col("_docs._src").alias("sources"))


# ---- chat -----------------------------------------------------------------------

def chat_messages(
    turns: DataFrame,
    system: str | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Messages in order as rows (conv_id, pos, role, content); ``system`` adds a first message.

    One row per message keeps a conversation of any length distributed.
    """
    body = number_rows(turns, turn, [conv_id], name="pos").select(
        conv_id, "pos", F.col(role).alias("role"), F.col(text).alias("content")
    )
    if system is None:
        return body
    head = turns.select(conv_id).distinct().select(
        conv_id, F.lit(0).cast("bigint").alias("pos"), F.lit("system").alias("role"), F.lit(system).alias("content")
    )
    return head.unionByName(body)


def chat_prompt(messages: DataFrame, segment: int = 256, conv_id: str = "conv_id") -> DataFrame:
    """Text form (conv_id, segment, prompt): ``Role: text`` paragraphs, ending with ``Assistant: ``.

    A conversation of up to ``segment`` messages is one row. A longer one comes
    in several rows which, joined in order, are the whole prompt.
    """
    lines = messages.select(
        conv_id,
        "pos",
        F.floor(F.col("pos") / segment).alias("segment"),
        F.concat(F.initcap("role"), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("_line"),
    )
    parts = lines.groupBy(conv_id, "segment").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "_line")))["_line"], "").alias("_text")
    )
    last = parts.groupBy(conv_id).agg(F.max("segment").alias("_last"))
    return parts.join(last, conv_id).select(
        conv_id, "segment",
        F.concat("_text", F.when(F.col("segment") == F.col("_last"), "Assistant: ").otherwise("")).alias("prompt"),
    )


# ---- answers from fields -----------------------------------------------------------

def extract_numeric_field(
    df: DataFrame, field: str, unit_suffix: bool = False, text_col: str = "content", aliases=None
) -> DataFrame:
    """Documents whose key/value text has ``field`` as a number, with its ``value``."""
    fields = parse_kv(F.col(text_col), aliases)
    return df.withColumn("value", to_number(F.try_element_at(fields, F.lit(field)), unit_suffix)).where(
        F.col("value").isNotNull()
    )


def wants_max(question: Column) -> Column:
    hit = F.lit(False)
    for word in MAX_WORDS:
        hit = hit | question.contains(word)
    return hit


def asks_extremum(question: Column) -> Column:
    hit = F.lit(False)
    for word in (*MAX_WORDS, *MIN_WORDS):
        hit = hit | question.contains(word)
    return hit


def extremum_topk(
    queries: DataFrame,
    docs: DataFrame,
    default_field: str = "price",
    k: int = 3,
    unit_suffix: bool = False,
    aliases=None,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Documents with the largest or smallest value of the field a question names, and their joined text.

    ``queries`` (query, query text[, field]). The top k per field and direction
    is found once and joined to the questions, however many there are.
    """
    field = F.coalesce("field", F.lit(default_field)) if "field" in queries.columns else F.lit(default_field)
    asked = queries.where(asks_extremum(F.col("query"))).select(
        query_id, field.alias("field"), wants_max(F.col("query")).alias("descending")
    )
    wanted = asked.select("field", "descending").distinct()
    values = docs.select(doc_id, F.explode(parse_kv(F.col("content"), aliases)).alias("field", "_text")).select(
        doc_id, "field", to_number(F.col("_text"), unit_suffix).alias("value")
    ).where(F.col("value").isNotNull())
    signed = values.join(broadcast_if_small(wanted), "field").withColumn(
        "_key", F.when(F.col("descending"), -F.col("value")).otherwise(F.col("value"))
    )
    order = Window.partitionBy("field", "descending").orderBy("_key", doc_id)
    top = signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_key")
    hits = asked.join(top, ["field", "descending"]).select(query_id, "field", doc_id, "value", "rank")
    context = (
        settled(hits, "extremes").join(docs.select(doc_id, "content"), doc_id)
        .groupBy(query_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_d"))
        .select(query_id, F.array_join("_d.content", "\n").alias("context"))
    )
    return hits, context


def labelled_line(text: Column, label: str) -> Column:
    """Text behind the first line ``label:`` (either colon), or null."""
    found = F.regexp_extract(text, rf"(?md)^.*?{label}[:：](.*)$", 1)
    return F.when(text.rlike(rf"{label}[:：]"), strip(found))


def list_answer(questions: DataFrame, items: DataFrame, query: str = "query") -> DataFrame:
    """Add ``answer``: the head of the item list, or the message for an empty list or another kind of list."""
    found = items.agg(F.count(F.lit(1))).scalar()
    listed = F.when(found > 0, LIST_INTRO).otherwise(LIST_EMPTY)
    return questions.withColumn(
        "answer", F.when(F.col(query).contains(GAMING_QUESTION_WORD), listed).otherwise(LIST_UNSUPPORTED)
    )


def listed_fields(
    docs: DataFrame, labels: dict[str, str] | None = None, feature_words=GAMING_FEATURE_WORDS, graphics_words=GAMING_GRAPHICS_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` and the labelled lines of the documents whose features or graphics name a keyword."""
    labels = LIST_FIELDS if labels is None else labels
    parsed = docs.select(*(keep or ["doc_id"]), *[labelled_line(F.col("content"), label).alias(f"_{name}") for name, label in labels.items()])

    def names_one(column: str, words) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.coalesce(F.lower(column).contains(word), F.lit(False))
        return hit

    return parsed.where(names_one("_features", feature_words) | names_one("_graphics", graphics_words))


def list_item() -> Column:
    """An item of a list from ``item_no`` and the labelled lines; missing lines are left out."""

    def optional(column: str, head: str) -> Column:
        filled = F.when(F.length(column) > 0, F.col(column))
        return F.concat(F.lit(head), filled)

    return F.concat_ws(
        "\n",
        F.concat(F.col("item_no").cast("string"), F.lit(". "), F.coalesce("_name", F.lit(LIST_UNKNOWN_NAME))),
        F.concat(F.lit("   价格："), F.coalesce("_price", F.lit(LIST_UNKNOWN_PRICE))),
        F.lit("   配置："),
        optional("_processor", "   - 处理器："),
        optional("_memory", "   - 内存："),
        optional("_storage", "   - 存储："),
        optional("_graphics", "   - 显卡："),
        optional("_features", "   特点："),
    )


def filter_list(
    docs: DataFrame,
    labels: dict[str, str] | None = None,
    feature_words=GAMING_FEATURE_WORDS,
    graphics_words=GAMING_GRAPHICS_WORDS,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Numbered items (item_no, doc, item) for the documents whose features or graphics name a keyword.

    Missing lines are left out. Items stay rows: a list of any length is whole.
    """
    kept = listed_fields(docs, labels, feature_words, graphics_words, [doc_id])
    # Numbering reads its input three times; the texts are parsed once.
    return number_rows(materialize(kept, "list"), doc_id, name="item_no").select("item_no", doc_id, list_item().alias("item"))
