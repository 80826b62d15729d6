"""Field schemas: learning types, statistics, aliases, validation, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import guess_type, standard_name, strip, to_number
from ..params import FIELD_SIMILARITY, SAMPLE_VALUES
from .common import broadcast_if_small, settled
from .search import nearest, within


def to_fields(df: DataFrame, columns: list[str], order_by: str, sample_size: int | None = None) -> DataFrame:
    """Long form (field, value, pos) of string columns; ``sample_size`` keeps the first rows only."""
    if sample_size is not None:
        df = df.orderBy(order_by).limit(sample_size)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), strip(F.col(c).cast("string")).alias("value")) for c in columns
    ])
    return (
        df.select(F.col(order_by).alias("pos"), F.explode(pairs).alias("p"))
        .select("p.field", "p.value", "pos")
        .where(F.col("value").isNotNull())
    )


def learn_fields(
    df: DataFrame,
    columns: list[str],
    order_by: str,
    sample_size: int | None = None,
    declared: dict[str, str] | None = None,
) -> DataFrame:
    """Most common guessed type per field (ties: the type seen first), sample count and statistics.

    All rows are read unless ``sample_size`` asks for the first ones. ``declared`` types win over guesses. All aggregates are partial sums, so a
    field with all the rows is no bottleneck.
    """
    values = to_fields(df, columns, order_by, sample_size)
    typed = values.select(
        "field", guess_type(F.col("value")).alias("type"), "pos", to_number(F.col("value")).alias("x"),
        (F.col("value") != "").cast("int").alias("filled"),
    )
    # One row per field and type; everything else is derived from these few rows.
    counts = typed.groupBy("field", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("seen"), F.sum("filled").alias("filled"),
        F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("total"), F.count("x").alias("numbers"),
    )
    best = counts.groupBy("field").agg(
        F.sum("n").alias("samples"),
        F.min(F.struct((-F.col("n")).alias("neg"), "seen", "type")).alias("b"),
        F.sum(F.when(F.col("type") != "NUMERIC", F.col("filled")).otherwise(0)).alias("bad"),
        F.min("low").alias("min_value"), F.max("high").alias("max_value"),
        (F.sum("total") / F.sum("numbers")).alias("avg_value"),
    )
    kind: Column = F.col("b.type")
    for name, declared_type in (declared or {}).items():
        kind = F.when(F.col("field") == name, declared_type).otherwise(kind)
    known = (F.col("type") == "NUMERIC") & (F.col("bad") == 0)
    return best.withColumn("type", kind).select(
        "field", "type", "samples",
        *[F.when(known, F.col(c)).alias(c) for c in ("min_value", "max_value", "avg_value")],
    )


def field_statistics(values: DataFrame) -> DataFrame:
    """min, max and mean per field; none if a non-empty value is not a number."""
    number = to_number(F.col("value"))
    filled = values.where(F.col("value") != "").select("field", number.alias("x"))
    out = filled.groupBy("field").agg(
        F.bool_and(F.col("x").isNotNull()).alias("_ok"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.avg("x").alias("avg_value"),
    )
    return out.where("_ok").drop("_ok")


def sample_values(values: DataFrame, n: int = SAMPLE_VALUES) -> DataFrame:
    """The distinct values among the first ``n`` of each field, as rows (field, value)."""
    first = Window.partitionBy("field").orderBy("pos")
    return (
        values.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= n)
        .select("field", "value")
        .distinct()
    )


def distinct_categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(strip(F.col(column)).alias("category")).where("category != ''").distinct()


def field_groups(fields: DataFrame) -> DataFrame:
    """Members (kind, group_name, field) of the groups by name prefix and by type."""
    by_name = fields.select(
        F.lit("name").alias("kind"), F.substring_index("field", "_", 1).alias("group_name"), "field"
    )
    by_type = fields.select(F.lit("type").alias("kind"), F.lower("type").alias("group_name"), "field")
    return by_name.unionByName(by_type).distinct()


def resolve_field(names: DataFrame, aliases: DataFrame, name_col: str = "field") -> DataFrame:
    """Add ``standard_field``: aliases (alias, standard, ord) match without case; the first registered wins.

    A standard name stands for itself. Unknown names stay, lower-case and stripped.
    """
    own = aliases.select(F.col("standard").alias("alias"), "standard", F.lit(-1).cast("bigint").alias("ord"))
    both = own.unionByName(aliases.select("alias", "standard", F.col("ord").cast("bigint")))
    table = both.groupBy(standard_name(F.col("alias")).alias("_key")).agg(
        F.min_by("standard", F.struct("ord", "standard")).alias("_std")
    )
    keyed = names.withColumn("_key", standard_name(F.col(name_col)))
    return keyed.join(broadcast_if_small(table), "_key", "left").withColumn(
        "standard_field", F.coalesce("_std", "_key")
    ).drop("_key", "_std")


def match_field_semantic(
    words: DataFrame,
    aliases: DataFrame,
    threshold: float = FIELD_SIMILARITY,
    field_type: str | None = None,
    query_id: str = "query_id",
) -> DataFrame:
    """Per query the field whose alias is most similar to one of its words, if similar enough.

    ``words`` (query, word, word_vec); ``aliases`` (field, alias, alias_vec[, type]).
    """
    if field_type:
        aliases = aliases.where(F.col("type") == field_type)
    vocabulary = words.select("word", "word_vec").dropDuplicates(["word"])
    close = nearest(vocabulary, aliases, "cosine", "word", "alias", "word_vec", "alias_vec")
    field_of = aliases.groupBy("alias").agg(F.min("field").alias("field"))
    scored = words.select(query_id, "word").join(close, "word").join(field_of, "alias")
    best = scored.groupBy(query_id).agg(
        F.min(F.struct((-F.col("similarity")).alias("neg"), "word", "alias", "field")).alias("b")
    )
    return best.select(
        query_id, "b.word", "b.alias", "b.field", (-F.col("b.neg")).alias("similarity")
    ).where(F.col("similarity") >= threshold)


def category_filter(
    query_words: DataFrame,
    categories: DataFrame,
    docs: DataFrame,
    threshold: float = FIELD_SIMILARITY,
    context_size: int = 3,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Documents in or near the category a query names, and the text of its first documents.

    ``query_words`` (query, word, word_vec), ``categories`` (category,
    category_vec), ``docs`` (doc, category, content). Returns
    (query, category, doc) rows and (query, context) rows.
    """
    vocabulary = query_words.select("word", "word_vec").dropDuplicates(["word"])
    close = nearest(vocabulary, categories, "cosine", "word", "category", "word_vec", "category_vec")
    chosen = (
        query_words.select(query_id, "word").join(close, "word").where(F.col("similarity") > 0)
        .groupBy(query_id)
        .agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "category")).alias("b"))
        .select(query_id, F.col("b.category").alias("category"))
    )
    named = categories.select(F.col("category").alias("other"), F.col("category_vec").alias("other_vec"))
    alike = within(categories, named, threshold, "category", "other", "category_vec", "other_vec")
    wanted = settled(chosen.join(alike.select("category", "other"), "category"), "categories")
    matched = docs.select(doc_id, F.col("category").alias("other")).join(wanted, "other").select(
        query_id, "category", doc_id
    )
    first = Window.partitionBy(query_id).orderBy(doc_id)
    top = matched.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= context_size)
    context = (
        settled(top, "category-hits").join(docs.select(doc_id, "content"), doc_id)
        .groupBy(query_id)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "content"))).alias("_parts"))
        .select(query_id, F.array_join("_parts.content", "\n").alias("context"))
    )
    return matched, context


def normalize_category(df: DataFrame, mapping: DataFrame, column: str = "category") -> DataFrame:
    """Replace category aliases (alias, canonical) by their canonical name; other values stay."""
    table = mapping.groupBy(standard_name(F.col("alias")).alias("_key")).agg(F.min("canonical").alias("_canonical"))
    keyed = df.withColumn("_key", standard_name(F.col(column)))
    return keyed.join(broadcast_if_small(table), "_key", "left").withColumn(
        "canonical", F.coalesce("_canonical", column)
    ).drop("_key", "_canonical")


def validate_fields(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Check values (field, value, ...) against rules; ``errors`` lists the broken ones.

    ``rules``: field, min_value, max_value, max_length, allow_decimal,
    date_format (a Spark pattern); a null turns a rule off.
    """
    joined = values.join(broadcast_if_small(rules), "field", "left")
    number = to_number(F.col("value"))
    out_of_range = F.coalesce((number < F.col("min_value")) | (number > F.col("max_value")), F.lit(False))
    too_long = F.coalesce(F.length("value") > F.col("max_length"), F.lit(False))
    fraction = F.coalesce(~F.col("allow_decimal") & (number != F.floor(number)), F.lit(False))
    bad_date = F.col("date_format").isNotNull() & F.try_to_timestamp(
        F.col("value"), F.coalesce("date_format", F.lit("yyyy-MM-dd"))
    ).isNull()
    checks = {"range": out_of_range, "length": too_long, "integer": fraction, "date": bad_date}
    flagged = joined.select(*values.columns, *[c.alias(f"bad_{n}") for n, c in checks.items()])
    errors = F.filter(
        F.array(*[F.when(F.col(f"bad_{n}"), n) for n in checks]), lambda e: e.isNotNull()
    )
    return flagged.withColumn("errors", errors)
