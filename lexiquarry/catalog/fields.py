"""Field-schema queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A, fields as L
from ..operators.numbering import number_rows
from ..params import FIELD_ALIASES
from . import sql as S
from .registry import query, table, vectors

PART_FIELDS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
EVENT_FIELDS = ["user_id", "event_type", "value", "props", "day"]
FLOAT = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan))$"


def _type_sql(v):
    return rf"""CASE WHEN regexp_matches({S.strip(v)}, '{FLOAT}') THEN 'NUMERIC'
      WHEN regexp_matches({v}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})') THEN 'DATETIME'
      WHEN lower({v}) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'BOOLEAN' ELSE 'TEXT' END"""


def _unpivot(name, pos, columns):
    return " UNION ALL ".join(f"SELECT '{label}' AS field, {S.strip(f'({expr})::VARCHAR')} AS value, {pos} AS pos FROM {name}" for label, expr in columns)


DAY = "strftime(ts, '%Y-%m-%d')"
EVENT_COLUMNS = [("user_id", "user_id"), ("event_type", "event_type"), ("value", "value"), ("props", "props"), ("day", DAY)]
VALUES = f"""
    vals AS (
      SELECT 'part' AS tbl, * FROM ({_unpivot('part', 'p_partkey', [(c, c) for c in PART_FIELDS])})
      UNION ALL SELECT 'events', * FROM ({_unpivot('events', 'event_id', EVENT_COLUMNS)})
    )"""
LEARNED = f"""{VALUES},
    typed AS (SELECT tbl, field, value, pos, {_type_sql('value')} AS type FROM vals),
    counts AS (SELECT tbl, field, type, count(*) AS n, min(pos) AS seen FROM typed GROUP BY ALL),
    best AS (SELECT tbl, field, sum(n) OVER (PARTITION BY tbl, field) AS samples, type,
                    row_number() OVER (PARTITION BY tbl, field ORDER BY n DESC, seen) AS place FROM counts),
    stats AS (SELECT tbl, field, min(try_cast(value AS DOUBLE)) AS mn, max(try_cast(value AS DOUBLE)) AS mx, avg(try_cast(value AS DOUBLE)) AS av
              FROM vals WHERE value <> '' GROUP BY ALL HAVING bool_and(regexp_matches(value, '{FLOAT}'))),
    learned AS (
      SELECT b.tbl, b.field, CASE WHEN b.field = 'p_type' THEN 'CATEGORY' ELSE b.type END AS type, samples::BIGINT AS samples, mn, mx, av
      FROM best b LEFT JOIN stats s ON b.tbl = s.tbl AND b.field = s.field WHERE place = 1
    )"""


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def _both(spark, folder, run):
    part = run(table(spark, folder, "part"), PART_FIELDS, "p_partkey").withColumn("tbl", F.lit("part"))
    events = run(_events(spark, folder), EVENT_FIELDS, "event_id").withColumn("tbl", F.lit("events"))
    return part.unionByName(events)


def _learned(spark, folder):
    return _both(spark, folder, lambda df, cols, pos: L.learn_fields(df, cols, pos, None, {"p_type": "CATEGORY"}))


@query("guess_type", f"WITH {VALUES} SELECT tbl, field, pos, {_type_sql('value')} AS type FROM vals")
def guess_type(spark, folder):
    values = _both(spark, folder, L.to_fields)
    return values.select("tbl", "field", "pos", T.guess_type(F.col("value")).alias("type"))


@query("learn_fields", f"""
    WITH {LEARNED} SELECT tbl, field, type, samples, CASE WHEN type = 'NUMERIC' THEN round(mn, 4) END AS min_value,
      CASE WHEN type = 'NUMERIC' THEN round(mx, 4) END AS max_value, CASE WHEN type = 'NUMERIC' THEN round(av, 4) END AS avg_value FROM learned""")
def learn_fields(spark, folder):
    learned = _learned(spark, folder)
    for column in ("min_value", "max_value", "avg_value"):
        learned = learned.withColumn(column, F.round(column, 4))
    return learned


@query("field_statistics", f"""
    WITH {VALUES} SELECT tbl, field, min(try_cast(value AS DOUBLE)) AS min_value, max(try_cast(value AS DOUBLE)) AS max_value,
      round(avg(try_cast(value AS DOUBLE)), 4) AS avg_value
    FROM vals WHERE value <> '' GROUP BY ALL HAVING bool_and(regexp_matches(value, '{FLOAT}'))""")
def field_statistics(spark, folder):
    stats = _both(spark, folder, lambda df, cols, pos: L.field_statistics(L.to_fields(df, cols, pos)))
    return stats.withColumn("avg_value", F.round("avg_value", 4))


@query("sample_values", f"""
    WITH {VALUES}, firsts AS (SELECT *, row_number() OVER (PARTITION BY tbl, field ORDER BY pos) AS place FROM vals)
    SELECT DISTINCT tbl, field, value FROM firsts WHERE place <= 10""")
def sample_values(spark, folder):
    return _both(spark, folder, lambda df, cols, pos: L.sample_values(L.to_fields(df, cols, pos)))


@query("distinct_categories", "SELECT DISTINCT p_type AS category FROM part WHERE p_type <> ''")
def distinct_categories(spark, folder):
    return L.distinct_categories(table(spark, folder, "part"), "p_type")


@query("field_groups", f"""
    WITH {LEARNED}
    SELECT DISTINCT 'name' AS kind, string_split(field, '_')[1] AS group_name, field FROM learned
    UNION ALL SELECT DISTINCT 'type', lower(type), field FROM learned""")
def field_groups(spark, folder):
    return L.field_groups(_learned(spark, folder))



@query("validate_fields", """
    WITH vals AS (
      SELECT p_partkey AS id, unnest(['p_size', 'p_name', 'p_retailprice', 'p_brand']) AS field,
             unnest([p_size::VARCHAR, p_name, p_retailprice::VARCHAR, p_brand]) AS value FROM part
      UNION ALL SELECT o_orderkey, 'o_orderdate', CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders
    ),
    flags AS (
      SELECT id, field, value,
        field = 'p_size' AND (try_cast(value AS DOUBLE) < 5 OR try_cast(value AS DOUBLE) > 40) AS bad_range,
        field = 'p_name' AND length(value) > 10 AS bad_length,
        field = 'p_retailprice' AND coalesce(try_cast(value AS DOUBLE) <> floor(try_cast(value AS DOUBLE)), false) AS bad_integer,
        field = 'o_orderdate' AND length(value) < 10 AS bad_date
      FROM vals
    )
    SELECT id, field, value, bad_range, bad_length, bad_integer, bad_date,
      concat_ws(',', CASE WHEN bad_range THEN 'range' END, CASE WHEN bad_length THEN 'length' END,
                CASE WHEN bad_integer THEN 'integer' END, CASE WHEN bad_date THEN 'date' END) AS errors FROM flags""")
def validate_fields(spark, folder):
    part, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    fields = ["p_size", "p_name", "p_retailprice", "p_brand"]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    values = part.select(F.col("p_partkey").alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.value")
    day = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    dates = orders.select(F.col("o_orderkey").alias("id"), F.lit("o_orderdate").alias("field"), day.alias("value"))
    rules = spark.createDataFrame(
        [("p_size", 5.0, 40.0, None, None, None), ("p_name", None, None, 10, None, None),
         ("p_retailprice", None, None, None, False, None), ("o_orderdate", None, None, None, None, "yyyy-MM-dd")],
        "field string, min_value double, max_value double, max_length int, allow_decimal boolean, date_format string",
    )
    checked = L.validate_fields(values.unionByName(dates), rules)
    return checked.withColumn("errors", F.array_join("errors", ","))


# ---- aliases and categories -------------------------------------------------------------

def _name_case():
    return "CASE p_size % 5 WHEN 0 THEN ' 商品ID ' WHEN 1 THEN 'NAME' WHEN 2 THEN '价格' WHEN 3 THEN 'Stock' ELSE upper(p_brand) END"


@query("resolve_field", f"""
    SELECT p_partkey, {_name_case()} AS field,
      CASE p_size % 5 WHEN 0 THEN 'product_id' WHEN 1 THEN 'product_name' WHEN 2 THEN 'price' WHEN 3 THEN 'stock' ELSE lower(p_brand) END AS standard_field
    FROM part""")
def resolve_field(spark, folder):
    rows = [(a, name, i) for i, (name, _, alts) in enumerate(FIELD_ALIASES) for a in alts]
    rows.append(("NAME", "other_field", len(rows)))
    alias_table = spark.createDataFrame(rows, "alias string, standard string, ord bigint")
    names = table(spark, folder, "part").select("p_partkey", F.expr(_name_case()).alias("field"))
    return L.resolve_field(names, alias_table)


@query("normalize_category", """
    SELECT p_partkey, p_type AS category,
      CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'SMALL' THEN 'compact' WHEN 'MEDIUM' THEN 'compact' ELSE p_type END AS canonical FROM part""")
def normalize_category(spark, folder):
    mapping = spark.createDataFrame(
        [("economy", "budget"), (" Small", "compact"), ("MEDIUM", "compact")], "alias string, canonical string"
    )
    named = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("category"))
    return L.normalize_category(named, mapping)


# Words are the vectors of ``embeddings``; labels stand for fields and their mean vectors for aliases.
@query("match_field_semantic", f"""
    WITH {S.LABEL_CENTERS},
    pairs AS (
      SELECT vec_id // 5 AS query_id, 'w' || vec_id AS word, 'a' || c.label AS alias, 'f' || c.label AS field,
             list_cosine_similarity(embedding::DOUBLE[], c.vec) AS s
      FROM embeddings, centers c
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, word, alias) AS place FROM pairs)
    SELECT query_id, word, alias, field, round(s, 6) AS similarity FROM best WHERE place = 1 AND s >= 0.35""")
def match_field_semantic(spark, folder):
    v = vectors(spark, folder)
    words = v.select(
        F.floor(F.col("doc_id") / 5).alias("query_id"), F.concat(F.lit("w"), "doc_id").alias("word"),
        F.col("embedding").alias("word_vec"),
    )
    names = A.centroids(v).select(
        F.concat(F.lit("f"), "label").alias("field"), F.concat(F.lit("a"), "label").alias("alias"),
        F.col("vec").alias("alias_vec"),
    )
    return L.match_field_semantic(words, names, 0.35).withColumn("similarity", F.round("similarity", 6))


# Categories of ``part`` in order of name get the mean vectors of labels 0, 1, ...
CATEGORY_SQL = f"""{S.LABEL_CENTERS},
    categories AS (
      SELECT t.category, c.vec FROM (SELECT p_type AS category, row_number() OVER (ORDER BY p_type) - 1 AS n FROM (SELECT DISTINCT p_type FROM part)) t
      JOIN centers c ON c.label = t.n
    ),
    pairs AS (
      SELECT e.label AS query_id, e.vec_id, k.category, list_cosine_similarity(e.embedding::DOUBLE[], k.vec) AS s FROM embeddings e, categories k
    ),
    chosen AS (
      SELECT query_id, category FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, category) AS place FROM pairs WHERE s > 0
      ) WHERE place = 1
    ),
    matched AS (
      SELECT c.query_id, c.category, p.p_partkey AS doc_id, p.p_name
      FROM chosen c JOIN categories a ON a.category = c.category
      JOIN categories b ON list_cosine_similarity(a.vec, b.vec) >= 0.7 - 1e-12
      JOIN part p ON p.p_type = b.category
    )"""


def _category_parts(spark, folder):
    v = vectors(spark, folder)
    words = v.select(
        F.col("label").cast("bigint").alias("query_id"), F.concat(F.lit("w"), "doc_id").alias("word"),
        F.col("embedding").alias("word_vec"),
    )
    part = table(spark, folder, "part")
    names = L.distinct_categories(part, "p_type")
    rank = number_rows(names, "category", name="n").select("category", (F.col("n") - 1).cast("int").alias("label"))
    categories = rank.join(A.centroids(v), "label").select("category", F.col("vec").alias("category_vec"))
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("category"), F.col("p_name").alias("content"))
    return L.category_filter(words, categories, docs)


@query("category_filter", f"WITH {CATEGORY_SQL} SELECT query_id::BIGINT AS query_id, category, doc_id FROM matched")
def category_filter(spark, folder):
    return _category_parts(spark, folder)[0]


@query("category_context", f"""
    WITH {CATEGORY_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM matched)
    SELECT query_id::BIGINT AS query_id, string_agg(p_name, chr(10) ORDER BY place) AS context FROM top WHERE place <= 3 GROUP BY query_id""")
def category_context(spark, folder):
    return _category_parts(spark, folder)[1]
