"""Queries on tables as text and on key/value text, built from ``part``."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D, tables as M
from ..operators.answers import extract_numeric_field as numeric_field
from ..params import FIELD_ALIASES, MIME_KINDS
from . import sql as S
from .registry import documents, query, table

COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINE = "'| ' || concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) || ' |'"
HEAD = "'| p_partkey | p_name | p_brand | p_type | p_size | p_retailprice |'"
RULE = "'| --- | --- | --- | --- | --- | --- |'"
BLOCKS = f"""
    numbered AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part),
    blocks AS (
      SELECT rn // 5 AS chunk_index, any_value((n + 4) // 5) AS total_chunks, min(rn) AS row_start, max(rn) + 1 AS row_end,
             {HEAD} || chr(10) || {RULE} || chr(10) || string_agg({LINE}, chr(10) ORDER BY rn) AS content
      FROM numbered GROUP BY rn // 5
    )"""


def md_blocks(spark, folder):
    return M.chunk_rows(table(spark, folder, "part"), "p_partkey")


@query("table_to_markdown", f"""
    SELECT 0::BIGINT AS line_no, {HEAD} AS line UNION ALL SELECT 1, {RULE}
    UNION ALL SELECT row_number() OVER (ORDER BY p_partkey) + 1, {LINE} FROM part""")
def table_to_markdown(spark, folder):
    return M.table_to_markdown(table(spark, folder, "part"), "p_partkey")


@query("chunk_rows", f"""
    WITH {BLOCKS} SELECT chunk_index::BIGINT AS chunk_index, total_chunks::BIGINT AS total_chunks,
      row_start::BIGINT AS row_start, row_end::BIGINT AS row_end,
      'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, content FROM blocks""")
def chunk_rows(spark, folder):
    return md_blocks(spark, folder).withColumn("columns", F.array_join("columns", ","))


@query("chunk_rows_by_source", """
    WITH numbered AS (
      SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part
    )
    SELECT p_type, rn // 7 AS chunk_index, any_value((n + 6) // 7) AS total_chunks, min(rn) AS row_start, max(rn) + 1 AS row_end,
           '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10)
             || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY rn) AS content
    FROM numbered GROUP BY p_type, rn // 7""")
def chunk_rows_by_source(spark, folder):
    part = table(spark, folder, "part").select("p_type", "p_partkey", "p_name")
    return M.chunk_rows(part, "p_partkey", 7, "p_type").drop("columns")


@query("read_markdown_table", """
    SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 5 AS chunk_index, (row_number() OVER (ORDER BY p_partkey) - 1) % 5 AS row_no,
           p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice
    FROM part""")
def read_markdown_table(spark, folder):
    rows = M.read_markdown_table(md_blocks(spark, folder).select("chunk_index", "content"), columns=COLUMNS)
    return rows.withColumn("row_no", F.col("row_no").cast("bigint"))


@query("markdown_blocks", """
    WITH numbered AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part),
    placed AS (SELECT *, rn // 12 AS source, (rn % 12) // 5 AS chunk_index, least(12, n - (rn // 12) * 12) AS size FROM numbered)
    SELECT source, chunk_index, any_value((size + 4) // 5) AS total_chunks, chunk_index * 5 AS row_start,
           any_value(least(size, chunk_index * 5 + 5)) AS row_end,
           '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10)
             || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY rn) AS content
    FROM placed GROUP BY source, chunk_index""")
def markdown_blocks(spark, folder):
    """Table texts of 12 rows, cut into blocks of 5."""
    texts = M.chunk_rows(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey", 12)
    blocks = M.markdown_blocks(texts.select(F.col("chunk_index").alias("source"), "content"), 5)
    numbers = ["total_chunks", "chunk_index", "row_start", "row_end"]
    return blocks.select("source", *[F.col(c).cast("bigint").alias(c) for c in numbers], "content")


def _shapes(spark, folder):
    """Texts of every shape: prose, pages, JSON, tables, lists."""
    docs = documents(spark, folder, True)
    parts = [
        docs.select(F.lit("prose").alias("shape"), F.col("doc_id").alias("id"), "content"),
        docs.select(F.lit("list"), "doc_id", F.concat(F.lit("- "), F.replace("content", F.lit("\n"), F.lit("\n- ")))),
        table(spark, folder, "pages").select(F.lit("page"), "page_id", "html"),
        table(spark, folder, "events").select(F.lit("props"), "event_id", "props"),
        md_blocks(spark, folder).select(F.lit("table"), "chunk_index", "content"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


SHAPES = f"""{BLOCKS},
    shapes AS (
      SELECT 'prose' AS shape, doc_id AS id, text AS content FROM documents
      UNION ALL SELECT 'list', doc_id, '- ' || replace(text, chr(10), chr(10) || '- ') FROM documents
      UNION ALL SELECT 'page', page_id, html FROM pages
      UNION ALL SELECT 'props', event_id, props FROM events
      UNION ALL SELECT 'table', chunk_index, content FROM blocks
    )"""


@query("is_table_text", f"WITH {SHAPES} SELECT shape, id, {S.is_table('content')} AS is_table FROM shapes")
def is_table_text(spark, folder):
    return _shapes(spark, folder).select("shape", "id", T.is_table_text(F.col("content")).alias("is_table"))


@query("detect_format", f"WITH {SHAPES} SELECT shape, id, {S.text_format('content')} AS format FROM shapes")
def detect_format(spark, folder):
    return _shapes(spark, folder).select("shape", "id", T.detect_format(F.col("content")).alias("format"))


def _mime_case():
    return " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in MIME_KINDS.items())


@query("route_by_type", f"""
    WITH {BLOCKS},
    files AS (
      SELECT 'd' || doc_id AS path, CASE WHEN lang = 'en' THEN 'text/plain' WHEN lang = 'fr' THEN 'text/csv'
             WHEN lang = 'de' THEN 'image/png' END AS mime, text AS content FROM documents
      UNION ALL SELECT url || '.XLSX', NULL, html FROM pages
      UNION ALL SELECT 't' || chunk_index, NULL, content FROM blocks
      UNION ALL SELECT 'u' || chunk_index, NULL, replace(content, '---', '###') FROM blocks
    )
    SELECT path, CASE WHEN mime = 'image/png' THEN NULL WHEN (CASE mime {_mime_case()} END) = 'csv' THEN 'csv'
        WHEN ends_with(lower(path), '.xlsx') THEN 'excel'
        WHEN contains(content, '|') AND contains(replace(content, ' ', ''), '-|-') THEN 'markdown'
        WHEN {S.is_table('content')} THEN 'table_text' ELSE 'text' END AS kind,
      CASE WHEN mime = 'image/png' THEN 'unsupported type: image/png' END AS error
    FROM files""")
def route_by_type(spark, folder):
    lang = F.col("lang")
    mime = F.when(lang == "en", "text/plain").when(lang == "fr", "text/csv").when(lang == "de", "image/png")
    docs = documents(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("path"), mime.alias("mime"), "content")
    pages = table(spark, folder, "pages").select(
        F.concat("url", F.lit(".XLSX")).alias("path"), F.lit(None).cast("string").alias("mime"), F.col("html").alias("content")
    )
    blocks = md_blocks(spark, folder)
    tables = blocks.select(F.concat(F.lit("t"), "chunk_index").alias("path"), F.lit(None).cast("string").alias("mime"), "content")
    plain = blocks.select(
        F.concat(F.lit("u"), "chunk_index").alias("path"), F.lit(None).cast("string").alias("mime"),
        F.replace("content", F.lit("---"), F.lit("###")).alias("content"),
    )
    files = docs.unionByName(pages).unionByName(tables).unionByName(plain)
    return D.route_by_type(files).select("path", "kind", "error")


# ---- key/value text -------------------------------------------------------------------

def kv_line_docs(spark, folder):
    text = F.concat_ws(
        "\n", F.concat(F.lit("product_id: "), "p_partkey"), F.concat(F.lit("product_name: "), "p_name"),
        F.concat(F.lit("category: "), "p_type"), F.concat(F.lit("price: "), "p_retailprice"),
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("content"))


def kv_pipe_docs(spark, folder):
    text = F.concat_ws(
        " | ", F.concat(F.lit("商品ID: "), "p_partkey"), F.concat(F.lit("名称: "), F.lit("old")),
        F.concat(F.lit("Name: "), "p_name", F.lit(": new")), F.concat(F.lit("分类: "), "p_type"),
        F.concat(F.lit("价格: "), "p_retailprice", F.lit("元")), F.lit("no pair here"),
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("content"))


def kv_table_docs(spark, folder):
    text = F.concat(
        F.lit("| 编号 | 名称 |\n| --- | --- |\n| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |")
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("content"))


def aliases():
    return T.alias_map(FIELD_ALIASES)


@query("parse_kv", """
    SELECT 'lines' AS shape, p_partkey AS doc_id, unnest(['product_id', 'product_name', 'category', 'price']) AS key,
           unnest([p_partkey::VARCHAR, p_name, p_type, p_retailprice::VARCHAR]) AS value FROM part
    UNION ALL SELECT 'pipes', p_partkey, unnest(['product_id', 'product_name', 'category', 'price']),
           unnest([p_partkey::VARCHAR, p_name || ': new', p_type, p_retailprice::VARCHAR || '元']) FROM part
    UNION ALL SELECT 'table', p_partkey, unnest(['product_id', 'product_name']), unnest([p_partkey::VARCHAR, p_name]) FROM part""")
def parse_kv(spark, folder):
    shapes = {"lines": kv_line_docs, "pipes": kv_pipe_docs, "table": kv_table_docs}
    parts = [make(spark, folder).withColumn("shape", F.lit(name)) for name, make in shapes.items()]
    docs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return docs.select("shape", "doc_id", F.explode(T.parse_kv(F.col("content"), aliases())).alias("key", "value"))


@query("extract_numeric_field", """
    SELECT 'lines' AS shape, p_partkey AS doc_id, p_retailprice AS value FROM part
    UNION ALL SELECT 'pipes', p_partkey, p_retailprice FROM part""")
def extract_numeric_field(spark, folder):
    lines = numeric_field(kv_line_docs(spark, folder), "price", aliases=aliases())
    strict = numeric_field(kv_pipe_docs(spark, folder), "price", aliases=aliases())
    pipes = numeric_field(kv_pipe_docs(spark, folder), "price", unit_suffix=True, aliases=aliases())
    return (
        lines.select(F.lit("lines").alias("shape"), "doc_id", "value")
        .unionByName(strict.select(F.lit("strict").alias("shape"), "doc_id", "value"))
        .unionByName(pipes.select(F.lit("pipes").alias("shape"), "doc_id", "value"))
    )
