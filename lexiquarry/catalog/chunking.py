"""Chunking queries."""

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..params import CHUNK_PRESETS, CJK_SEPARATORS, CODE_SEPARATORS
from . import sql as S
from .registry import documents, query, table

SIZE, OVERLAP = 512, 80
OUT = "SELECT id AS doc_id, chunk::BIGINT AS chunk, total_chunks::BIGINT AS total_chunks, content FROM chunks"
LANG_PRESETS = {"en": "english", "fr": "normal_text", "de": "long_text", "es": "short_text"}


def _out(df, *extra):
    return df.select(
        "doc_id", *extra, F.col("chunk").cast("bigint").alias("chunk"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"), "content",
    )


def _texts(spark, folder):
    return documents(spark, folder).select("doc_id", "content")



def _sep_sql(id_col, text_col, table_name, size, overlap, seps):
    docs = (
        f"SELECT {id_col} AS id, {text_col} AS txt, {size}::BIGINT AS size, {overlap}::BIGINT AS overlap, "
        f"{S.text_list([s for s in seps if s])} AS seps FROM {table_name}"
    )
    return f"WITH RECURSIVE {S.separator_chunks(docs)} {OUT}"


@query("chunk_fixed", f"""
    WITH src AS (SELECT doc_id AS id, text AS txt, length(text) AS n FROM documents WHERE text <> ''),
    parts AS (
      SELECT id, txt, n, unnest(CASE WHEN n <= {SIZE} THEN [0::BIGINT] ELSE range(0, (n - {OVERLAP})::BIGINT, {SIZE - OVERLAP}) END) AS place FROM src
    ),
    chunks AS (
      SELECT id, place // {SIZE - OVERLAP} AS chunk, count(*) OVER (PARTITION BY id) AS total_chunks,
             substring(txt, place + 1, {SIZE}) AS content FROM parts
    ) {OUT}""")
def chunk_fixed(spark, folder):
    return _out(C.chunk_fixed(_texts(spark, folder), SIZE, OVERLAP))


@query("chunk_separator", _sep_sql("doc_id", "text", "documents", SIZE, OVERLAP, CHUNK_PRESETS["english"].separators))
def chunk_separator(spark, folder):
    return _out(C.chunk_separator(_texts(spark, folder), SIZE, OVERLAP, CHUNK_PRESETS["english"].separators))


def _preset_rows():
    rows = []
    for lang, name in [*LANG_PRESETS.items(), ("other", "auto")]:
        p = CHUNK_PRESETS[name]
        rows.append(f"({S.text(lang)}, {p.size}::BIGINT, {p.overlap}::BIGINT, {S.text_list(p.separators)})")
    return ", ".join(rows)


@query("chunk_presets", f"""
    WITH RECURSIVE presets AS (SELECT * FROM (VALUES {_preset_rows()}) AS v(lang, size, overlap, seps)),
    {S.separator_chunks('''SELECT doc_id AS id, text AS txt, p.size, p.overlap, p.seps FROM documents d
      JOIN presets p ON p.lang = CASE WHEN d.lang IN ('en', 'fr', 'de', 'es') THEN d.lang ELSE 'other' END''')} {OUT}""")
def chunk_presets(spark, folder):
    preset = F.lit("auto")
    for lang, name in LANG_PRESETS.items():
        preset = F.when(F.col("lang") == lang, name).otherwise(preset)
    return _out(C.split_documents(documents(spark, folder).select("doc_id", "lang", "content"), preset))


@query("split_documents", f"""
    WITH RECURSIVE {S.separator_chunks(
        "SELECT doc_id AS id, text AS txt, 1024::BIGINT AS size, 200::BIGINT AS overlap, "
        + S.text_list(CHUNK_PRESETS["auto"].separators) + " AS seps FROM documents")}
    SELECT c.id AS doc_id, d.source, d.lang, c.chunk::BIGINT AS chunk, c.total_chunks::BIGINT AS total_chunks, c.content
    FROM chunks c JOIN documents d ON d.doc_id = c.id""")
def split_documents(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source", "lang", "content")
    return _out(C.split_documents(docs), "source", "lang")


@query("chunk_regex", f"WITH RECURSIVE {S.regex_chunks('SELECT doc_id AS id, text AS txt FROM documents', r',[ ]+', 300, 50)} {OUT}")
def chunk_regex(spark, folder):
    return _out(C.chunk_regex(_texts(spark, folder), 300, 50, r",[ ]+"))


@query("chunk_paragraph", "WITH RECURSIVE " + S.regex_chunks(
    "SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS txt FROM documents", r"\n\s*\n", 300, 50) + OUT)
def chunk_paragraph(spark, folder):
    docs = _texts(spark, folder).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return _out(C.explode_chunks(docs, C.paragraph_chunks(F.col("content"), 300, 50)))


@query("chunk_sentence", f"WITH RECURSIVE {S.regex_chunks('SELECT doc_id AS id, text AS txt FROM documents', r'[.!?。！？]\s+', 300, 50)} {OUT}")
def chunk_sentence(spark, folder):
    return _out(C.explode_chunks(_texts(spark, folder), C.sentence_chunks(F.col("content"), 300, 50)))


@query("chunk_code", _sep_sql("page_id", "html", "pages", 512, 50, CODE_SEPARATORS))
def chunk_code(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return _out(C.explode_chunks(pages, C.code_chunks(F.col("content"), 512, 50)))


@query("chunk_cjk", _sep_sql("doc_id", "replace(replace(text, '. ', '。'), ', ', '，')", "documents", 400, 60, CJK_SEPARATORS))
def chunk_cjk(spark, folder):
    text = F.replace(F.replace("content", F.lit(". "), F.lit("。")), F.lit(", "), F.lit("，"))
    docs = _texts(spark, folder).withColumn("content", text)
    return _out(C.explode_chunks(docs, C.cjk_chunks(F.col("content"), 400, 60)))
