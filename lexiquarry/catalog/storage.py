"""Queries that write and read: files, collections, models, ingest streams."""

from pyspark.sql import functions as F

from ..operators import documents as D, vectorize as V
from ..params import CHUNK_PRESETS, EMBEDDING_DIM
from ..plans import flows
from ..session import work_path
from ..sources import buckets as B, collections as K, files as P
from ..streaming import ingest as G
from . import sql as S
from .registry import documents, query, table, table_stream, vectors
from .text import TFIDF_FIT, fitted


@query("read_text", """
    WITH lines AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT lang, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM lines WHERE line <> '' GROUP BY lang""")
def read_text(spark, folder):
    """Documents written as text files, one folder per language, read back whole and cut into lines."""
    path = work_path(spark, "texts")
    documents(spark, folder).select("lang", "content").write.partitionBy("lang").text(path)
    docs = P.read_text(spark, path, "*.txt")
    lines = docs.select(
        F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split("content", "\n")).alias("line")
    )
    return lines.where("line <> ''").groupBy("lang").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")
    )


@query("read_delimited", "SELECT p_partkey::BIGINT AS p_partkey, p_name || chr(10) || '\"x\"' AS p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def read_delimited(spark, folder):
    """``part`` written with ``;`` and quoted line breaks, read back with a found delimiter and types."""
    path = work_path(spark, "delimited")
    part = table(spark, folder, "part").withColumn("p_name", F.concat("p_name", F.lit('\n"x"')))
    P.write_delimited(part, path, ";")
    back = P.read_delimited(spark, path, multi_line=True)
    return back.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", "p_type",
        F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice",
    )


@query("write_collection", """
    SELECT doc_id, doc_id::VARCHAR || '#0' AS place, lang, len(embedding)::BIGINT AS dim
    FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)""")
def write_collection(spark, folder):
    """Documents with vectors stored in two appends, then read back with their metadata."""
    path = work_path(spark, "collection")
    docs, vecs = documents(spark, folder), vectors(spark, folder).select(F.col("doc_id").alias("vec_id"), "embedding")
    count = vecs.agg(F.count(F.lit(1))).scalar()
    rows = docs.withColumn("vec_id", F.col("doc_id") % count).join(vecs, "vec_id").select(
        "doc_id", F.col("doc_id").cast("string").alias("source"), F.lit(0).alias("chunk"), "content", "embedding",
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    K.write_collection(rows.where(F.col("metadata")["lang"] == "en"), path, 64)
    K.write_collection(rows.where(F.col("metadata")["lang"] != "en"), path, 64)
    back = K.read_collection(spark, path)
    return back.where(F.col("id") == K.collection_id(F.col("source"), F.col("chunk"))).select(
        "doc_id", F.concat_ws("#", "source", "chunk").alias("place"), F.col("metadata")["lang"].alias("lang"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


@query("save_load", TFIDF_FIT)
def save_load(spark, folder):
    """A fitted vocabulary saved and loaded again."""
    path = K.save_model(fitted(spark, folder), work_path(spark, "vocabulary"))
    return K.load_table(spark, path).withColumn("idf", F.round("idf", 6))


@query("upsert_collection", """
    SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_retailprice + 100 ELSE p_retailprice END AS p_retailprice,
           CASE WHEN p_size > 25 THEN 2 ELSE 1 END::BIGINT AS version FROM part""")
def upsert_collection(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    old = part.withColumn("version", F.lit(1).cast("bigint"))
    new = part.where("p_size > 25").withColumn("version", F.lit(2).cast("bigint")).withColumn(
        "p_retailprice", F.col("p_retailprice") + 100
    )
    return D.upsert_collection(old.drop("p_size"), new.drop("p_size"), "p_partkey", "version")


@query("delete_by_id", """
    SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_by_id(spark, folder):
    toxic = table(spark, folder, "labels").where("toxic = 1")
    return D.delete_by_id(documents(spark, folder), toxic).select("doc_id", "lang")


@query("stream_ingest", f"""
    WITH RECURSIVE {S.separator_chunks(
        "SELECT doc_id AS id, text AS txt, 512::BIGINT AS size, 80::BIGINT AS overlap, "
        + S.text_list(CHUNK_PRESETS["english"].separators) + " AS seps FROM documents")}
    SELECT id AS doc_id, chunk::BIGINT AS chunk, total_chunks::BIGINT AS total_chunks, content, 384::BIGINT AS dim FROM chunks""")
def stream_ingest(spark, folder):
    """``documents`` as a stream, cut, embedded and stored batch by batch."""
    docs = table_stream(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"))
    done = G.ingest(
        docs, work_path(spark, "ingest"), work_path(spark, "ingest-checkpoint"), _encoder, preset="english"
    )
    return done.select(
        "doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("total_chunks").cast("bigint").alias("total_chunks"),
        "content", F.size("embedding").cast("bigint").alias("dim"),
    )


@query("stream_questions", f"""
    WITH {S.knn('hits', 3)}
    SELECT query_id, doc_id, rank::BIGINT AS rank, round(exp(-distance / 10), 6) AS score FROM hits""")
def stream_questions(spark, folder):
    """Every vector as a question on a stream, searched in the stored collection."""
    stream = table_stream(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    done = G.answer_questions(
        stream, vectors(spark, folder), work_path(spark, "answers"), work_path(spark, "answers-checkpoint")
    )
    return done.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("stream_ingest_dedup", "SELECT md5(text) AS content_md5, 1::BIGINT AS stored, 384::BIGINT AS dim FROM documents GROUP BY text")
def stream_ingest_dedup(spark, folder):
    """``documents`` arriving in two rounds, the second after a restart; contents that came before are not stored again."""
    incoming, store, checkpoint = (work_path(spark, name) for name in ("incoming", "deduplicated", "deduplicated-checkpoint"))
    docs = documents(spark, folder).select(F.col("doc_id").cast("string").alias("source"), "content", "doc_id")
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).drop("doc_id").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(docs.drop("doc_id").schema).option("maxFilesPerTrigger", 4).parquet(incoming)
        done = G.ingest(G.drop_copies(stream), store, checkpoint, _encoder, preset="english")
    return done.groupBy("content_md5").agg(
        F.count(F.when(F.col("chunk") == 0, 1)).alias("stored"), F.max(F.size("embedding")).cast("bigint").alias("dim")
    )


@query("upsert_stored", """
    SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 100 ELSE p_retailprice END AS p_retailprice,
           CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM part
    UNION ALL SELECT p_partkey + 10000000, p_name, p_retailprice, 2 FROM part WHERE p_partkey % 7 = 0""")
def upsert_stored(spark, folder):
    """``part`` stored in buckets; some rows change, an older version changes nothing, some are new, and all of it comes twice."""
    path = work_path(spark, "buckets")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice").withColumn("version", F.lit(1).cast("bigint"))
    B.write_bucketed(part, path, "p_partkey", 16)
    dearer = part.where("p_partkey % 5 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 100).withColumn("version", F.lit(2).cast("bigint"))
    older = part.where("p_partkey % 3 = 0").withColumn("p_name", F.lit("old")).withColumn("version", F.lit(0).cast("bigint"))
    new = part.where("p_partkey % 7 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000).withColumn("version", F.lit(2).cast("bigint"))
    for _ in range(2):
        for changes in (dearer.unionAll(new), older):
            B.upsert_stored(spark, path, changes, "p_partkey", "version", 16)
    return B.read_bucketed(spark, path).select("p_partkey", "p_name", "p_retailprice", "version")


@query("delete_stored", "SELECT p_partkey, p_name FROM part WHERE p_size <= 25")
def delete_stored(spark, folder):
    """``part`` stored in buckets, from which the large ones are deleted."""
    path = work_path(spark, "buckets")
    part = table(spark, folder, "part")
    B.write_bucketed(part.select("p_partkey", "p_name"), path, "p_partkey", 16)
    B.delete_stored(spark, path, part.where("p_size > 25").select("p_partkey"), "p_partkey", 16)
    return B.read_bucketed(spark, path).select("p_partkey", "p_name")


# ---- whole jobs --------------------------------------------------------------------------

def _encoder():
    return V.hashing_encoder(EMBEDDING_DIM)


@query("add_documents", f"""
    WITH RECURSIVE {S.separator_chunks(
        "SELECT doc_id AS id, text AS txt, 1024::BIGINT AS size, 200::BIGINT AS overlap, "
        + S.text_list(CHUNK_PRESETS["auto"].separators) + " AS seps FROM documents")}
    SELECT md5(source || '/' || doc_id || '#' || chunk) AS id, doc_id, chunk::BIGINT AS chunk, total_chunks::BIGINT AS total_chunks,
           content, 384::BIGINT AS dim
    FROM chunks c JOIN documents d ON d.doc_id = c.id""")
def add_documents(spark, folder):
    """All documents chunked, embedded and appended to a collection; one row per stored chunk."""
    path = work_path(spark, "added-documents")
    docs = documents(spark, folder).withColumn("source", F.concat_ws("/", "source", "doc_id"))
    flows.add_documents(docs, path, _encoder)
    return K.read_collection(spark, path).select(
        "id", "doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("total_chunks").cast("bigint").alias("total_chunks"),
        "content", F.size("embedding").cast("bigint").alias("dim"),
    )


@query("process_files", """
    WITH csv AS (SELECT p_partkey // 7 AS file, count(*) AS n FROM part GROUP BY ALL)
    SELECT 'csv' AS family, count(*) AS sources, 0::BIGINT AS refused, sum(ceil(n / 5.0))::BIGINT AS blocks,
           sum(n)::BIGINT AS rows FROM csv
    UNION ALL SELECT 'doc', count(*), count(*) FILTER (text IS NULL OR text = ''), 0, 0 FROM documents
    UNION ALL SELECT 'page', count(*), count(*) FILTER (html IS NULL OR html = ''), 0, 0 FROM pages
    UNION ALL SELECT 'head', count(*), 0, 0, 0 FROM csv
    UNION ALL SELECT 'table', count(*), 0, sum(ceil(n / 5.0))::BIGINT, sum(n)::BIGINT FROM csv
    UNION ALL SELECT 'xlsx', count(*), count(*), 0, 0 FROM csv""")
def process_files(spark, folder):
    """Documents, pages, delimited texts, pipe tables, tables without rows and workbooks; every source comes out once."""
    part = table(spark, folder, "part").withColumn("file", F.floor(F.col("p_partkey") / 7).cast("string"))
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('\n""x"""'))
    rows = F.sort_array(F.collect_list(F.struct(
        "p_partkey", F.concat_ws(";", "p_partkey", quoted, "p_retailprice").alias("csv"),
        F.concat(F.lit("| "), F.concat_ws(" | ", "p_partkey", "p_name"), F.lit(" |")).alias("bars"),
    )))
    files = part.groupBy("file").agg(rows.alias("rows"))
    made = files.select("file", F.explode(F.array(*[
        F.struct(F.lit(family).alias("family"), F.lit(suffix).alias("suffix"), content.alias("content")) for family, suffix, content in (
            ("csv", "csv", F.concat(F.lit("key;name;price\n"), F.array_join(F.col("rows.csv"), "\n"))),
            ("table", "txt", F.concat(F.lit("| key | name |\n|---|---|\n"), F.array_join(F.col("rows.bars"), "\n"))),
            ("head", "txt", F.lit("| key | name |\n|-|-|")), ("xlsx", "xlsx", F.lit("PK binary")),
        )
    ])).alias("f")).select("f.family", F.concat_ws("/", "f.family", "file").alias("id"), "f.suffix", "f.content")
    docs = table(spark, folder, "documents").select(F.lit("doc").alias("family"), F.concat_ws("/", F.lit("doc"), "doc_id").alias("id"), F.lit("txt").alias("suffix"), F.col("text").alias("content"))
    pages = table(spark, folder, "pages").select(F.lit("page").alias("family"), F.concat_ws("/", F.lit("page"), "page_id").alias("id"), F.lit("txt").alias("suffix"), F.col("html").alias("content"))
    inputs = made.unionAll(docs).unionAll(pages).select(
        F.col("id").alias("source"), F.concat_ws(".", "id", "suffix").alias("path"), F.lit(None).cast("string").alias("mime"), "content"
    )
    chunks, refused = flows.process_files(inputs)
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith("| "))) - 2
    block = F.substring_index("source", "/", 1).isin("csv", "table")
    out = chunks.select("source", F.lit(0).alias("refused"), block.cast("int").alias("blocks"), F.when(block, lines).otherwise(0).alias("rows"))
    out = out.unionAll(refused.select("source", F.lit(1), F.lit(0), F.lit(0)))
    by_source = out.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("refused", "blocks", "rows")])
    return by_source.groupBy(F.substring_index("source", "/", 1).alias("family")).agg(
        F.count(F.lit(1)).alias("sources"), *[F.sum(c).alias(c) for c in ("refused", "blocks", "rows")]
    )


@query("ask")
def ask(spark, folder):
    """Every ``benchmark`` text asked against all documents: route, number of hits, prompt, and the answer without hits."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = V.embed(documents(spark, folder), _encoder).withColumn(
        "metadata", F.create_map(F.lit("source"), F.col("source"))
    )
    out = flows.ask(asked, docs.select("doc_id", "content", "embedding", "metadata"), _encoder)
    return out.select("query_id", "route", "n_hits", "prompt", "answer")


@query("enhanced_retrieval")
def enhanced_retrieval(spark, folder):
    """Every ``benchmark`` text with its lines as rewrites, retrieved and merged."""
    replies = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("reply")
    )
    docs = V.embed(documents(spark, folder), _encoder)
    return flows.enhanced_retrieval(replies, docs, _encoder)
