"""Token, TF-IDF, keyword-ranking and text-shape queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D, retrieval as R, vectorize as V
from ..operators.search import knn
from ..params import RETRIEVAL_INSTRUCTION
from ..session import materialize
from . import sql as S
from .registry import documents, query, query_vectors, table, vectors

# The SQL equivalents of the stop-word queries name these common words, given as a parameter.
COMMON = ("the", "of", "and", "to", "in", "is", "on", "that", "by", "for", "with", "as", "at", "are", "be")

GRAMS = f"""
    words AS (
      SELECT doc_id, list_filter({S.tokens('text')}, lambda t: NOT list_contains({S.text_list(COMMON)}, t)) AS w FROM documents
    ),
    grams AS (
      SELECT doc_id, list_concat(w, CASE WHEN len(w) > 1
        THEN list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]) ELSE []::VARCHAR[] END) AS g FROM words
    )"""
VOCAB = f"""{GRAMS},
    occurrences AS (SELECT doc_id, unnest(g) AS term FROM grams),
    counts AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM occurrences GROUP BY term
               ORDER BY cf DESC, term LIMIT 5000),
    vocab AS (
      SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, cf, df,
             ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM counts
    )"""


@query("tokenize", f"""
    SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""")
def tokenize(spark, folder):
    return documents(spark, folder, True).select("doc_id", T.tokens(F.col("content")).alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


@query("ngrams_stopwords", f"WITH {GRAMS} SELECT doc_id, len(g)::BIGINT AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM grams")
def ngrams_stopwords(spark, folder):
    grams = T.ngrams(T.tokens(F.col("content")), COMMON)
    return documents(spark, folder, True).select("doc_id", grams.alias("g")).select(
        "doc_id", F.size("g").cast("bigint").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5")
    )


TFIDF_FIT = f"WITH {VOCAB} SELECT idx::BIGINT AS idx, term, cf::BIGINT AS cf, df::BIGINT AS df, round(idf, 6) AS idf FROM vocab"


def fitted(spark, folder):
    return V.tfidf_fit(documents(spark, folder), stop_words=COMMON)


@query("tfidf_fit", TFIDF_FIT)
def tfidf_fit(spark, folder):
    return fitted(spark, folder).withColumn("idf", F.round("idf", 6))


@query("tfidf_vocab", f"WITH {VOCAB} SELECT idx::BIGINT AS idx, term FROM vocab")
def tfidf_vocab(spark, folder):
    return V.tfidf_vocab(fitted(spark, folder))


@query("tfidf_transform", f"""
    WITH {VOCAB},
    tf AS (SELECT doc_id, term, count(*) AS n FROM occurrences GROUP BY ALL),
    weights AS (SELECT doc_id, idx, term, n * idf AS w FROM tf JOIN vocab USING (term))
    SELECT doc_id, idx::BIGINT AS idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weights""")
def tfidf_transform(spark, folder):
    docs = documents(spark, folder)
    vocab = materialize(fitted(spark, folder), "vocabulary")
    return V.tfidf_transform(docs, vocab, COMMON).withColumn(
        "weight", F.round("weight", 6)
    )


@query("word2vec_fit", f"""
    SELECT DISTINCT unnest({S.tokens('text')}) AS word, 100::BIGINT AS dim FROM documents""")
def word2vec_fit(spark, folder):
    """The words that have a vector, and its width; vectors themselves depend on the order of training."""
    return V.word_table(V.word2vec_fit(documents(spark, folder))).select("word", F.size("vec").cast("bigint").alias("dim"))


@query("embed", r"""
    SELECT doc_id, 384::BIGINT AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
           NULL::VARCHAR AS embed_error FROM documents""")
def embed(spark, folder):
    done = V.embed(documents(spark, folder), lambda: V.hashing_encoder(384))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return done.select("doc_id", F.size("embedding").cast("bigint").alias("dim"), F.round(norm, 4).alias("norm"), "embed_error")


@query("vectorizer_registry")
def vectorizer_registry(spark, folder):
    """Vector count and width of every registered method over ``benchmark``."""
    docs = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))
    parts = [
        V.vectorize(docs, name).agg(
            F.lit(name).alias("method"), F.count("embedding").alias("vectors"), F.max(F.size("embedding")).alias("dim")
        )
        for name in sorted(V.VECTORIZERS)
    ]
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


# ---- keyword search ----------------------------------------------------------------

def questions(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("bm25", f"WITH {S.bm25('hits', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM hits")
def bm25(spark, folder):
    hits = R.bm25(questions(spark, folder), documents(spark, folder), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("hybrid_fuse", f"""
    WITH {S.bm25('l', 10)}, {S.knn('r', 10, 'q.vec_id IN (SELECT item_id FROM benchmark)')},
    fused AS (
      SELECT query_id, doc_id, coalesce(1.0 / (60 + l.rank), 0)::DOUBLE + coalesce(1.0 / (60 + r.rank), 0)::DOUBLE AS score
      FROM l FULL JOIN r USING (query_id, doc_id)
    )
    SELECT query_id, doc_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank
    FROM fused QUALIFY rank <= 10""")
def hybrid_fuse(spark, folder):
    """Keyword hits merged with the nearest vectors; a question's vector is the one with its id."""
    asked, docs = questions(spark, folder), documents(spark, folder)
    asked_vectors = query_vectors(spark, folder).join(asked.select("query_id"), "query_id", "left_semi")
    fused = R.hybrid_fuse(R.bm25(asked, docs, 10), knn(asked_vectors, vectors(spark, folder), 10), 10)
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("keywords", f"""
    SELECT item_id AS query_id, array_to_string(list_filter({S.tokens('text')}, lambda t: length(t) > 1), ' ') AS keywords FROM benchmark""")
def keywords(spark, folder):
    return R.keywords(questions(spark, folder)).select("query_id", F.array_join("keywords", " ").alias("keywords"))


@query("encode_prefix", f"""
    SELECT item_id AS query_id, {S.text(RETRIEVAL_INSTRUCTION)} || ' ' || text AS query FROM benchmark
    UNION ALL SELECT -1 - item_id, {S.text(RETRIEVAL_INSTRUCTION)} || text FROM benchmark""")
def encode_prefix(spark, folder):
    asked = questions(spark, folder)
    done = asked.select((-1 - F.col("query_id")).alias("query_id"), F.concat(F.lit(RETRIEVAL_INSTRUCTION), "query").alias("query"))
    return asked.unionByName(done).select("query_id", T.with_instruction(F.col("query")).alias("query"))


@query("parse_rewrites", rf"""
    WITH lines AS (
      SELECT conv_id, turn, text, list_filter(list_transform(string_split(chr(10) || '1. ' || replace(text, chr(10), chr(10) || ' 2) '), chr(10)),
        lambda l: regexp_replace({S.strip('l')}, '^[0-9]+[.)]\s+', '')), lambda l: l <> '') AS ls
      FROM conversations
    ),
    usable AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN [text] ELSE ls END AS ls
               FROM lines JOIN conversations USING (conv_id, turn, text))
    SELECT conv_id::VARCHAR || '-' || turn AS query_id, (generate_subscripts(ls, 1) - 1)::BIGINT AS variant_no, unnest(ls) AS variant FROM usable""")
def parse_rewrites(spark, folder):
    turns = table(spark, folder, "conversations")
    reply = F.concat(
        F.lit("<think>first\nsecond</think>\n1. "), F.replace("text", F.lit("\n"), F.lit("\n 2) "))
    )
    replies = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("role") == "assistant", reply).otherwise(F.lit("<think>nothing\n")).alias("reply"),
    )
    out = R.parse_rewrites(replies)
    return out.select("query_id", F.col("variant_no").cast("bigint").alias("variant_no"), "variant")


@query("doc_identity", """
    SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id::VARCHAR
      WHEN lang IN ('fr', 'de') THEN source || '#' || CASE WHEN lang = 'fr' THEN n_chars ELSE 0 END ELSE md5(text) END AS identity
    FROM documents""")
def doc_identity(spark, folder):
    lang = F.col("lang")
    docs = documents(spark, folder).select(
        F.col("doc_id").alias("row"), F.when(lang == "en", F.col("doc_id")).alias("doc_id"),
        F.when(lang.isin("en", "fr", "de"), F.col("source")).alias("source"),
        F.when(lang == "fr", F.col("n_chars")).alias("chunk"), "content",
    )
    return R.with_identity(docs).select(F.col("row").alias("doc_id"), "identity")


@query("dedup_content", "SELECT min(doc_id) AS doc_id, md5(text) AS content_md5 FROM documents GROUP BY md5(text)")
def dedup_content(spark, folder):
    return R.dedup_content(documents(spark, folder)).select("doc_id", "content_md5")


# ---- shapes of text -----------------------------------------------------------------

@query("preview", "SELECT doc_id, substring(text, 1, 200) || '...' AS preview FROM documents")
def preview(spark, folder):
    return documents(spark, folder).select("doc_id", T.preview(F.col("content")).alias("preview"))


@query("normalize_input", """
    SELECT doc_id, lang, md5(text) AS content_md5 FROM documents WHERE lang <> 'de' AND text <> ''
    UNION ALL SELECT page_id, NULL, md5(html) FROM pages WHERE html <> ''""")
def normalize_input(spark, folder):
    docs, pages = documents(spark, folder), table(spark, folder, "pages")
    emptied = docs.withColumn("content", F.when(F.col("lang") == "de", "").otherwise(F.col("content")))
    all_docs = D.normalize_all(
        emptied.select("doc_id", "lang", "content"),
        pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("page_content")),
    )
    return all_docs.select("doc_id", "lang", F.md5("content").alias("content_md5"))


@query("pretty_json", r"""
    SELECT event_id, regexp_replace(props, '^\{"(\w+)": (\d+)\}$', '{' || chr(10) || '  "\1": \2' || chr(10) || '}') AS pretty FROM events""")
def pretty_json(spark, folder):
    return table(spark, folder, "events").select("event_id", T.pretty_json(F.col("props")).alias("pretty"))


META = "' [source: ' || source || ', title: ' || lang || ']'"


@query("format_document", f"""
    SELECT doc_id, '文档 ' || doc_id || {META} || chr(10) || {S.format_prefix('kind')} || chr(10) || text AS formatted
    FROM (SELECT *, {S.text_format('text')} AS kind FROM documents)""")
def format_document(spark, folder):
    from ..operators.answers import format_document as render

    meta = F.create_map(
        F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("title"), F.col("lang")
    )
    return documents(spark, folder, True).select("doc_id", render(F.col("doc_id"), meta, F.col("content")).alias("formatted"))


@query("merge_metadata", """
    SELECT doc_id, 'source' AS key, source AS value FROM documents
    UNION ALL SELECT doc_id, 'team', 'core' FROM documents
    UNION ALL SELECT doc_id, 'doc_type', 'auto' FROM documents
    UNION ALL SELECT doc_id, 'lang', 'x-' || lang FROM documents""")
def merge_metadata(spark, folder):
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("doc_type"), F.lit("old"))
    config = F.create_map(F.lit("team"), F.lit("core"), F.lit("lang"), F.lit("any"))
    extra = F.create_map(F.lit("lang"), F.concat(F.lit("x-"), F.col("lang")))
    merged = D.merge_metadata(own, config, F.lit("auto"), extra)
    return documents(spark, folder).select("doc_id", F.explode(merged).alias("key", "value"))
