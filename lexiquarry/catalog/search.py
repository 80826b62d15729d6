"""Vector search queries. Every vector of ``embeddings`` is both a question and a candidate."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import answers as A, approximate as X, documents as D, search as R, vectorize as Z
from ..operators.retrieval import multi_query_retrieve
from ..session import materialize
from . import sql as S
from .registry import as_long, query, query_vectors, table, vectors

HIT = "SELECT query_id, doc_id, rank::BIGINT AS rank, round(distance, 6) AS distance"


def _hits(df, *extra):
    return df.select(
        "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"), *extra
    )


@query("knn_exact", f"WITH {S.knn('hits', 3)} {HIT} FROM hits")
def knn_exact(spark, folder):
    return _hits(R.knn(query_vectors(spark, folder), vectors(spark, folder), 3))


@query("knn_cosine", """
    WITH pairs AS (
      SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
             list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS similarity
      FROM embeddings q, embeddings d
    )
    SELECT query_id, doc_id, round(similarity, 6) AS similarity,
           row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, doc_id)::BIGINT AS rank
    FROM pairs QUALIFY rank <= 5""")
def knn_cosine(spark, folder):
    hits = R.knn(query_vectors(spark, folder), vectors(spark, folder), 5, "cosine")
    return hits.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("score_decay", f"WITH {S.knn('hits', 3)} {HIT}, round(exp(-distance / 10), 6) AS score FROM hits")
def score_decay(spark, folder):
    hits = R.with_score(R.knn(query_vectors(spark, folder), vectors(spark, folder), 3))
    return _hits(hits, F.round("score", 6).alias("score"))


@query("threshold_filter", f"""
    WITH {S.knn('hits', 3)}
    {HIT}, round(exp(-distance / 10), 6) AS score FROM hits WHERE exp(-distance / 10) >= 0.885""")
def threshold_filter(spark, folder):
    hits = R.with_score(R.knn(query_vectors(spark, folder), vectors(spark, folder), 3))
    return _hits(R.threshold_filter(hits, 0.885), F.round("score", 6).alias("score"))


@query("threshold_with_fallback", f"""
    WITH {S.knn('near', 6)},
    hits AS (SELECT query_id, doc_id, distance, exp(-distance / 10) AS score FROM near WHERE query_id <> doc_id),
    marked AS (
      SELECT *, max(score) OVER (PARTITION BY query_id) AS best,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM hits
    )
    SELECT query_id, doc_id, round(distance, 6) AS distance, round(score, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank
    FROM marked WHERE score >= 0.885 OR (best < 0.885 AND place = 1) QUALIFY rank <= 3""")
def threshold_with_fallback(spark, folder):
    near = R.with_score(R.knn(query_vectors(spark, folder), vectors(spark, folder), 6)).where("query_id <> doc_id")
    kept = R.threshold_filter(near, 0.885, keep_best=True, k=3)
    return _hits(kept, F.round("score", 6).alias("score"))


@query("overfetch", f"WITH {S.knn('hits', 3)} {HIT} FROM hits")
def overfetch(spark, folder):
    return _hits(R.overfetch(query_vectors(spark, folder), vectors(spark, folder), 3, 3, R.knn))


def _found(spark, folder, hits):
    """Whether at least nine of ten of the three nearest vectors were found."""
    share = X.recall_of(hits, R.knn(query_vectors(spark, folder), vectors(spark, folder), 3))
    return share.select("queries", (F.col("recall") >= 0.9).alias("enough"))


FOUND = "SELECT count(*) AS queries, true AS enough FROM embeddings"


@query("overfetch_codes", FOUND)
def overfetch_codes(spark, folder):
    """Candidates by product-quantized codes, re-ranked by exact distances, against exact search."""
    corpus = vectors(spark, folder)
    books = X.codebooks(corpus)
    coded = materialize(X.encode(corpus, books), "coded")
    return _found(spark, folder, X.overfetch_coded(query_vectors(spark, folder), coded, books, 3))


@query("overfetch_codes_ranks", f"""
    WITH {S.knn('hits', 3)}, near AS (SELECT query_id, doc_id, distance FROM hits WHERE query_id = doc_id)
    SELECT query_id, round(distance, 6) AS distance, 1::BIGINT AS rank FROM near""")
def overfetch_codes_ranks(spark, folder):
    """The re-ranking: every vector is its own nearest candidate, at its exact distance."""
    corpus = vectors(spark, folder)
    books = X.codebooks(corpus)
    coded = materialize(X.encode(corpus, books), "coded")
    hits = X.overfetch_coded(query_vectors(spark, folder), coded, books, 3)
    return hits.where("query_id = doc_id").select("query_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("knn_ivf", FOUND)
def knn_ivf(spark, folder):
    """Clusters on two levels, probes tuned on a sample; against exact search."""
    corpus = vectors(spark, folder)
    centres = X.coarse_fit(corpus)
    assigned = materialize(X.coarse_assign(corpus, centres), "assigned")
    return _found(spark, folder, X.knn_coarse(query_vectors(spark, folder), assigned, centres, 3))


@query("ivf_assign", f"""
    WITH {S.LABEL_CENTERS}
    SELECT vec_id AS doc_id, label::BIGINT AS cluster FROM (
      SELECT e.vec_id, c.label, row_number() OVER (
        PARTITION BY e.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], c.vec), 12), c.label) AS place
      FROM embeddings e, centers c
    ) WHERE place = 1""")
def ivf_assign(spark, folder):
    corpus = vectors(spark, folder)
    centers = A.centroids(corpus).select(F.col("label").alias("cluster"), F.col("vec").alias("center"))
    return R.ivf_assign(corpus, centers).select("doc_id", F.col("cluster").cast("bigint").alias("cluster"))


@query("knn_ivf_all_probes", f"WITH {S.knn('hits', 3)} {HIT} FROM hits")
def knn_ivf_all_probes(spark, folder):
    corpus = vectors(spark, folder)
    centers = A.centroids(corpus).select(F.col("label").alias("cluster"), F.col("vec").alias("center"))
    hits = R.knn_ivf(query_vectors(spark, folder), R.ivf_assign(corpus, centers), centers, 3, nprobe=10)
    return _hits(hits)


@query("multi_query_retrieve", f"""
    WITH {S.knn('near', 3)},
    hits AS (SELECT query_id // 3 AS query_id, query_id % 3 AS variant_no, doc_id, exp(-distance / 10) AS score FROM near),
    first AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY variant_no) AS place FROM hits QUALIFY place = 1),
    sizes AS (SELECT query_id, variant_no, count(*) AS n FROM first GROUP BY ALL),
    upto AS (
      SELECT query_id, variant_no,
             coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY variant_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known
      FROM sizes
    )
    SELECT query_id, doc_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::BIGINT AS rank
    FROM first JOIN upto USING (query_id, variant_no) WHERE known < 5 QUALIFY rank <= 5""")
def multi_query_retrieve_query(spark, folder):
    variants = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("query_id"), (F.col("vec_id") % 3).alias("variant_no"),
        F.col("embedding").alias("query_vec"),
    )
    best = multi_query_retrieve(variants, vectors(spark, folder), 5, 3)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("collection_stats", """
    SELECT CASE WHEN count(*) > 0 THEN 'loaded' ELSE 'empty' END AS status, count(*) AS doc_count,
           min(len(embedding))::BIGINT AS dim_min, max(len(embedding))::BIGINT AS dim_max FROM embeddings""")
def collection_stats(spark, folder):
    return D.collection_stats(table(spark, folder, "embeddings"))


# ---- vector expressions -----------------------------------------------------------

@query("l2_normalize", """
    SELECT vec_id AS doc_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, round(unnest(v), 6) AS x FROM (
      SELECT vec_id, list_transform(w, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS v FROM (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS w,
               sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * label * x * label))) AS n FROM embeddings))""")
def l2_normalize(spark, folder):
    scaled = vectors(spark, folder).withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    )
    return as_long(scaled.withColumn("v", V.l2_normalize(F.col("v"))), ["doc_id"], "v")


@query("vector_metrics", """
    WITH pairs AS (
      SELECT a.vec_id AS doc_id, a.embedding::DOUBLE[] AS v, list_transform(b.embedding::DOUBLE[], lambda x: x * 2) AS w
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    )
    SELECT doc_id, round(list_inner_product(v, w), 6) AS dot, round(list_cosine_similarity(v, w), 6) AS cosine,
           round(greatest(0, list_inner_product(v, w) / ((sqrt(list_inner_product(v, v)) + 1e-8) * (sqrt(list_inner_product(w, w)) + 1e-8))), 6) AS cosine01,
           round(list_distance(v, w) ** 2, 6) AS l2sq
    FROM pairs""")
def vector_metrics(spark, folder):
    v = vectors(spark, folder)
    other = v.select((F.col("doc_id") - 1).alias("doc_id"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("w"))
    a, b = F.col("embedding"), F.col("w")
    return v.join(other, "doc_id").select(
        "doc_id", *[F.round(f(a, b), 6).alias(f.__name__) for f in (V.dot, V.cosine, V.cosine01, V.l2sq)]
    )


@query("centroids", f"WITH {S.LABEL_CENTERS} SELECT label::BIGINT AS label, (pos - 1)::BIGINT AS pos, round(x, 6) AS x FROM means")
def centroids(spark, folder):
    means = A.centroids(vectors(spark, folder))
    return as_long(means.withColumn("label", F.col("label").cast("bigint")), ["label"], "vec")


@query("classify_nearest_centroid", f"""
    WITH {S.LABEL_CENTERS},
    best AS (
      SELECT e.vec_id AS query_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.vec) AS s,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], c.vec), 12) DESC, c.label) AS place
      FROM embeddings e, centers c
    )
    SELECT query_id, CASE WHEN s >= 0.3 THEN label::VARCHAR ELSE 'general' END AS intent, round(s, 6) AS similarity
    FROM best WHERE place = 1""")
def classify_nearest_centroid(spark, folder):
    found = A.classify_nearest_centroid(
        query_vectors(spark, folder), A.centroids(vectors(spark, folder)), 0.3, "general"
    )
    return found.withColumn("similarity", F.round("similarity", 6))


@query("mean_pool", """
    WITH tokens AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
                    FROM embeddings WHERE embedding[1] > 0)
    SELECT label::BIGINT AS doc_id, (pos - 1)::BIGINT AS pos, round(avg(x), 6) AS x FROM tokens GROUP BY label, pos""")
def mean_pool(spark, folder):
    tokens = vectors(spark, folder).select(
        F.col("label").cast("bigint").alias("doc_id"), F.when(F.col("embedding")[0] > 0, 1).otherwise(0).alias("mask"),
        F.col("embedding").alias("vec"),
    )
    return as_long(Z.mean_pool(tokens), ["doc_id"], "vec")


@query("cls_pool", """
    WITH firsts AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)
    SELECT label::BIGINT AS doc_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, round(unnest(v)::DOUBLE, 6) AS x FROM firsts""")
def cls_pool(spark, folder):
    tokens = vectors(spark, folder).select(
        F.col("label").cast("bigint").alias("doc_id"), F.col("doc_id").alias("pos"), F.col("embedding").alias("vec")
    )
    return as_long(Z.cls_pool(tokens), ["doc_id"], "vec")


WORDS = "SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS vec FROM embeddings"


def _words(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec")
    )


@query("word2vec_docs", f"""
    WITH words AS ({WORDS}),
    toks AS (SELECT vec_id AS doc_id, unnest(['w' || vec_id * 3, 'w' || vec_id * 5, 'w' || (vec_id + 1) * 7]) AS word FROM embeddings),
    parts AS (SELECT doc_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM toks JOIN words USING (word)),
    means AS (SELECT doc_id, pos, avg(x) AS x FROM parts GROUP BY ALL)
    SELECT e.vec_id AS doc_id, p.pos - 1 AS pos, round(coalesce(m.x, 0), 6) AS x
    FROM embeddings e CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p
    LEFT JOIN means m ON m.doc_id = e.vec_id AND m.pos = p.pos""")
def word2vec_docs(spark, folder):
    i = F.col("vec_id")
    toks = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.array(*[F.concat(F.lit("w"), n.cast("string")) for n in (i * 3, i * 5, (i + 1) * 7)]).alias("tokens"),
    )
    return as_long(Z.mean_word_vectors(toks, _words(spark, folder), 64), ["doc_id"], "vec")


@query("most_similar", f"""
    WITH words AS ({WORDS}),
    asked AS (SELECT 'w' || vec_id * 2 AS query FROM embeddings),
    pairs AS (
      SELECT q.word AS query, w.word, list_cosine_similarity(q.vec, w.vec) AS similarity
      FROM asked JOIN words q ON q.word = asked.query JOIN words w ON w.word <> q.word
    )
    SELECT query, word, round(similarity, 6) AS similarity,
           row_number() OVER (PARTITION BY query ORDER BY round(similarity, 12) DESC, word)::BIGINT AS rank
    FROM pairs QUALIFY rank <= 4""")
def most_similar(spark, folder):
    asked = table(spark, folder, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id") * 2).alias("word"))
    near = Z.most_similar(_words(spark, folder), asked, 4)
    return near.select("query", "word", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))
