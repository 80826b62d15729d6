import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import search as R

RNG = np.random.default_rng(3)
DATA = np.round(RNG.normal(size=(400, 8)), 2)
DATA[100:250] = DATA[100]  # more than a third of the rows are copies
DATA[7] = 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(DATA)], "doc_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def queries(spark):
    ids = [0, 7, 100, 101, 399]
    return spark.createDataFrame([(i, [float(x) for x in DATA[i]]) for i in ids], "query_id long, query_vec array<double>").cache()


def brute(ids, k, metric):
    out = set()
    for q in ids:
        if metric == "l2sq":
            order = sorted((float(np.square(DATA[q] - v).sum()), i) for i, v in enumerate(DATA))
        else:
            norms = np.linalg.norm(DATA[q]), np.linalg.norm(DATA, axis=1)
            cos = [float(DATA[q] @ v / (norms[0] * n)) if norms[0] * n > 0 else 0.0 for v, n in zip(DATA, norms[1])]
            order = sorted((-round(c, 12), i) for i, c in enumerate(cos))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("way", ["few_queries", "small_corpus", "blocked"])
@pytest.mark.parametrize("k", [1, 5, 600])
def test_all_ways_equal_brute_force(corpus, queries, way, k):
    hits = R.knn(queries, corpus, k, way=way, block_rows=64)
    got = {(r.query_id, r.doc_id, r.rank) for r in hits.collect()}
    assert got == brute([0, 7, 100, 101, 399], k, "l2sq")


@pytest.mark.parametrize("way", ["few_queries", "small_corpus", "blocked"])
def test_cosine(corpus, queries, way):
    asked = queries.where("query_id in (0, 7, 399)")
    hits = R.knn(asked, corpus, 4, "cosine", way=way, block_rows=50)
    assert {(r.query_id, r.doc_id, r.rank) for r in hits.collect()} == brute([0, 7, 399], 4, "cosine")


def test_text_ids_and_null_vectors(spark, queries):
    corpus = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [5.0, 5.0])], "doc_id string, embedding array<double>"
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, query_vec array<double>")
    for way in ("few_queries", "small_corpus", "blocked"):
        rows = R.knn(asked, corpus, 2, way=way).orderBy("rank").collect()
        assert [(r.query_id, r.doc_id, r.distance) for r in rows] == [(1, "a", 0.0), (1, "b", 0.0)]


def test_empty_sides(spark, corpus, queries):
    for way in ("few_queries", "small_corpus", "blocked"):
        assert R.knn(queries, corpus.limit(0), 3, way=way).count() == 0
        assert R.knn(queries.limit(0), corpus, 3, way=way).count() == 0


def test_ragged_vectors_are_refused(spark, queries):
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id int, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        R.knn(queries, ragged, 1, way="few_queries").collect()


def test_within(corpus, queries):
    pairs = {(r.query_id, r.doc_id) for r in R.within(queries, corpus, 0.8).collect()}
    blocked = {(r.query_id, r.doc_id) for r in R.within(queries, corpus, 0.8, way="blocked", block_rows=37).collect()}
    norms = np.linalg.norm(DATA, axis=1)
    want = {
        (q, i) for q in (0, 7, 100, 101, 399) for i in range(len(DATA))
        if norms[q] * norms[i] > 0 and DATA[q] @ DATA[i] / (norms[q] * norms[i]) >= 0.8
    }
    assert pairs == blocked == want


def test_many_ties_are_decided_in_slices(monkeypatch, corpus):
    monkeypatch.setattr(R, "_PAIR_SLICE", 7)
    q, x = DATA[[100, 0]], DATA
    qi, xi, value = R._nearest_pairs(q, x, np.arange(len(x)), 5, "l2sq")
    assert list(xi[qi == 0]) == [100, 101, 102, 103, 104] and (value[qi == 0] == 0).all()


def test_thresholds(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.9), (1, 2, 0.2), (2, 3, 0.1), (2, 4, 0.2), (3, 5, None)], "query_id int, doc_id int, score double"
    )
    assert {r.doc_id for r in R.threshold_filter(hits, 0.5).collect()} == {1, 5}
    kept = R.threshold_filter(hits, 0.5, keep_best=True).collect()
    assert {r.doc_id for r in kept} == {1, 4, 5}
    assert {r.doc_id for r in R.threshold_filter(hits, 0.0, keep_best=True, k=1).collect()} == {1, 4, 5}


def test_clusters(spark, corpus, queries):
    centers = R.ivf_fit(corpus, 12)
    assigned = R.ivf_assign(corpus, centers)
    exact = {(r.query_id, r.doc_id) for r in R.knn(queries, corpus, 5).collect()}
    recall = []
    for nprobe in (1, 4, 12):
        found = {(r.query_id, r.doc_id) for r in R.knn_ivf(queries, assigned, centers, 5, nprobe, block_rows=40).collect()}
        recall.append(len(found & exact) / len(exact))
    assert recall == sorted(recall) and recall[-1] == 1.0


def test_overfetch_equals_exact(corpus, queries):
    a = {(r.query_id, r.doc_id, r.rank) for r in R.knn(queries, corpus, 3).collect()}
    b = {(r.query_id, r.doc_id, r.rank) for r in R.overfetch(queries, corpus, 3, 4, R.knn).collect()}
    assert a == b


def test_plan_cuts_before_the_shuffle(corpus, queries, capsys):
    R.knn(queries, corpus, 3).explain()
    plan = capsys.readouterr().out
    assert "Partial" in plan and "WindowGroupLimit" in plan and plan.count("Exchange") == 1
    R.nearest(queries, corpus).explain()
    assert "Exchange" not in capsys.readouterr().out
