"""Pairs proposed by products in single precision, and candidates compared again in the blocks where they are found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import approximate as X, search as S


def rows_of(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 12))
    if kind == "far from zero":
        x += 1000
    elif kind == "one very long":
        x[7] *= 1e12
    elif kind == "tiny":
        x *= 1e-25
    elif kind == "huge":
        x *= 1e25
    elif kind == "copies":
        x = np.repeat(x[:40], 75, axis=0)
    elif kind == "grid":
        x = rng.integers(0, 3, (20_000, 5)).astype(float)
    elif kind == "half zero":
        x[::2] = 0
    return x, rng.permutation(len(x))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("kind", ["normal", "far from zero", "one very long", "tiny", "huge", "copies", "grid", "half zero"])
def test_single_precision_loses_nothing(monkeypatch, kind, metric):
    x, order = rows_of(kind)
    found = [S._nearest_pairs(x[:150], x, order, k, metric) for k in (1, 3, 40)]
    monkeypatch.setattr(S, "_singles", lambda *_: None)
    double = [S._nearest_pairs(x[:150], x, order, k, metric) for k in (1, 3, 40)]
    for a, b in zip(found, double):
        assert all(np.array_equal(m, n) for m, n in zip(a, b))


@pytest.mark.parametrize("different", [3000, 20])
def test_codes_proposed_are_those_of_all_sums(monkeypatch, different):
    rng = np.random.default_rng(7)
    books, codes = rng.normal(size=(5, 256, 4)), rng.integers(0, 256, (different, 5)).astype(np.uint8)
    codes, queries = codes[rng.integers(0, different, 3000)], rng.normal(size=(150, 18))
    order = rng.permutation(3000)
    found = [X._best_codes(queries, codes, order, books, k) for k in (1, 9, 60)]
    monkeypatch.setattr(X, "_singles", lambda *_: None)
    for a, k in zip(found, (1, 9, 60)):
        assert all(np.array_equal(m, n) for m, n in zip(a, X._best_codes(queries, codes, order, books, k)))


def test_not_all_pairs_are_compared_in_double_precision(monkeypatch):
    def all_pairs(*_):
        raise AssertionError("all pairs in double precision")

    monkeypatch.setattr(S, "_bound", all_pairs)
    monkeypatch.setattr(X, "_code_sums", all_pairs)
    x, order = rows_of("normal")
    assert len(S._nearest_pairs(x[:150], x, order, 3, "l2sq")[0]) == 450
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, (3000, 3)).astype(np.uint8)
    assert len(X._best_codes(x[:150], codes, order, rng.normal(size=(3, 256, 4)), 9)[0]) == 1350


def test_candidates_of_many_queries_are_no_rows(spark, monkeypatch):
    x, _ = rows_of("normal")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "doc_id long, embedding array<double>").repartition(4).cache()
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    books = X.codebooks(corpus, codes=32)
    coded = X.encode(corpus, books).cache()
    rows = lambda df: {(r.query_id, r["rank"]): (r.doc_id, round(r.distance, 9)) for r in df.collect()}
    near = X.code_candidates(asked, coded, books, 12).select("query_id", "doc_id").collect()
    by_hand = {}
    for r in near:
        by_hand.setdefault(r.query_id, []).append((round(float(np.square(x[r.query_id] - x[r.doc_id]).sum()), 9), r.doc_id))
    by_hand = {(q, i + 1): (d, v) for q, some in by_hand.items() for i, (v, d) in enumerate(sorted(some)[:3])}
    few = rows(X.overfetch_coded(asked.where("query_id % 100 = 0"), coded, books, 3, 4))
    assert few == {key: hit for key, hit in by_hand.items() if key[0] % 100 == 0}

    def paired(*_, **__):
        raise AssertionError("a row for every candidate")

    monkeypatch.setattr(X, "code_candidates", paired)
    one = rows(X.overfetch_coded(asked, coded, books, 3, 4))
    assert one == by_hand
    # Blocks of 1,024 rows: every block has its own candidates, so hits are as near or nearer.
    many = rows(X.overfetch_coded(asked, coded, books, 3, 4, block_values=1))
    assert many.keys() == one.keys() and all(many[key][1] <= one[key][1] for key in one)
