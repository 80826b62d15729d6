"""Two-level clusters and product-quantized codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import approximate as X, search as R


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centres, a third of them copies of one vector, and one null."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (40, 10))
    rows = [centres[rng.integers(40)] + rng.normal(0, 1, 10) for _ in range(800)] + [centres[0]] * 400
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(-1, None)]
    return spark.createDataFrame(data, "doc_id long, embedding array<double>").repartition(5).cache()


@pytest.fixture(scope="module")
def asked(clustered):
    return clustered.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def test_kmeans_finds_separate_groups():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (50, 3)) for c in (0, 10, 20)])
    found = np.sort(X.kmeans(points, 3, 4).mean(axis=1))
    assert np.allclose(found, [0, 10, 20], atol=0.2)
    assert len(X.kmeans(np.ones((9, 2)), 5, 1)) == 1


def test_two_levels(clustered, asked):
    centres = X.coarse_fit(clustered, 36, sample=30)
    rows = centres.collect()
    tops = {r.branch: np.array(r.center) for r in rows if r.cluster is None}
    inner = {r.cluster: (r.branch, np.array(r.center)) for r in rows if r.cluster is not None}
    assert 2 <= len(tops) <= 6 and {b for b, _ in inner.values()} == tops.keys() and 15 <= len(inner) <= 60
    assigned = X.coarse_assign(clustered, centres).cache()
    got = assigned.collect()
    assert len(got) == 1200
    for r in got:
        v = np.array(r.embedding)
        assert r.branch == min(tops, key=lambda b: (round(((tops[b] - v) ** 2).sum(), 9), b))
        own = {c: m for c, (b, m) in inner.items() if b == r.branch}
        best = min(((m - v) ** 2).sum() for m in own.values())
        assert ((own[r.cluster] - v) ** 2).sum() <= best + 1e-9
    # All clusters probed: the exact result. Tuned probes: most of it, from fewer clusters.
    exact = R.knn(asked, clustered, 5)
    every = X.knn_coarse(asked, assigned, centres, 5, len(tops), len(inner))
    key = lambda df: {(r.query_id, r.doc_id, r["rank"], round(r.distance, 9)) for r in df.collect()}
    assert key(every) == key(exact)
    branches, nprobe = X.tune_probes(assigned, centres, 5, 0.9)
    assert branches <= len(tops) and nprobe < len(inner)
    some = X.knn_coarse(asked, assigned, centres, 5, recall=0.9)
    assert X.recall_of(some, exact).head().recall >= 0.9
    again = X.coarse_fit(clustered.repartition(3), 36, sample=30)
    assert sorted((r.branch, r.cluster or -1, [round(x, 9) for x in r.center]) for r in again.collect()) == sorted(
        (r.branch, r.cluster or -1, [round(x, 9) for x in r.center]) for r in rows
    )


def test_codes(clustered, asked):
    books = X.codebooks(clustered, dimensions=4, codes=64)
    assert books.shape == (3, 64, 4)
    coded = X.encode(clustered, books).cache()
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[-1].code is None and all(len(r.code) == 3 for i, r in rows.items() if i >= 0)
    for r in list(rows.values())[:40]:
        if r.embedding:
            v = np.pad(np.array(r.embedding), (0, 2)).reshape(3, 4)
            for part in range(3):
                cost = np.square(books[part] - v[part]).sum(axis=1)
                assert cost[r.code[part]] <= cost.min() + 1e-9
    few = X.code_candidates(asked, coded, books, 4, block_rows=16)
    one = X.code_candidates(asked, coded, books, 4)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))
    approx = {(r.query_id, r["rank"]): r.distance for r in one.collect()}
    for r in asked.limit(20).collect():
        v = np.pad(np.array(r.query_vec), (0, 2)).reshape(3, 4)
        sums = sorted(sum(np.square(books[p][x.code[p]] - v[p]).sum() for p in range(3)) for x in rows.values() if x.code is not None)
        assert np.allclose([approx[r.query_id, i + 1] for i in range(4)], sums[:4])
    exact = R.knn(asked, clustered, 5)
    found = X.overfetch_coded(asked, coded, books, 5, 6)
    assert X.recall_of(found.where("distance > 0"), exact.where("distance > 0")).head().recall >= 0.9
    true = {(r.query_id, r.doc_id): r.distance for r in R.knn(asked, clustered, 1300).collect()}
    assert all(abs(true[r.query_id, r.doc_id] - r.distance) < 1e-9 for r in found.collect())


def test_empty_and_narrow(spark, clustered):
    none = clustered.limit(0)
    centres = X.coarse_fit(none)
    assert centres.count() == 0 and X.coarse_assign(none, centres).count() == 0
    with pytest.raises(ValueError, match="width"):
        X._padded(np.zeros((2, 3)), np.zeros((2, 4, 4)))


def test_assignment_to_very_many_centres(clustered):
    centres = X.coarse_fit(clustered, 20).where("cluster IS NOT NULL").select(F.row_number().over(R.Window.orderBy("cluster")).alias("cluster"), "center")
    few = {r.doc_id: r.cluster for r in R.ivf_assign(clustered, centres).collect()}
    many = {r.doc_id: r.cluster for r in R.ivf_assign(clustered, centres, small_rows=0).collect()}
    assert few == many and few[-1] is None
