"""Product-quantized candidates: how many are needed, and how much memory comparing them takes."""

import tracemalloc

import numpy as np

from lexiquarry.operators import approximate as X
from lexiquarry.operators.search import knn


def test_candidates_suffice_where_codes_are_coarse(spark):
    """Vectors in crowds, whose codes hardly tell neighbours apart: three times k candidates are not enough."""
    rng = np.random.default_rng(4)
    crowds = rng.normal(size=(30, 32))
    rows = [(i, (crowds[i % 30] + 0.05 * rng.normal(size=32)).tolist()) for i in range(3000)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(4).cache()
    asked = corpus.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "embedding AS query_vec")
    books = X.codebooks(corpus, codes=16)
    coded = X.encode(corpus, books).cache()
    exact = knn(asked, corpus, 3)
    assert X.recall_of(X.overfetch_coded(asked, coded, books, 3, 3), exact).head().recall < 0.9
    assert X.recall_of(X.overfetch_coded(asked, coded, books, 3), exact).head().recall >= 0.9


def test_lookup_tables_do_not_grow_with_the_queries():
    rng = np.random.default_rng(5)
    books, codes = rng.normal(size=(16, 256, 4)), rng.integers(0, 256, (500, 16)).astype(np.uint8)
    peaks = []
    for n in (500, 2000):
        queries = rng.normal(size=(n, 64))
        tracemalloc.start()
        qi, di, _ = X._best_codes(queries, codes, np.arange(500), books, 9)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(qi) == 9 * n
    assert peaks[1] < 1.5 * peaks[0]
