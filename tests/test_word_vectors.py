"""Word vectors trained in shards: words, means, similar words, and what reaches the driver."""

import numpy as np
import pytest
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from lexiquarry.operators import vectorize as V


def table(model):
    return {r.word: r.vec for r in V.word_table(model).collect()}


def test_training_is_distributed(spark, monkeypatch):
    """No model is made that holds the vocabulary on the driver; words of several shards and batches come out once."""
    monkeypatch.setattr(V, "SHARD_TOKENS", 50)
    rows = [(i, f"a b c x{i} y{i} " + "a b " * (40 if i == 3 else 1)) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id int, content string")
    model = V.word2vec_fit(docs, vector_size=4, partitions=3)
    assert not isinstance(model, Word2VecModel)
    words = [r.word for r in V.word_table(model).collect()]
    assert sorted(words) == sorted(["a", "b", "c", *(f"{x}{i}" for i in range(60) for x in "xy")])
    assert all(len(v) == 4 and np.isfinite(v).all() for v in table(model).values())


def test_rare_words_have_no_vector(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b c d")], "doc_id int, content string")
    assert set(table(V.word2vec_fit(docs, vector_size=3, min_count=2))) == {"a", "b", "c"}


@pytest.mark.parametrize("partitions", [1, 4])
def test_words_of_like_contexts_are_alike(spark, partitions):
    rng = np.random.default_rng(1)
    groups = [[f"{g}{i}" for i in range(8)] for g in "pqrs"]
    rows = [(i, " ".join(rng.choice(groups[i % 4], 40))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id int, content string")
    vec = table(V.word2vec_fit(docs, vector_size=16, partitions=partitions, max_iter=5))
    unit = {w: np.array(v) / np.linalg.norm(v) for w, v in vec.items()}
    for w, v in unit.items():
        near = sorted((o for o in unit if o != w), key=lambda o: -v @ unit[o])[:5]
        assert all(o[0] == w[0] for o in near), (w, near)
