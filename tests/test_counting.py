"""Words are counted in the tasks that read the texts; counts equal those of plain Python."""

import random
from collections import Counter

import pytest

from lexiquarry.operators import common, counting as C, retrieval as R, vectorize as V

STOP = ("the", "of")


def _texts(seed=5):
    rng = random.Random(seed)
    common, rare = ["the", "of", "red", "blue", "green"], [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return [*texts, None, "", "the of the"]


def _grams(text, low, high):
    words = [w for w in (text or "").split() if w not in STOP]
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("low, high, most", [(1, 2, 7), (1, 3, 20), (1, 2, 5000), (2, 3, 15), (1, 1, 9)])
def test_vocabulary(spark, monkeypatch, low, high, most):
    monkeypatch.setattr(C, "TOGETHER", 100)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    cf, df = Counter(), Counter()
    for t in texts:
        cf.update(_grams(t, low, high))
        df.update(set(_grams(t, low, high)))
    want = sorted(cf, key=lambda t: (-cf[t], t))[:most]
    got = V.tfidf_fit(docs, most, stop_words=STOP, ngram_range=(low, high)).orderBy("idx").collect()
    assert [(r.term, r.cf, r.df) for r in got] == [(t, cf[t], df[t]) for t in sorted(want)]


def test_runs_of_rare_words_are_not_shuffled(spark, monkeypatch):
    """Only runs of words that are frequent enough are counted."""
    seen, count = [], V.gram_counts

    def watched(*args):
        seen.append(count(*args))
        return seen[-1]

    monkeypatch.setattr(V, "gram_counts", watched)
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, content string")
    V.tfidf_fit(docs, 3, stop_words=STOP).collect()
    assert {w for r in seen[-1].collect() for w in r.term.split()} == {"red", "blue", "green"}


def test_terms_are_found_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 100)
    texts = _texts(6)
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, content string")
    terms = ["red blue green", "red", "blue red", "blue", "w1", "no such", "green green"]
    want = Counter()
    for i, t in enumerate(texts):
        want.update((i // 2, terms.index(g)) for g in _grams(t, 1, 3) if g in terms)
    got = Counter()
    for r in C.term_counts(C.word_lists(docs, "doc_id", "content"), terms, "doc_id", STOP).collect():
        got[r.doc_id, r.nth] += r.tf
    assert got == want


def test_partitions_follow_the_texts(spark, monkeypatch, tmp_path):
    """What a task of bm25 sums does not grow with the table, and hits stay the same."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())] * 2, "doc_id long, content string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([(1, "red w7 the"), (2, "blue unknown")], "query_id long, query string")
    monkeypatch.setattr(common, "PARTITION_BYTES", 1 << 30)
    few = R.bm25(asked, docs, 5).collect()
    assert len(few) == 10
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(common, "PARTITION_BYTES", size // 30)
    asked_for, repartition = [], type(docs).repartition

    def watched(self, n, *cols):
        asked_for.append(n)
        return repartition(self, n, *cols)

    monkeypatch.setattr(type(docs), "repartition", watched)
    assert sorted(R.bm25(asked, docs, 5).collect()) == sorted(few)
    assert max(n for n in asked_for if isinstance(n, int)) >= 30


def test_encoder_equals_one_that_adds_word_by_word():
    import zlib

    import numpy as np

    texts = ["Red blue, RED blue", "", "ÉTÉ straße été", "one", " \n"]
    want = np.zeros((len(texts), 16), np.float32)
    for row, words in zip(want, (["red", "blue", "red", "blue"], [], ["été", "straße", "été"], ["one"], [])):
        for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
            code = zlib.crc32(gram.encode())
            row[code % 16] += -1 if code >> 31 else 1
        row /= np.linalg.norm(row) or 1
    assert np.array_equal(V.hashing_encoder(16)(texts), want) and V.hashing_encoder(16)([]).shape == (0, 16)
