import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import answers as A, fields as L, retrieval as R, vectorize as V
from lexiquarry.params import FIELD_ALIASES, GENERAL_INTENT
from lexiquarry.plans import flows

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    # One word is in nearly every text.
    return {i: " ".join(rng.choices(WORDS, k=rng.randrange(1, 40)) + ["the"] * (i % 10 != 0)) for i in range(120)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, content string")


def test_bm25_equals_brute_force(spark, texts, docs):
    questions = {1: "w1 w2 the", 2: "w3 w3 w29", 3: "unknown words"}
    asked = spark.createDataFrame(list(questions.items()), "query_id long, query string")
    tokens = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for ts in tokens.values() for w in set(ts))
    want = {}
    for q, text in questions.items():
        scores = []
        for i, ts in tokens.items():
            score = 0.0
            for w in set(text.split()):
                tf = ts.count(w)
                if tf:
                    idf = math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5))
                    score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            if score:
                scores.append((-round(score, 9), i))
        want |= {(q, i): r + 1 for r, (_, i) in enumerate(sorted(scores)[:7])}
    got = {(r.query_id, r.doc_id): r["rank"] for r in R.bm25(asked, docs, 7).collect()}
    assert got == want


def test_rank_fusion(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    right = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1)], "query_id int, doc_id int, rank int")
    rows = R.hybrid_fuse(left, right, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rows] == [(1, 11, 1), (1, 10, 2), (2, 10, 1)]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_variants_stop_when_enough_is_known(spark):
    hits = spark.createDataFrame(
        [(1, 0, "a", 0.1), (1, 0, "b", 0.2), (1, 1, "b", 0.9), (1, 1, "c", 0.8), (1, 2, "d", 1.0), (2, 0, "z", 0.3)],
        "query_id int, variant_no int, doc_id string, score double",
    )
    rows = R.merge_variant_hits(hits, 3).orderBy("query_id", "rank").collect()
    # b keeps the score of the first variant that found it; variant 2 is not asked any more.
    assert [(r.query_id, r.doc_id, r.score) for r in rows] == [(1, "c", 0.8), (1, "b", 0.2), (1, "a", 0.1), (2, "z", 0.3)]
    assert [r.doc_id for r in R.merge_variant_hits(hits, 2).where("query_id = 1").orderBy("rank").collect()] == ["b", "a"]


@pytest.mark.parametrize("reply,lines", [
    ("<think>plan\nmore</think>\n1. first\n2) second\n\n  third ", ["first", "second", "third"]),
    ("1.no blank\n3.  three", ["1.no blank", "three"]),
    ("<think>never closed\nline", ["line"]),
    ("<think>a</think>x<think>b</think>y", ["original"]),
    ("   \n", ["original"]),
    ("only one", ["only one"]),
])
def test_rewrites(spark, reply, lines):
    df = spark.createDataFrame([(1, "original", reply)], "query_id int, query string, reply string")
    rows = R.parse_rewrites(df).orderBy("variant_no").collect()
    assert [r.variant for r in rows] == lines and [r.variant_no for r in rows] == list(range(len(lines)))


def test_identity_and_copies(spark):
    df = spark.createDataFrame(
        [(1, "s", 0, "x"), (None, "s", 2, "x"), (None, None, None, "x")], "doc_id int, source string, chunk int, content string"
    )
    assert [r.identity for r in R.with_identity(df).collect()] == ["1", "s#2", "9dd4e461268c8034f5c8564e155c67a6"]
    copies = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "doc_id int, content string")
    assert {r.doc_id for r in R.dedup_content(copies).collect()} == {1} | set(range(0, 30, 3))


def test_fields(spark):
    aliases = spark.createDataFrame(
        [(a, n, i) for i, (n, _, alts) in enumerate(FIELD_ALIASES) for a in alts] + [("name", "later", 99)],
        "alias string, standard string, ord int",
    )
    names = spark.createDataFrame([(" 商品ID ",), ("NAME",), ("Price",), ("Other",)], "field string")
    got = {r.field: r.standard_field for r in L.resolve_field(names, aliases).collect()}
    assert got == {" 商品ID ": "product_id", "NAME": "product_name", "Price": "price", "Other": "other"}


def test_learning_types(spark):
    df = spark.createDataFrame(
        [(0, "x", "1", "2024-01-01"), (1, "2", "", "yes"), (2, "3", "2", "no"), (3, "z", "3", "2024-01-02")],
        "id int, tie string, num string, day string",
    )
    got = {r.field: r for r in L.learn_fields(df, ["tie", "num", "day"], "id", None, {"day": "CATEGORY"}).collect()}
    assert got["tie"].type == "TEXT"  # two each; the text came first
    assert (got["num"].type, got["num"].min_value, got["num"].max_value, got["num"].avg_value) == ("NUMERIC", 1.0, 3.0, 2.0)
    assert got["day"].type == "CATEGORY" and got["day"].samples == 4 and got["tie"].min_value is None
    first = {r.field: r.type for r in L.learn_fields(df, ["num"], "id", 1).collect()}
    assert first == {"num": "NUMERIC"}


def test_tfidf_equals_brute_force(spark, texts, docs):
    stop = ("the",)
    vocab = V.tfidf_fit(docs, 40, stop_words=stop).cache()
    grams = {}
    for i, t in texts.items():
        words = [w for w in t.split() if w not in stop]
        grams[i] = words + [" ".join(p) for p in zip(words, words[1:])]
    cf = Counter(g for gs in grams.values() for g in gs)
    df = Counter(g for gs in grams.values() for g in set(gs))
    top = sorted(sorted(cf, key=lambda g: (-cf[g], g))[:40])
    rows = vocab.orderBy("idx").collect()
    assert [(r.idx, r.term, r.cf, r.df) for r in rows] == [(i, g, cf[g], df[g]) for i, g in enumerate(top)]
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in top}
    got = {(r.doc_id, r.term): r.weight for r in V.tfidf_transform(docs, vocab, stop).collect()}
    want = {}
    for i, gs in grams.items():
        w = {g: n * idf[g] for g, n in Counter(gs).items() if g in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, g): x / length for g, x in w.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.idf for r in V.tfidf_fit(docs, 5, use_idf=False).collect()} == {1.0}


def test_mean_of_known_words(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, ["a", "b", "b", "zz"]), (2, ["zz"]), (3, [])], "doc_id int, tokens array<string>")
    got = {r.doc_id: r.vec for r in V.mean_word_vectors(docs, words, 2).collect()}
    assert got[1] == pytest.approx([1 / 3, 4 / 3]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_similar_words(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    asked = spark.createDataFrame([("a",), ("nope",)], "word string")
    rows = V.most_similar(words, asked, 2).orderBy("rank").collect()
    assert [(r.query, r.word) for r in rows] == [("a", "b"), ("a", "c")]


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, "hello world"), (4, "boom")], "doc_id int, content string")
    rows = {r.doc_id: r for r in V.embed(docs, lambda: V.hashing_encoder(32), dim=32).collect()}
    assert rows[1].embedding == rows[3].embedding and np.linalg.norm(rows[1].embedding) == pytest.approx(1, abs=1e-5)
    assert set(rows[2].embedding) == {0.0} and rows[1].embed_error is None

    def fragile():
        good = V.hashing_encoder(8)

        def encode(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("cannot encode")
            return good(batch)

        return encode

    failed = {r.doc_id: r for r in V.embed(docs, fragile, dim=8).collect()}
    assert failed[4].embedding is None and "cannot encode" in failed[4].embed_error
    assert failed[1].embedding is not None and failed[2].embed_error is None
    zeros = {r.doc_id: r.embedding for r in V.embed(docs, fragile, dim=8, on_error="zero").collect()}
    assert zeros[4] == [0.0] * 8


def test_texts_are_encoded_once(spark, capsys):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, content string")
    V.embed(docs, lambda: V.hashing_encoder(8), dim=8).where("embedding is not null").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_registry(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id int, content string")
    assert {len(r.embedding) for r in V.vectorize(docs, "tfidf", max_features=5).collect()} == {5}
    assert {len(r.embedding) for r in V.vectorize(docs, "word2vec", vector_size=6).collect()} == {6}
    V.register_vectorizer("ones", lambda df, n: df.withColumn("embedding", F.array_repeat(F.lit(1.0), n)), n=3)
    assert V.vectorize(docs, "ones").head().embedding == [1.0] * 3
    with pytest.raises(ValueError):
        V.vectorize(docs, "unknown")


def test_lists(spark):
    texts = [
        "产品名称: One\n价格: 5\n处理器：i7\n特点: 高性能: 游戏\n",
        "产品名称：Two\n显卡: NVIDIA RTX 4060",
        "产品名称: Three\n显卡: none\n特点: 办公",
        "特点: Gaming",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    rows = A.filter_list(docs).orderBy("item_no").collect()
    assert [r.doc_id for r in rows] == [0, 1, 3]
    assert rows[0].item == "1. One\n   价格：5\n   配置：\n   - 处理器：i7\n   特点：高性能: 游戏"
    assert rows[1].item == "2. Two\n   价格：未知\n   配置：\n   - 显卡：NVIDIA RTX 4060"
    assert rows[2].item.startswith("3. 未知型号")


def test_extremes(spark):
    docs = spark.createDataFrame([(i, f"name: p{i} | 价格: {p}") for i, p in enumerate(["5", "12元", "7", "7", "x"])], "doc_id int, content string")
    asked = spark.createDataFrame([(1, "最贵的是"), (2, "最便宜的"), (3, "随便")], "query_id int, query string")
    from lexiquarry.functions.text import alias_map

    hits, context = A.extremum_topk(asked, docs, k=2, aliases=alias_map(FIELD_ALIASES))
    assert {(r.query_id, r.doc_id, r["rank"]) for r in hits.collect()} == {(1, 2, 1), (1, 3, 2), (2, 0, 1), (2, 2, 2)}
    assert {r.query_id: r.context for r in context.collect()}[2] == "name: p0 | 价格: 5\nname: p2 | 价格: 7"
    hits, _ = A.extremum_topk(asked, docs, k=1, unit_suffix=True, aliases=alias_map(FIELD_ALIASES))
    assert {(r.query_id, r.doc_id) for r in hits.collect()} == {(1, 1), (2, 0)}


def test_long_conversation_comes_in_segments(spark):
    turns = spark.range(1000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("m"), "id").alias("text"),
    ).unionByName(spark.createDataFrame([(2, 4, "user", "hi")], "conv_id int, turn long, role string, text string"))
    parts = A.chat_prompt(A.chat_messages(turns, "sys"), 100).orderBy("segment").collect()
    whole = "".join(p.prompt for p in parts if p.conv_id == 1)
    want = "System: sys\n\n" + "".join(f"{'Assistant' if i % 2 else 'User'}: m{i}\n\n" for i in range(1000)) + "Assistant: "
    assert whole == want
    assert [p.prompt for p in parts if p.conv_id == 2] == ["System: sys\n\nUser: hi\n\nAssistant: "]


def test_ask_flow(spark, docs):
    collection = V.embed(docs, lambda: V.hashing_encoder(64), dim=64).withColumn("metadata", F.create_map(F.lit("source"), F.lit("s")))
    asked = spark.createDataFrame([(1, "w1 w2 推荐"), (2, "你")], "query_id int, query string")
    out = {r.query_id: r for r in flows.ask(asked, collection, lambda: V.hashing_encoder(64), dim=64).collect()}
    assert out[1].route == "list" and out[1].n_hits >= 1 and out[1].prompt.count("文档 ") >= 1 and GENERAL_INTENT in out[1].prompt
    empty = flows.ask(asked, collection.limit(0), lambda: V.hashing_encoder(64), dim=64).orderBy("query_id").collect()
    assert [r.n_hits for r in empty] == [0, 0] and empty[0].answer == "抱歉，没有找到相关信息。" and empty[1].answer.startswith("抱歉，我不太理解")
    assert empty[0].prompt is None


def test_pooling(spark):
    tokens = spark.createDataFrame(
        [(1, 0, 1, [1.0, 0.0]), (1, 1, 1, [3.0, 2.0]), (1, 2, 0, [9.0, 9.0])], "doc_id int, pos int, mask int, vec array<double>"
    )
    assert V.mean_pool(tokens).head().vec == [2.0, 1.0] and V.cls_pool(tokens).head().vec == [1.0, 0.0]


def test_keyword_ranking_is_the_same_either_way(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(300)], "doc_id long, content string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words + ["zz"], k=4))) for i in range(20)], "query_id long, query string").repartition(3)
    few = sorted(map(tuple, R.bm25(asked, docs, 5).collect()))
    monkeypatch.setattr(R, "PAIRS_AT_ONCE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        assert sorted(map(tuple, R.bm25(asked, docs, 5).collect())) == few
        leaving = R.bm25(asked, docs, 5)._jdf.queryExecution().toString()
        assert "MapInArrow" in leaving
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, R.bm25(asked, docs, 5).collect())) == few


def test_newest_version_wins(spark):
    from lexiquarry.operators.documents import upsert_collection

    old = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 5), (4, "k", 1)], "key int, value string, version int")
    new = spark.createDataFrame([(2, "y2", 1), (3, "z2", None), (5, "n", None)], "key int, value string, version int")
    got = {r.key: r.value for r in upsert_collection(old, new, "key", "version").collect()}
    assert got == {1: "x", 2: "y2", 3: "z", 4: "k", 5: "n"}


def test_documents_are_encoded_once_and_none_is_lost(spark, tmp_path):
    from lexiquarry.plans.flows import add_documents

    calls = str(tmp_path / "calls")

    def make():
        def encode(texts):
            import os

            number = os.path.getsize(calls) if os.path.exists(calls) else 0
            with open(calls, "ab") as out:
                out.write(b"x" * len(texts))
            if number % 2:
                raise ValueError("every other call fails")
            return [[1.0] * 4 for _ in texts]
        return encode

    docs = spark.createDataFrame([(i, f"s{i}", f"text {i}") for i in range(9)], "doc_id long, source string, content string").repartition(1)
    add_documents(docs, str(tmp_path / "stored"), make, 4)
    stored = spark.read.parquet(str(tmp_path / "stored")).count()
    rejected = spark.read.parquet(str(tmp_path / "stored_rejects")).count()
    assert stored + rejected == 9
