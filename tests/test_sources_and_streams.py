import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import metrics as M, vectorize as V
from lexiquarry.operators.search import knn, with_score
from lexiquarry.session import work_path
from lexiquarry.sources import collections as K, files as P
from lexiquarry.streaming import ingest as G, metrics as X


def encoder():
    return V.hashing_encoder(16)


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "good.txt").write_text("é汉 fine", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"ab\xff\xfecd\xe6\xb1")
    got = {r.source: r.content for r in P.read_text(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": "é汉 fine", "bad.txt": "abcd"}


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiters_types_and_quotes(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(sep.join(["id", "price", "note"]) + "\n" + sep.join(["1", "2.5", '"two\nlines ""q"""']) + "\n" + sep.join(["2", "3", ""]) + "\n")
    df = P.read_delimited(spark, str(path), multi_line=True)
    assert [f.dataType.typeName() for f in df.schema] == ["integer", "double", "string"]
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, 'two\nlines "q"'), (2, 3.0, None)]
    blocks = P.read_docs(spark, str(path), "table", "id", n=1, multi_line=True)
    assert blocks.count() == 2 and "content" in blocks.columns


def test_collection_round_trip_and_width_check(spark):
    path = work_path(spark, "test-collection")
    rows = spark.createDataFrame(
        [("a", 0, "x", [1.0, 2.0], {"k": "v"})], "source string, chunk int, content string, embedding array<float>, metadata map<string,string>"
    )
    K.write_collection(rows, path, 2)
    K.write_collection(rows.withColumn("chunk", F.lit(1)), path, 2)
    back = K.read_collection(spark, path)
    assert back.count() == 2 and back.select("id").distinct().count() == 2 and back.head().metadata == {"k": "v"}
    with pytest.raises(Exception, match="vector width"):
        K.write_collection(rows, path, 3)
    assert K.read_collection(spark, path).count() == 2


def test_saved_models(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b c d")], "doc_id int, content string")
    model = V.word2vec_fit(docs, vector_size=5, partitions=1)
    path = K.save_model(model, work_path(spark, "w2v"))
    again = {r.word: r.vec for r in V.word_table(K.load_word2vec(path)).collect()}
    first = {r.word: r.vec for r in V.word_table(model).collect()}
    assert again.keys() == {"a", "b", "c", "d"} and all(np.allclose(again[w], first[w]) for w in first)
    same_seed = {r.word: r.vec for r in V.word_table(V.word2vec_fit(docs, vector_size=5, partitions=1)).collect()}
    assert all(np.allclose(same_seed[w], first[w]) for w in first)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert work_path(spark, "x").startswith(base)

    class Other:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        work_path(Other(), "x")


# ---- streams --------------------------------------------------------------------------

def write_events(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    staged = work_path(spark, "events")
    df.coalesce(1).write.parquet(staged)
    [part] = [f for f in os.listdir(staged.replace("file:", "")) if f.endswith(".parquet")]
    os.rename(os.path.join(staged.replace("file:", ""), part), os.path.join(folder, name))
    return df.schema


def test_late_events_and_closed_windows(spark, tmp_path):
    folder = str(tmp_path)
    schema = write_events(spark, folder, [(1, "2024-01-01 00:01:00", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 2.0)], "1.parquet")
    write_events(spark, folder, [(3, "2024-01-01 01:00:00", "a", 3.0)], "2.parquet")
    write_events(spark, folder, [(6, "2024-01-01 01:01:00", "a", 3.0)], "3.parquet")
    write_events(spark, folder, [(4, "2024-01-01 00:02:00", "a", 9.0), (5, "2024-01-01 02:00:00", "a", 9.0)], "4.parquet")
    for i in (1, 2, 3, 4):
        os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = X.event_stream(spark, folder, schema, files_per_batch=1)
    done = X.run_to_parquet(X.stream_request_rate(events), work_path(spark, "out"), work_path(spark, "cp"))
    got = {(r.window_start.strftime("%H:%M"), r.requests) for r in done.collect()}
    # Event 4 comes after its window has closed; the window of event 5 is still open.
    assert got == {("00:00", 2), ("01:00", 2)}
    total = X.run_complete(X.stream_documents_added(events), work_path(spark, "out"), work_path(spark, "cp"))
    assert [(r.event_type, r.total) for r in total.collect()] == [("a", 6)]


def test_ingest_skips_copies_and_keeps_errors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, text in enumerate(["one two three " * 20, "other text", "other text", "boom", ""]):
        path = folder / f"{i}.txt"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))

    def fragile():
        good = V.hashing_encoder(16)

        def encode(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("no")
            return good(batch)

        return encode

    docs = G.drop_copies(G.text_file_stream(spark, str(folder), files_per_batch=2), "arrived", "1 hour")
    path = work_path(spark, "test-ingest")
    stored = G.ingest(docs, path, work_path(spark, "cp"), fragile, 16, size=100, overlap=10)
    rows = stored.collect()
    assert sum(r.content == "other text" for r in rows) == 1 and len(rows) == 5
    assert [r.content for r in spark.read.parquet(path + "_rejects").collect()] == ["boom"]


def test_stream_of_questions_equals_batch(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "doc_id int, embedding array<double>")
    questions = spark.createDataFrame([(i, [i + 0.4, 1.0]) for i in range(6)], "query_id int, query_vec array<double>")
    folder = work_path(spark, "questions")
    questions.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    done = G.answer_questions(stream, corpus, work_path(spark, "answers"), work_path(spark, "cp"), k=2)
    batch = with_score(knn(questions, corpus, 2))
    assert sorted(map(tuple, done.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (50.0,), (None,)], "value double")
    hist = {r.le: r.cumulative for r in M.latency_histogram(df).collect()}
    assert hist[0.1] == 1 and hist[0.5] == 2 and hist[10.0] == 2 and hist[float("inf")] == 3
    assert M.histogram_quantile(M.bucket_sums(df, "value"), 0.99).head().quantile == 10.0
    assert M.histogram_quantile(M.bucket_sums(df, "value"), 1 / 3).head().quantile == pytest.approx(0.1)
    with pytest.raises(ValueError):
        M.histogram_quantile(M.bucket_sums(df, "value"), 0.5, (1.0, 2.0))
