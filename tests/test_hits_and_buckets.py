"""Answers from a question's own documents, chat history as of a turn, and collections stored in buckets."""

import glob
import os

from pyspark.sql import functions as F

from lexiquarry.operators import hits as H
from lexiquarry.session import work_path
from lexiquarry.sources import buckets as B

FOUND = "query_id long, doc_id long, rank int, content string, category string"


def test_extremes_of_own_hits(spark):
    found = spark.createDataFrame(
        [(1, d, r, f"name: n\nprice: {p}", "a") for d, r, p in [(10, 1, 5), (11, 2, 9), (12, 3, 9), (13, 4, "none"), (14, 5, 1)]] + [(2, 10, 1, "name: n\nprice: 5", "a"), (3, 10, 1, "name: n\nsize: 2", "a")], FOUND
    )
    asked = spark.createDataFrame([(1, "最贵的"), (2, "最便宜的"), (3, "最便宜的"), (4, "最贵的"), (5, "what?")], "query_id long, query string")
    got = {(r.query_id, r.doc_id, r.value, r["rank"]) for r in H.extremum_of_hits(asked, found, k=2).collect()}
    assert got == {(1, 11, 9.0, 1), (1, 12, 9.0, 2), (2, 10, 5.0, 1)}
    assert H.extremum_of_hits(asked, found.limit(0)).count() == 0


def test_route_decides_the_documents(spark):
    rows = [(q, d, r, f"name: n\nprice: {d}", "cat" if d % 2 else "dog") for q in (1, 2, 3, 4) for r, d in enumerate((10, 11, 12, 13), 1)]
    found = spark.createDataFrame(rows, FOUND)
    asked = spark.createDataFrame([(1, "最贵的", "comparison"), (2, "建议", "recommendation"), (3, "x", "qa"), (4, "建议", "recommendation")], "query_id long, query string, route string")
    words = spark.createDataFrame([(2, [0.9, 0.1]), (4, [-1.0, -1.0])], "query_id long, word_vec array<double>")
    categories = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "category string, category_vec array<double>")
    got = {}
    for r in H.hits_by_route(asked, found, words, categories, 2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    # A question that fits no category keeps its hits.
    assert got == {1: [13, 12], 2: [11, 13], 3: [10, 11], 4: [10, 11]}


def test_messages_as_of_every_user_turn(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(7)] + [(2, 0, "assistant", "x")]
    out = H.messages_as_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), last=3, system="s").collect()
    by = {}
    for r in sorted(out, key=lambda r: r.pos):
        by.setdefault((r.conv_id, r.turn), []).append(r.content)
    assert by == {(1, 0): ["s", "t0"], (1, 2): ["s", "t0", "t1", "t2"], (1, 4): ["s", "t1", "t2", "t3", "t4"], (1, 6): ["s", "t3", "t4", "t5", "t6"]}


def test_changes_rewrite_only_their_buckets(spark):
    path = work_path(spark, "test-buckets")
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("version"))
    B.write_bucketed(rows, path, "k", 8)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path.removeprefix('file:')}/bucket=*/*.parquet")}
    before = files()
    change = spark.createDataFrame([(7, "new", 2), (1000, "more", 1), (8, "stale", 0), (None, "none", 3)], "k long, v string, version int")
    touched = {r[0] for r in change.where("k IS NOT NULL").select(B.bucket_of(F.col("k"), 8)).collect()}
    for _ in range(2):
        B.upsert_stored(spark, path, change, "k", "version", 8)
    after = files()
    stays = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert stays and stays <= after.keys() and all(before[f] == after[f] for f in stays)
    assert not (set(before) - stays) & after.keys()
    got = {r.k: r.v for r in B.read_bucketed(spark, path).collect()}
    assert got == {**{k: "old" for k in range(200)}, 7: "new", 1000: "more"}
    # A bucket of which nothing is left goes; deleting again changes nothing.
    gone = spark.range(201).select(F.col("id").alias("k")).where(B.bucket_of(F.col("k"), 8) == 3)
    for _ in range(2):
        B.delete_stored(spark, path, gone, "k", 8)
    left = {r.k for r in B.read_bucketed(spark, path).collect()}
    assert left == set(got) - {r.k for r in gone.collect()} and not glob.glob(f"{path.removeprefix('file:')}/bucket=3")
    B.upsert_stored(spark, path, change.limit(0), "k", "version", 8)
    assert {r.k for r in B.read_bucketed(spark, path).collect()} == left
