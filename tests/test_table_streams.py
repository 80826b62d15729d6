"""Registered streams over tables that are one file, and over tables that are folders of files."""

import os

import pytest
from pyspark.sql import functions as F

from lexiquarry.catalog import load_all
from lexiquarry.session import work_path
from lexiquarry.streaming import ingest as G

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark):
    """The same rows as single files and as folders of three files."""
    base = work_path(spark, "tables").replace("file:", "")
    for name, rows in (("documents", 12), ("embeddings", 40), ("events", 200)):
        some = spark.read.parquet(f"{SMALL}/{name}.parquet").limit(rows)
        some.repartition(3).write.parquet(f"{base}/many/{name}.parquet")
        spark.read.parquet(f"{base}/many/{name}.parquet").coalesce(1).write.parquet(f"{base}/staged/{name}")
        [part] = [f for f in os.listdir(f"{base}/staged/{name}") if f.endswith(".parquet")]
        os.makedirs(f"{base}/one", exist_ok=True)
        os.rename(f"{base}/staged/{name}/{part}", f"{base}/one/{name}.parquet")
    return f"{base}/one", f"{base}/many"


@pytest.mark.parametrize("name", ["stream_ingest", "stream_questions", "documents_added_stream"])
def test_a_folder_of_files_streams_like_one_file(spark, folders, name):
    one, many = (sorted(map(tuple, load_all()[0][name](spark, folder).collect())) for folder in folders)
    assert one and one == many


def test_every_row_of_a_folder_is_streamed(spark, folders):
    ids = load_all()[0]["stream_ingest"](spark, folders[1]).select("doc_id").distinct()
    assert ids.count() == spark.read.parquet(f"{folders[1]}/documents.parquet").where(F.col("text") != "").count()


def test_contents_are_stored_once_however_far_apart_their_keys_are(spark):
    """Round one has keys far beyond those of round two, and the same contents again at keys of both rounds."""
    base = work_path(spark, "far")
    rows = [(0, "one"), (400_000_000, "two"), (900_000_000, "one"), (2, "two"), (1, "three"), (900_000_001, "one"), (10**12 + 1, "three")]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(7, "doc_id").write.parquet(f"{base}/documents.parquet")
    stored = load_all()[0]["stream_ingest_dedup"](spark, base).collect()
    assert sorted(r.stored for r in stored) == [1, 1, 1]


def test_copies_are_forgotten_after_the_delay_only_if_one_is_given(spark):
    stream = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS content", "timestamp AS at")
    with pytest.raises(ValueError, match="both"):
        G.drop_copies(stream, "at")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "Watermark" in plan(G.drop_copies(stream, "at", "1 hour")) and "Watermark" not in plan(G.drop_copies(stream))
