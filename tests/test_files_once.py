"""Files are read and routed once, however many kinds of chunks and refusals come of them."""

from lexiquarry.plans.flows import process_files


def test_files_are_routed_once(spark):
    files = [("a", "a.csv", None, "k;v\n1;2\n3;4"), ("b", "b.txt", None, "| k |\n|---|\n| 1 |"), ("c", "c.txt", None, "plain text"), ("d", "d.txt", None, ""), ("e", "e.xlsx", None, "PK")]
    read = spark.createDataFrame(files, "source string, path string, mime string, content string").mapInArrow(
        lambda batches: batches, "source string, path string, mime string, content string"
    )
    chunks, refused = process_files(read, size=100, overlap=0)
    assert {(r.source, r.kind) for r in chunks.collect()} == {("a", "csv"), ("b", "table_text"), ("c", "text")}
    assert {(r.source, r.error) for r in refused.collect()} == {("d", "no content"), ("e", "a workbook needs a decoder")}
    for out in (chunks, refused):
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
