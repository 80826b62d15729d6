import json

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import text as T, vectors as V
from lexiquarry.operators import documents as D, tables as M
from lexiquarry.params import FIELD_ALIASES


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("content"))).collect()]


def test_strip_knows_all_blanks(spark):
    assert values(spark, ["　 a b\xa0\n\t", "   ", "x"], T.strip) == ["a b", "", "x"]


def test_tokens(spark):
    got = values(spark, ["Hello, World_1!", "机器学习 is ML好", "", "é-É"], T.tokens)
    assert got == [["hello", "world_1"], ["机器", "器学", "学习", "is", "ml", "好"], [], ["é", "é"]]


def test_ngrams(spark):
    got = values(spark, ["the cat sat", "the", "one"], lambda c: T.ngrams(T.tokens(c), ("the",)))
    assert got == [["cat", "sat", "cat sat"], [], ["one"]]


@pytest.mark.parametrize("text,expected", [
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", True),
    ("a|b\n-|-\n1|2", True),
    ("a|b\n1|2", True),
    ("one line", False),
    ("prose\n\nwith a blank line", False),
    ("a|b\n1|2|3", False),
    ("", False),
])
def test_is_table(spark, text, expected):
    assert values(spark, [text], T.is_table_text) == [expected]


@pytest.mark.parametrize("text,expected", [
    ("| a |\n|---|\n| 1 |", "table"),
    (' {"a": [1, 2]} ', "json"),
    ("{not json}", "text"),
    ("<p>one</p>", "markup"),
    ("a <b>\nx</b>", "markup"),
    ("a <b> never closed", "text"),
    ("</b> before <b>", "markup"),
    ("intro\n- one\n- two", "list"),
    ("1. one", "list"),
    ("plain", "text"),
])
def test_detect_format(spark, text, expected):
    assert values(spark, [text], T.detect_format) == [expected]


def test_pretty_json_keeps_order_and_nesting(spark):
    source = '{"b": {"y": [1, 2.50]}, "a": "é"}'
    got = values(spark, [source, "text", None], T.pretty_json)
    assert got == [json.dumps(json.loads(source), indent=2, ensure_ascii=False), "text", None]


def test_guess_type(spark):
    texts = ["12", "1e3", "-.5", "nan", "1", "0", "12999元", "1d", "1_000", "", "2024-01-02x", "12:30:00", "Yes", "n", "maybe"]
    want = ["NUMERIC"] * 6 + ["TEXT"] * 4 + ["DATETIME"] * 2 + ["BOOLEAN"] * 2 + ["TEXT"]
    assert values(spark, texts, T.guess_type) == want


def test_to_number(spark):
    texts = ["12", " 1e3 ", "12999元", "1d", "1_000", "", "元1"]
    assert values(spark, texts, T.to_number) == [12.0, 1000.0, None, None, None, None, None]
    assert values(spark, texts, lambda c: T.to_number(c, True)) == [12.0, 1000.0, 12999.0, 1.0, 1.0, None, None]


def test_parse_kv(spark):
    aliases = T.alias_map(FIELD_ALIASES)
    texts = [
        "价格: 1\nPrice: 2\nnote: a: b\nno pair",
        "x | 商品ID: 7 | 价格: 5元",
        "| 名称 | 价格 |\n| --- | --- |\n| w | 3 |\n| v | 4 |",
        "| a | b |\n| --- | --- |\n| only |",
        "nothing here",
        "",
    ]
    assert values(spark, texts, lambda c: T.parse_kv(c, aliases)) == [
        {"price": "2", "note": "a: b"}, {"product_id": "7", "price": "5元"}, {"product_name": "w", "price": "3"}, {}, {}, {},
    ]


def test_markdown_tables(spark):
    texts = [
        " | a | b |\n|:---|---:|\n| 1 | 2 |  \n| 3 |\n| 4 | 5 | 6 |\n\n",
        "| a | b |\n| 1 | 2 |",
        "| a | b |\n| --- | --- |",
        "just a line",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    rows = M.read_markdown_table(df).orderBy("id", "row_no").collect()
    assert [(r.id, r.row_no, r.cells) for r in rows] == [
        (0, 0, {"a": "1", "b": "2"}), (0, 1, {"a": "3", "b": ""}), (0, 2, {"a": "4", "b": "5"}), (1, 0, {"a": "1", "b": "2"}),
    ]
    named = M.read_markdown_table(df, columns=["b", "zz"]).where("id = 0").orderBy("row_no").collect()
    assert [(r.b, r.zz) for r in named] == [("2", None), ("", None), ("5", None)]
    assert sorted(r.id for r in M.markdown_fallback(df).collect()) == [2, 3]


def test_table_texts_in_blocks(spark):
    texts = [(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 5 | 6 | 7 |"), (2, "| x |\n| --- |"), (3, "no table")]
    df = spark.createDataFrame(texts, "id int, content string")
    rows = M.markdown_blocks(df, 2).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.total_chunks, r.row_start, r.row_end) for r in rows] == [(1, 0, 2, 0, 2), (1, 1, 2, 2, 3)]
    assert rows[0].content == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |" and rows[1].content.endswith("\n| 5 | 6 |")


def test_process_files(spark):
    from lexiquarry.plans.flows import process_files

    files = spark.createDataFrame(
        [("a", "/a.txt", "text/plain", "word " * 100), ("b", "/b.md", None, "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("c", "/c.png", "image/png", "x")],
        "source string, path string, mime string, content string",
    )
    chunks, refused = process_files(files, size=100, overlap=0)
    rows = chunks.collect()
    assert "".join(r.content for r in sorted((r for r in rows if r.source == "a"), key=lambda r: r.chunk)) == "word " * 100
    assert [r.kind for r in rows if r.source == "b"] == ["markdown"]
    assert [r.error for r in refused.collect()] == ["unsupported type: image/png"]


def test_every_file_comes_out_once(spark):
    from lexiquarry.plans.flows import process_files

    csv = 'name;note\n"a;1";"line\none ""x"""\n\n' + "\n".join(f"r{i};{i}" for i in range(6)) + "\nshort"
    files = spark.createDataFrame([
        ("csv", "/a.csv", None, csv), ("tab", "/b.CSV", None, "a\tb\n1\t\n\t2"), ("lone", "/c.csv", None, "only a header"),
        ("xls", "/d.xlsx", None, "PK"), ("line", "/e.md", None, "x |-|- y"), ("head", "/f.md", None, "| h1 | h2 |\n|---|---|"),
        ("none", "/g.txt", None, None), ("empty", "/h.csv", None, ""), ("text", "/i.txt", None, "words"),
    ], "source string, path string, mime string, content string")
    chunks, refused = process_files(files, size=100, overlap=0)
    rows = chunks.orderBy("source", "chunk").collect()
    assert sorted({r.source for r in rows} | {r.source for r in refused.collect()}) == sorted(r.source for r in files.collect())
    assert {r.source: r.error for r in refused.collect()} == {"xls": "a workbook needs a decoder", "none": "no content", "empty": "no content"}
    blocks = [(r.chunk, r.total_chunks, r.content) for r in rows if r.source == "csv"]
    assert [b[:2] for b in blocks] == [(0, 2), (1, 2)]
    assert blocks[0][2].startswith('| name | note |\n| --- | --- |\n| a;1 | line\none "x" |\n| r0 | 0 |')
    assert blocks[1][2].endswith("| r5 | 5 |\n| short |  |")
    assert [r.content for r in rows if r.source == "tab"] == ["| a | b |\n| --- | --- |\n| 1 |  |\n|  | 2 |"]
    assert {r.source: r.content for r in rows if r.source in ("lone", "line", "head", "text")} == {
        "lone": "only a header", "line": "x |-|- y", "head": "| h1 | h2 |\n|---|---|", "text": "words",
    }


def test_chunk_rows_with_nulls_and_sources(spark):
    df = spark.createDataFrame(
        [("s", i, None if i == 2 else f"v{i}") for i in range(7)] + [("t", 1, "x")], "src string, k int, v string"
    )
    blocks = M.chunk_rows(df, "k", 3, "src").orderBy("src", "chunk_index").collect()
    assert [(b.src, b.chunk_index, b.total_chunks, b.row_start, b.row_end) for b in blocks] == [
        ("s", 0, 3, 0, 3), ("s", 1, 3, 3, 6), ("s", 2, 3, 6, 7), ("t", 0, 1, 0, 1),
    ]
    assert blocks[0].content == "| k | v |\n| --- | --- |\n| 0 | v0 |\n| 1 | v1 |\n| 2 |  |"
    kept = M.chunk_rows(df, "k", 3, "src", preserve_empty=True).where("src = 's' and chunk_index = 0").head()
    assert kept.content.endswith("| 2 | nan |")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(
        V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z")), V.cosine(F.col("a"), F.col("z")),
        V.cosine01(F.col("a"), F.transform("a", lambda x: -x)), V.l2sq(F.col("a"), F.col("z")),
    ).head()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], 0.0, 0.0, 25.0]


def test_routes(spark):
    questions = ["最贵的是哪个，推荐", "推荐一款", "建议", "总结", "你好", "price"]
    want = ["comparison", "list", "recommendation", "summary", "chat", "qa"]
    assert values(spark, questions, D.route_question) == want
    assert values(spark, ["cheap one"], lambda c: D.route_question(c, [("own", ["cheap"])])) == ["own"]


def test_upsert_and_clear(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, None, 2)], "k int, v string, version int")
    assert sorted(map(tuple, D.upsert_collection(old, new, "k", "version").collect())) == [(1, "a", 1), (2, "c", 2), (3, None, 2)]
    assert D.clear(old).count() == 0 and D.collection_stats(D.clear(old.withColumn("embedding", F.array(F.lit(1.0))))).head().status == "empty"


def test_metadata_layers(spark):
    df = spark.createDataFrame([({"a": "own", "b": "own", "doc_type": "own"},)], "m map<string,string>")
    layered = D.merge_metadata(
        F.col("m"), F.create_map(F.lit("b"), F.lit("cfg"), F.lit("c"), F.lit("cfg")), F.lit("auto"), F.create_map(F.lit("c"), F.lit("extra"))
    )
    assert df.select(layered).head()[0] == {"a": "own", "b": "cfg", "c": "extra", "doc_type": "auto"}
