"""Delimited files with line breaks in cells, cut anywhere, against a reader that takes each file whole."""

import csv
import io
import random

import pytest

import lexiquarry.sources.files as P
from lexiquarry.sources import records


@pytest.fixture()
def small_ranges(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}

    def cut(size):
        for k in keys:
            spark.conf.set(k, size)

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


def made_files(rng, folder):
    """Cells with breaks, quotes, delimiters and single quotes in the middle; cells longer than several ranges."""
    pieces = ["a", "bc", 'say "so"', "x;y", "one\ntwo", "\n", "\n\n\"", "", 'mid"dle', "long " * 60, "line\n" * 40, "é漢", "\r\nx"]
    for f in range(3):
        rows = [[str(i), "".join(rng.choices(pieces, k=rng.randrange(1, 4))), rng.choice(pieces)] for i in range(f * 100, f * 100 + 60)]
        out = io.StringIO()
        writer = csv.writer(out, delimiter=";", lineterminator="\r\n" if f == 1 else "\n")
        writer.writerows([["id", "note", "more"], *rows])
        text = out.getvalue()
        # The last record of one file has no line break, and a quote in an unquoted cell opens nothing.
        text = text.rstrip("\r\n") if f == 2 else text + ('900;5" pipe;6" more\n' if f == 0 else "")
        (folder / f"part{f}.csv").write_text(text, encoding="utf-8", newline="")


def whole(spark, path, schema):
    reader = spark.read.options(header="true", sep=";", quote='"', escape='"', multiLine="true").schema(schema)
    return plain(reader.csv(path))


def plain(df):
    """Rows with every line break as a line feed: the one-task reader turns breaks in cells into that of the file."""
    return sorted(tuple(x.replace("\r\n", "\n") if isinstance(x, str) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("size, few", [(37, 50_000), (64, 0), (501, 50_000), (1 << 20, 0)])
def test_any_cut_gives_the_same_rows(spark, tmp_path, small_ranges, size, few, monkeypatch):
    monkeypatch.setattr(records.split_records, "__defaults__", (few,))
    made_files(random.Random(size), tmp_path)
    schema = "id INT, note STRING, more STRING"
    small_ranges("128m")
    want = whole(spark, str(tmp_path), schema)
    small_ranges(str(size))
    got = records.read_records(spark, str(tmp_path), ";", schema)
    assert plain(got) == want
    if size < 100:
        assert records._lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 50


def test_types_names_and_edges(spark, tmp_path, small_ranges):
    small_ranges("20")
    (tmp_path / "a.csv").write_text('﻿id,"two\nlines",price\n1,"x\n\n,y",2.5\n\n2,,3\n', encoding="utf-8")
    df = P.read_delimited(spark, str(tmp_path / "a.csv"), ",", multi_line=True)
    assert [(f.name, f.dataType.typeName()) for f in df.schema] == [("id", "integer"), ("two\nlines", "string"), ("price", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, "x\n\n,y", 2.5), (2, None, 3.0)]
    (tmp_path / "open.csv").write_text('id,t\n1,"never\nclosed\n2,x\n')
    assert records.split_records(spark, str(tmp_path / "open.csv"), ",").count() == 2
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        P.read_delimited(spark, str(tmp_path / "none.csv"), ",", multi_line=True)
    (tmp_path / "head.csv").write_text("id,t\n")
    assert P.read_delimited(spark, str(tmp_path / "head.csv"), ",", multi_line=True).count() == 0


@pytest.mark.parametrize("line, closed, opened", [
    ("a,b", False, True), ('"a,b', True, False), ('a,"b"",', True, False), ('a,"b"', False, False), ('5" pipe', False, False), ('x","y', True, True),
    ('""', False, True), ('"",""', False, True), ('a,"""', True, False),
])
def test_state_of_a_line(line, closed, opened):
    assert records.cell_open(line, False, ",") == closed and records.cell_open(line, True, ",") == opened
