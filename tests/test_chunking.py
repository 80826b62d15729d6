import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiquarry.operators import chunking as C
from lexiquarry.params import CHUNK_PRESETS, CODE_SEPARATORS


def cut(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    return [r[0] for r in df.orderBy("doc_id").select(column.alias("c")).collect()]


TEXTS = ["", "a", "abcdefghij", "abcdefghijk", "x" * 1000, "é汉😀" * 50, None]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 9), (1, 0)])
def test_fixed_windows(spark, size, overlap):
    for text, chunks in zip(TEXTS, cut(spark, TEXTS, C.fixed_chunks(F.col("content"), size, overlap))):
        text = text or ""
        if len(text) <= size:
            assert chunks == ([text] if text else [])
            continue
        step = size - overlap
        assert chunks == [text[i : i + size] for i in range(0, len(text) - overlap, step)]


def test_fixed_windows_across_stretches(spark):
    text = "".join(chr(97 + i % 26) for i in range(20_001))
    [chunks] = cut(spark, [text], C.fixed_chunks(F.col("content"), 50, 7))
    assert chunks == [text[i : i + 50] for i in range(0, len(text) - 7, 43)]


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, 6), (5, -1)])
def test_bad_sizes_are_refused(size, overlap):
    with pytest.raises(ValueError):
        C.separator_chunks("content", size, overlap, [" "])


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet="ab .\n汉", max_size=200), st.integers(1, 40), st.integers(0, 39),
    st.lists(st.sampled_from(["\n\n", "\n", ". ", " ", "b"]), max_size=4),
)
def test_separator_cuts_cover_the_text(text, size, overlap, separators):
    if overlap >= size:
        overlap = size - 1
    chunks = C._separator_cuts(text, size, overlap, separators)
    assert all(0 < len(c) <= size for c in chunks)
    rebuilt = chunks[0] if chunks else ""
    for chunk in chunks[1:]:
        assert chunk[:overlap] == rebuilt[len(rebuilt) - overlap :]
        rebuilt += chunk[overlap:]
    assert rebuilt == text


def test_separator_inside_the_overlap_is_passed_over():
    # The only blank lies within the first `overlap` characters: taking it would make no progress.
    assert C._separator_cuts("ab cdefghijklmnop", 8, 4, [" "]) == ["ab cdefg", "defghijk", "hijklmno", "lmnop"]


def test_separator_priority(spark):
    [chunks] = cut(spark, ["one two\nthree four five"], C.separator_chunks(F.col("content"), 14, 0, ["\n", " "]))
    assert chunks == ["one two\n", "three four ", "five"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=30), max_size=12), st.integers(2, 20))
def test_packed_pieces_keep_all_words(pieces, size):
    chunks = C._packed_pieces(pieces, size, 0)
    assert "".join(chunks).replace(" ", "") == "".join(pieces)
    if all(len(p) <= size for p in pieces):
        assert chunks == pieces
    else:
        assert all(len(c) <= size + 1 for c in chunks)


def test_sentences(spark):
    texts = ["One. Two! Three", "no end", "  ", "A。 B？ C", "x" * 25 + ". tail"]
    got = cut(spark, texts, C.sentence_chunks(F.col("content"), 10, 2))
    assert got[:4] == [["One", "Two", "Three"], ["no end"], [], ["A", "B", "C"]]
    assert got[4] == ["x" * 10, "x" * 10, "x" * 9, "tail"]


def test_paragraphs_and_code(spark):
    [paragraphs] = cut(spark, ["a\n \nb\n\n\nc"], C.paragraph_chunks(F.col("content"), 100, 0))
    assert paragraphs == ["a", "b", "c"]
    code = "def f():\n    return 1\n\ndef g():\n    return 2\n"
    [chunks] = cut(spark, [code], C.code_chunks(F.col("content"), 30, 0))
    assert "".join(chunks) == code and chunks[0].endswith("\n\n") and "class " in CODE_SEPARATORS


def test_split_documents_options(spark):
    df = spark.createDataFrame([(1, "s", "word " * 500)], "doc_id int, source string, content string")
    out = C.split_documents(df, "english").orderBy("chunk").collect()
    assert [r.chunk for r in out] == list(range(len(out))) and all(r.total_chunks == len(out) for r in out)
    assert {r.source for r in out} == {"s"}
    # An overlap of zero is a choice, not a missing value.
    zero = C.split_documents(df, "english", overlap=0).orderBy("chunk").collect()
    assert "".join(r.content for r in zero) == "word " * 500
    sized = C.split_documents(df, "auto", size=100, overlap=10, separators=[" "])
    assert sized.agg(F.max(F.length("content"))).head()[0] <= 100
    tagged = C.split_documents(df, "auto", vectorizer=lambda d: d.withColumn("n", F.length("content")))
    assert "n" in tagged.columns
    assert len(CHUNK_PRESETS) == 9
