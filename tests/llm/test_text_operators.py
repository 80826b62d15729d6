"""Quality rules, mixing and packing against plain versions of the same definitions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import mixing, packing, quality, queries

LONG = "wort " * 3000 + "\n" + "Ein ganz langes Ende ohne Punkt " * 400
TEXTS = [
    None, "", "   \n\t ", "a", "don't we'll 's ''s x!'s it's's 42 3.14 'Some ve've", "a b c d e a b c d e a b c d e f g h",
    "line one\nline one\n\nline two\nline one\r\nline one", "#*$ %&|<> # word", "Žluťoučký kůň — 東京 ½ ²", "İstanbul ÄÖÜ × ÿ \x85x\xa0y µ ª",
    "<|endoftext|> in a text", "x\x1cy\x0bz\x0cq", LONG, LONG, "the same text in many rows of ten words or more here", "the same text in many rows of ten words or more here",
] + [f"document number {i} has some words of its own like w{i} and v{i * 7} and u{i * 13} here\nanother line {i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 5 else i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, _bin string").repartition(3)


EMPTY = "doc_id long, text string, lang string, source string"


def measured(text):
    text = text or ""
    words = [(m.group(), m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [w for w, _ in words]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, docs):
    out = quality.judge(docs).collect()
    assert len(out) == len(TEXTS)
    want = Counter((None if i == 5 else i, *measured(t)) for i, t in enumerate(TEXTS))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_adapts_and_keeps_ordinary(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "plain") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{i}x{j} #" for j in range(20)), "en", "symbols") for i in range(300)]
    rows += [(5000, " ".join(f"odd{j} ###" for j in range(20)), "en", "plain")]
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, EMPTY)).collect()}
    assert not out.pop(5000) and all(out.values())


def test_quality_of_repeated_lines_and_junk(spark):
    """Repeated lines are a share of lines, a group with much junk does not keep it, and a caller's own columns stay."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    plain = [(i, "\n".join(words(100 * i + k, 12) for k in range(5)), "en", "a", 777, "mine") for i in range(200)]
    menu = "\n".join("one line of a menu" if k % 2 else words(9000 + k, 30) for k in range(9))
    junk = [(1000 + i, " ".join(f"w{i}y{j} #" + "#" * (j % 3) for j in range(30)), "en", "a", 777, "mine") for i in range(60)]
    frame = spark.createDataFrame([*plain, (999, menu, "en", "a", 777, "mine"), *junk], EMPTY + ", n_words int, kept string")
    kept = quality.keep_good(frame).collect()
    assert {r.doc_id for r in kept} == set(range(200)) and all((r.n_words, r.kept) == (777, "mine") for r in kept)


def test_sketch_quantiles(spark):
    values = np.random.default_rng(1).lognormal(0, 2, 5000)
    frame = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    whole = quality.quantile_sketches(frame, ["k"], "v")
    parts = [quality.quantile_sketches(frame.where(F.col("v") * 1000 % 3 < 1), ["k"], "v"), quality.quantile_sketches(frame.where(F.col("v") * 1000 % 3 >= 1), ["k"], "v")]
    merged = parts[0].unionAll(parts[1]).groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(whole.collect()) == sorted(merged.collect())
    row = quality.sketch_quantiles(merged, ["k"], {"a": 0.25, "b": 0.9}).head()
    for got, q in ((row.a, 0.25), (row.b, 0.9)):
        assert abs(got / np.quantile(values, q) - 1) < 0.02


@pytest.mark.parametrize("most, sizes", [(3, [1000, 10, 10, 500, 300, 7]), (3, [0, 0]), (3, [5]), (2, [100, 1, 1, 1, 400])])
def test_water_fill(spark, most, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = list(zip(names, sizes))
    frame = spark.createDataFrame(rows, "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(mixing.turn_weights(frame), most).collect()}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    cap = {n: most * s for n, s in rows}
    total, full = sum(sizes), set()
    while True:  # pass the excess on until none is above
        left = total - sum(cap[n] for n in full)
        free = [n for n in names if n not in full]
        want = {n: cap[n] for n in full} | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if want[n] > cap[n]}
        if not over:
            break
        full |= over
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 * max(1, total) for n in names)


def test_mix(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == len(TEXTS)
    again = Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((r.doc_id, r.source, r["size"], r.copies) for r in out)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == measured(dict((None if i == 5 else i, t) for i, t in enumerate(TEXTS))[r.doc_id])[0]
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    for rows in by.values():
        assert rows[0].source_size == sum(r["size"] for r in rows)
        assert abs(sum(r["size"] * r.copies for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    assert mixing.repeated(mixing.mix(docs), ["doc_id", "text"]).count() == sum(r.copies for r in out)
    assert mixing.mix(spark.createDataFrame([], EMPTY)).count() == 0


def test_token_pieces(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[(None if i == 5 else i, p, at, len(part) // 4, zlib.crc32(part))] += 1
    got = packing.token_pieces(docs, queries.tokenizer_path()).withColumn("crc", F.crc32("ids")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == want


@pytest.mark.parametrize("together, bins", [(100_000, 1024), (40, 4)])
def test_pack(spark, together, bins):
    lengths = np.random.default_rng(2).integers(1, 2049, 500).tolist()
    rows = [(i // 2, i % 2, n, "x") for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string").repartition(7)
    out = packing.pack(pieces, bins=bins, together=together).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in out) == Counter((a, b, n) for a, b, n, _ in rows)
    bins_of = defaultdict(list)
    for r in out:
        bins_of[r.sequence_id].append((r.offset, r.length))
    for parts in bins_of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(lengths) // 2048)
    assert len(bins_of) <= least * (1.06 if bins > 100 else 1.5)
    assert packing.pack(pieces.limit(0)).count() == 0
