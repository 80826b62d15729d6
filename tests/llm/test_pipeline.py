"""The pipeline on a small table: every stage's decisions take effect, and nothing else is lost."""

import random
import string
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from lexiquarry.llm import queries

from test_near_lines import form_of, plain_link, plain_signatures
from test_pair_operators import reach, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema) if out[-1] else docs.limit(0)
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == corpus_pipeline.COLUMNS
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(stages[-1][0].asDict())


def test_quality_and_lines(stages):
    raw, good, lined, single = stages[:4]
    assert set(good) <= set(raw) and len(good) > 0.7 * len(raw)
    texts = {r.doc_id: r.text for r in good}
    for r in lined:
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) and r.n_chars == len(r.text)
    seen = Counter(" ".join(w for w in line.lower().split()) for r in lined for line in r.text.split("\n") if len(line.split()) >= 4)
    assert max(seen.values()) == 1
    assert set(single) <= set(lined)


def test_mix_and_pack(stages):
    single, mixed, packed = stages[3:]
    assert set(mixed) <= set(single) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted():
    """Documents with near copies, repeated and nearly repeated lines, junk, and texts of no words."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(20), line(30)]
    texts = []
    for i in range(40):
        body = [line(rng.choice([8, 15, 40])) for _ in range(rng.randrange(2, 5))]
        if i % 4 == 0:
            body.insert(1, shared[i // 4 % 2])
        if i % 8 == 4:
            body[1] = body[1].replace("a", "e", 1).upper()
        texts.append("\n".join(body))
        if i % 5 == 0:
            words = texts[-1].split(" ")
            words[len(words) // 2] = "changed"
            texts += [texts[-1], " ".join(words)]
    texts += ["", "   ", "only five words are here", "# $ % " * 40, "again and again and again and again and " * 9]
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(None, texts[3], None, None, 5)]


def duck_rows(rows, sql, columns):
    duck = duckdb.connect()
    duck.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    duck.execute("CREATE VIEW documents AS SELECT * FROM given")
    return duck.execute(f"SELECT {columns} FROM ({sql})").fetchall()


def test_quality_stage_is_its_sql(spark, planted):
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(planted, SCHEMA), SF).collect()
    kept = Counter(r[0] for r in duck_rows(planted, queries.ORACLES["op7_quality_rules"], "doc_id, kept") if r[1])
    assert Counter(r.doc_id for r in got) == kept and {tuple(r) for r in got} <= set(planted)


def test_line_stage_against_plain_version(spark, planted):
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(planted, SCHEMA), SF).collect()}
    forms = sorted({form_of(x) for _, t, *_ in planted for x in t.split("\n") if form_of(x)})
    of = {f: plain_signatures(f) for f in forms}
    groups = reach(len(forms), lambda x, y: plain_link(forms[x], forms[y], of))
    group_of, seen, want = {f: min(groups[i]) for i, f in enumerate(forms)}, set(), {}
    for i, text, *_ in sorted(planted, key=lambda r: (r[0] is not None, r[0] or 0)):
        left = []
        for x in text.split("\n"):
            group = group_of.get(form_of(x))
            if group is None or group not in seen:
                left.append(x)
            seen.add(group)
        if left == text.split("\n") or "\n".join(left):
            want[i] = "\n".join(left)
    assert got == want and any(want[i] != t for i, t, *_ in planted if i in want)


def test_copies_stage_against_plain_version(spark, planted):
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(planted, SCHEMA), SF).collect()}
    keyed = [r for r in planted if r[0] is not None]
    sets = [shingles(r[1]) for r in keyed]
    linked = lambda x, y: bool(sets[x] and sets[y]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    groups = reach(len(keyed), linked)
    # Rows with a null key are in no group and stay.
    want = {min(keyed[j][0] for j in group) for group in groups.values()} | {None}
    assert got == want and len(want) < len(planted)


def test_mix_stage_is_its_sql(spark, planted):
    rows = [r for r in planted if r[0] is not None]
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    want = {i: taken // size for i, size, taken in duck_rows(rows, queries.ORACLES["op10_mix_sources"], "doc_id, size, taken") if size and taken}
    assert {i: n for i, n in got.items() if i in want} == want
    assert all(not rows[i][1].split() for i in got if i not in want)
