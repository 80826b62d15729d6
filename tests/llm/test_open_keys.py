"""Many different lines with one passage in common, and texts that are not shuffled because no line of theirs is wanted."""

import random
import string

from pyspark.sql import functions as F

from lexiquarry.llm import common, lines

SCHEMA = "doc_id long, text string, source string, n long"


def made(n):
    """Lines with the same last two of five parts; every tenth has a near copy, which is never the least or the largest line."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    passage, out = [word() for _ in range(24)], []
    for i in range(n):
        head = [word() for _ in range(36)]
        out.append(" ".join(head + passage))
        if i % 10 == 0:
            out.append(" ".join(head[:7] + [word()] + head[8:] + passage))
    return out


def test_pairs_of_open_keys_are_not_written(spark, monkeypatch):
    written, plain = {}, lines.materialize

    def counted(df, label):
        out = plain(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    texts = made(150)
    out = lines.drop_near_lines(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    gone = {r.doc_id for r in out if r.n_removed}
    # The head of a near copy begins as the line's before it; the earlier one stays.
    assert gone == {i for i in range(1, len(texts)) if texts[i][:30] == texts[i - 1][:30]} and len(gone) == 15
    assert all(rows <= 60 * len(texts) for rows in written.values()) and written["texts"] >= len(texts)


def test_same_result_without_broadcasts(spark, monkeypatch):
    rng = random.Random(9)
    some = made(20)
    rows = [(i if i else None, "\n".join(rng.choices(some, k=3)) if i % 3 else f"only {i} here {i * i}", "x", i) for i in range(60)] + [(99, None, "x", 1), (98, "", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_chance", F.lit("kept"))
    usual = sorted(map(repr, lines.drop_near_lines(docs).collect()))
    monkeypatch.setattr(lines, "bounded_broadcast", lambda df: df)
    assert sorted(map(repr, lines.drop_near_lines(docs).collect())) == usual


def test_chance(spark):
    numbers = spark.range(20_000).select(F.xxhash64("id").alias("mark"), "id")
    wanted = numbers.where("id % 7 = 0").select(F.col("mark").alias("of"))
    out = {r.id: r.chance for r in common.with_chance(numbers, "mark", wanted, "of", "chance").collect()}
    assert len(out) == 20_000 and all(out[i] for i in range(0, 20_000, 7))
    assert sum(out.values()) < 20_000 // 7 + 100
    none = numbers.select(F.lit(None).cast("bigint").alias("mark"))
    assert {r.chance for r in common.with_chance(none, "mark", wanted, "of", "chance").collect()} == {False}
