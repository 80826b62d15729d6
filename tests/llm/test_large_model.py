"""A toxicity model beyond what is broadcast gives the scores of one that is not."""

import random

from lexiquarry.llm import toxicity


def test_scores_do_not_depend_on_the_size(spark, monkeypatch):
    rng = random.Random(11)
    common = [f"w{i}" for i in range(200)]
    docs, labels = [(2000, None), (2001, ""), (None, "rotten vile rotten"), (5, "vile")], []
    for i in range(600):
        words = rng.choices(common, k=30)
        if i % 6 == 0:
            words = [w for x in words[:15] for w in (x, rng.choice(["vile", "rotten", "ghastly", "foul"]))]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")

    def scores():
        return sorted(((r.doc_id is None, r.doc_id or 0, round(r.margin, 9), round(r.score, 9), r.predicted) for r in toxicity.score(docs, labels).collect()))

    whole = scores()
    assert any(r[2] for r in whole)
    # The bound on a model's words, here and as the default argument it was before.
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", 1, raising=False)
    bounds = toxicity.word_ratios.__defaults__
    monkeypatch.setattr(toxicity.word_ratios, "__defaults__", tuple(1 if x == 1_000_000 else x for x in bounds))
    assert scores() == whole
