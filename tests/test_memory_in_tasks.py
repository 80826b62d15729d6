"""Memory of Python tasks: what is held at a time does not grow with a batch or with the words seen."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import packing
from lexiquarry.operators import hits as H, search as S


def test_words_are_remembered_compactly():
    """The ids of 60,000 words take tens of bytes a word, and are the tokenizer's own."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds(path)
    words = ["".join(w) for w in itertools.product("abdefgiklmnoprstuvz", repeat=4)][:61_000]
    texts = [" ".join(words[low : low + 2000]) for low in range(0, 61_000, 2000)]
    tracemalloc.start()
    got = ids([*texts, "plain œuvre — text", None])
    ids(texts)
    held = sum(x.nbytes for x in (ids.keys, ids.pool, ids.place, ids.size))
    tracemalloc.stop()
    assert len(ids.keys) > 60_000 and held < 80 * len(ids.keys)
    whole = Tokenizer.from_file(path)
    for text, found in zip([*texts[:3], "plain œuvre — text"], [*got[:3], got[-2]]):
        assert found.tolist() == [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert got[-1].tolist() == [packing.END_ID]


def test_tied_pairs_are_decided_few_at_a_time():
    """A crowd of equal vectors: all pairs tie, and their exact metric is computed in bounded parts."""
    x = np.ones((2000, 64))
    tracemalloc.start()
    qi, xi, _ = S._nearest_pairs(x[:500], x, np.arange(2000), 3, "cosine")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(qi) == 1500 and set(xi.tolist()) == {0, 1, 2} and peak < 150 << 20


def test_histories_are_shuffled_once(spark, capsys):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 8)], "conv_id long, turn long, role string, text string")
    out = H.messages_as_of(turns, last=2, system="s")
    assert sorted((r.turn, r.pos, r.content) for r in out.where("turn = 5").collect()) == [(5, 0, "s"), (5, 1, "m3"), (5, 2, "m4"), (5, 3, "m5")]
    out.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_pieces_are_made_and_packed_one_after_the_other(spark, monkeypatch):
    """No task has a worker that makes pieces next to one that packs them."""
    plans, pack_round = [], packing._pack_round

    def watched(pieces, *args):
        plans.append(pieces._jdf.queryExecution().executedPlan().toString())
        return pack_round(pieces, *args)

    monkeypatch.setattr(packing, "_pack_round", watched)
    made = spark.range(300).mapInArrow(lambda batches: batches, "id long").select("id", (F.col("id") % 70 + 1).alias("length"))
    out = packing.pack(made, sequence=100, bins=8, together=50)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("id").alias("k")).collect()
    assert sum(r.k for r in full) == 300 and max(r.n for r in full) <= 100
    assert len(plans) > 1 and not any("MapInArrow" in p for p in plans)
