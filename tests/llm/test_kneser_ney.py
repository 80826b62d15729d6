"""The toxicity models against a plain version: every word of a text is scored, by pairs with both levels of backoff."""

import math
import random
import zlib
from collections import Counter

from lexiquarry.llm import toxicity


def _margins(docs, labels, discount, pair_discount, cost):
    train = [(docs[i].split(), bad) for i, bad in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1]
    pairs = [Counter(p for words, bad in train if bad == c for p in set(zip(["<s>", *words], words))) for c in (0, 1)]
    follows = [Counter(w for _, w in pairs[c]) for c in (0, 1)]
    size = [sum(f.values()) for f in follows]

    def single(w, c):
        off = sum(min(n, discount) for n in follows[c].values())
        # A word that was never seen has the same small share of both classes' backoff.
        share = (follows[0][w] + follows[1][w]) / sum(size) or 1e-9
        return (max(follows[c][w] - discount, 0) + off * share) / size[c]

    def double(v, w, c):
        behind = {x: n for (u, x), n in pairs[c].items() if u == v}
        n = sum(behind.values())
        if not n:
            return single(w, c)
        return (max(behind.get(w, 0) - pair_discount, 0) + sum(min(x, pair_discount) for x in behind.values()) * single(w, c)) / n

    out = {}
    for i, text in docs.items():
        best = now = 0.0
        words = (text or "").split()
        for v, w in zip(["<s>", *words], words):
            now = max(0.0, now + math.log(double(v, w, 1) / double(v, w, 0)) - cost)
            best = max(best, now)
        out[i] = best
    return out


def test_every_word_is_scored_by_both_models(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(25)]
    docs, labels = {}, {}
    for i in range(400):
        words = rng.choices(common, k=12)
        if i % 4 == 0:
            # Two ordinary words that are an insult one after the other.
            words[5:5] = ["get", "lost"] * 2
        else:
            words[5:5] = rng.choice([["get"], ["lost"], ["lost", "get"]])
        docs[i], labels[i] = " ".join(words), int(i % 4 == 0)
    docs |= {1000: "get lost", 1001: "never seen words", 1002: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    want = _margins(docs, labels, toxicity.DISCOUNT, toxicity.PAIR_DISCOUNT, toxicity.COST)
    assert any(want.values())
    for i, margin in want.items():
        assert abs(got[i].margin - margin) < 1e-9
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.98 * len(held)
