"""Toxicity by class-conditional Kneser-Ney models of pairs of words.

For the toxic and the ordinary class, the probability of a word after another one comes from the number of the class's
documents with the pair. Counts are discounted, and what is taken off goes to the word's probability in the class, which comes
from its continuation count, the number of different words it follows; so a passage copied a thousand times counts once
there. What is taken off that goes to a backoff that both classes share, with the continuation counts of both. A discount
takes a count off whole if it is no larger, so pairs and words with small counts in both classes are left to the backoff
exactly, and need no row of their own in a table of the model. Every word of a text is scored, by the difference of its
two log-likelihoods. The margin of a document is the largest sum of these over a stretch of its words, less a fixed cost a word:
a mean over all words would drown a few insults in a long text. A logistic curve fitted on the same labelled documents
puts it on a scale from 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import bounded_broadcast
from .words import LOWER, runs, span_hashes, spans

#: Fixed: labels are learnt from rows whose remainder is not HELD, and this score or more is predicted toxic.
FOLDS, HELD = 3, 1
TOXIC_FROM = 0.7

#: Discounts of continuation counts of words, and of numbers of documents with a pair.
DISCOUNT, PAIR_DISCOUNT = 2.0, 8.0
#: What each word of a stretch costs; a stretch is worth its words' ratios less that.
COST = 2.0
#: Rows of a model that are broadcast, those with the largest counts first (16 bytes each); the others are joined.
BROADCAST_WORDS = 1_000_000
#: Slots of 64 bits that say which keys may be among the rows to join.
SLOTS = 1 << 20
#: Steps of the scale on which the logistic curve is fitted.
STEPS = 400

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_WORD_BITS, _BEFORE_BITS = np.uint64(40), np.uint64(24)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD


def _words(column: pa.Array):
    """For each run of texts: the first row, words per text, the text of each word, and 40 bits of each word's hash."""
    for texts in runs(column):
        low = LOWER[texts.data]
        words = spans(texts, _LETTER[low])
        yield texts.first, np.diff(words.first), words, span_hashes(low, words.start, words.end) >> _BEFORE_BITS


def _keys(words, word: np.ndarray) -> np.ndarray:
    """For each word, 40 bits of its hash and 24 bits of that of the word before it, 1 at the start of a text."""
    before = np.ones(len(word), np.uint64)
    near = np.maximum(word >> (_WORD_BITS - _BEFORE_BITS), np.uint64(2))
    before[1:] = np.where(words.text[1:] == words.text[:-1], near[:-1], before[1:])
    return (word << _BEFORE_BITS) | before


def count_pairs(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> DataFrame:
    """pair, docs_toxic, docs_ordinary: documents of each class with a word behind another one (a text's start being one).

    Pairs are counted in every run of texts before they are shuffled, so a word that makes up a third of all text is not
    brought into one task.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(toxic).to_numpy(zero_copy_only=False).astype(bool)
            for first, _, words, word in _words(batch.column(text)):
                both = _keys(words, word)
                mine = flags[first + words.text]
                for kind, mask in ((1, mine), (0, ~mine)):
                    order = np.lexsort((words.text[mask], both[mask]))
                    key, text_of = both[mask][order], words.text[mask][order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])
                    known, docs = np.unique(key[new], return_counts=True)
                    if len(known):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(known.view(np.int64)), pa.array((docs * kind).astype(np.int32)), pa.array((docs * (1 - kind)).astype(np.int32)),
                        ], ["pair", "toxic", "ordinary"])

    found = labelled.select(text, F.col(toxic).cast("int").alias(toxic)).mapInArrow(pairs, "pair BIGINT, toxic INT, ordinary INT")
    return found.groupBy("pair").agg(F.sum("toxic").alias("docs_toxic"), F.sum("ordinary").alias("docs_ordinary"))


def word_ratios(pairs: DataFrame, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> tuple[DataFrame, float]:
    """key, ratio, docs and a number: what a word's log-likelihood under the toxic model minus that under the ordinary one is made of.

    It is the sum of the number, which is that of a word whose counts are taken off whole, and of the ratios of three keys, if
    they are there: of the word (0 as word before it), of the word before it (0 as word), and of both.
    """
    word, before = F.shiftrightunsigned("pair", 24), F.col("pair").bitwiseAND(F.lit((1 << 24) - 1).cast("bigint"))
    counts = materialize(pairs.groupBy(word.alias("word")).agg(
        F.count(F.when(F.col("docs_toxic") > 0, 1)).alias("n_toxic"), F.count(F.when(F.col("docs_ordinary") > 0, 1)).alias("n_ordinary")
    ), "counts")
    off = lambda n, most: F.least(F.col(n), F.lit(most))
    total = counts.agg(
        F.sum("n_toxic").alias("t"), F.sum("n_ordinary").alias("o"), F.sum(off("n_toxic", discount)).alias("off_t"), F.sum(off("n_ordinary", discount)).alias("off_o")
    ).head()
    if not total.t or not total.o:
        return pairs.select(F.col("pair").alias("key"), F.lit(0.0).alias("ratio"), F.lit(0).cast("bigint").alias("docs")).limit(0), 0.0
    rest = math.log(total.off_t / total.t) - math.log(total.off_o / total.o)
    shared = (F.col("n_toxic") + F.col("n_ordinary")) / F.lit(float(total.t + total.o))

    def single(n: str, size: int, mass: float) -> Column:
        return (F.col(n) - off(n, discount)) / F.lit(float(size)) + F.lit(mass / size) * shared

    single_t, single_o = single("n_toxic", total.t, total.off_t), single("n_ordinary", total.o, total.off_o)
    own = F.greatest("n_toxic", "n_ordinary") > discount
    rows = counts.where(own).select(
        F.shiftleft("word", 24).alias("key"), (F.log(single_t / single_o) - rest).alias("ratio"), (F.col("n_toxic") + F.col("n_ordinary")).alias("docs")
    )
    kept = bounded_broadcast(materialize(pairs.where(F.greatest("docs_toxic", "docs_ordinary") > pair_discount), "pairs"))
    behind = bounded_broadcast(materialize(kept.select(before.alias("known")).distinct(), "behind"))
    # What a class has seen behind a word, and how much of it is taken off; behind a word it has not seen, it backs off whole.
    context = pairs.select(before.alias("before"), "docs_toxic", "docs_ordinary").join(behind, F.col("before") == F.col("known"), "left_semi").groupBy("before").agg(
        F.sum("docs_toxic").alias("t"), F.sum("docs_ordinary").alias("o"),
        F.sum(off("docs_toxic", pair_discount)).alias("off_t"), F.sum(off("docs_ordinary", pair_discount)).alias("off_o"),
    )
    share = lambda mass, size: F.when(F.col(size) > 0, F.col(mass) / F.col(size)).otherwise(1.0)
    context = context.select("before", "t", "o", share("off_t", "t").alias("left_t"), share("off_o", "o").alias("left_o"))
    context = materialize(context, "contexts")
    rows = rows.unionAll(context.select("before", F.log(F.col("left_t") / F.col("left_o")), F.col("t") + F.col("o")))

    def seen(docs: str, size: str, left: str, one: Column) -> Column:
        return F.when(F.col(size) > 0, (F.col(docs) - off(docs, pair_discount)) / F.col(size)).otherwise(0.0) / (F.col(left) * one)

    both = kept.select("pair", word.alias("of"), before.alias("behind"), "docs_toxic", "docs_ordinary").join(counts, F.col("of") == F.col("word"))
    both = both.join(bounded_broadcast(context), F.col("behind") == F.col("before"))
    more = F.log1p(seen("docs_toxic", "t", "left_t", single_t)) - F.log1p(seen("docs_ordinary", "o", "left_o", single_o))
    return materialize(rows.unionAll(both.select("pair", more, F.col("docs_toxic") + F.col("docs_ordinary"))), "ratios"), rest


def _best(value: np.ndarray) -> float:
    """The largest sum of a stretch's ratios less its words' cost, 0 at least."""
    if not len(value):
        return 0.0
    upto = np.concatenate([np.zeros(1), np.cumsum(value - COST)])
    return float((upto - np.minimum.accumulate(upto)).max())


def _look_up(known: np.ndarray, ratio: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of each key, 0 if it is not in the sorted table, and whether it is."""
    if not len(known):
        return np.zeros(len(key)), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    found = known[at] == key
    return np.where(found, ratio[at], 0.0), found


def _scored(column: pa.Array, table):
    """For each text: the ratios of its words, and the keys that are not in the table with their places."""
    known, ratio, rest, slots = table
    for _, count, words, word in _words(column):
        both = _keys(words, word)
        value, others, places = np.full(len(word), rest), [], []
        for key in (word << _BEFORE_BITS, both & ((np.uint64(1) << _BEFORE_BITS) - np.uint64(1)), both):
            one, found = _look_up(known, ratio, key)
            value += one
            if slots is not None:
                at = np.flatnonzero(~found & ((slots[_slot(key)] >> (key >> np.uint64(24)) % np.uint64(64)) & np.uint64(1)).astype(bool))
                others.append(key[at].view(np.int64))
                places.append(at)
        ends = np.cumsum(count)
        if slots is not None:
            order = np.argsort(np.concatenate(places), kind="stable")
            other, place = np.concatenate(others)[order], np.concatenate(places)[order]
            cut = np.concatenate([np.zeros(1, np.int64), np.searchsorted(place, ends)])
        for i, (end, n) in enumerate(zip(ends, count)):
            if slots is None:
                yield value[end - n : end], (), ()
            else:
                yield value[end - n : end], other[cut[i] : cut[i + 1]], place[cut[i] : cut[i + 1]] - (end - n)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key ^ (key >> np.uint64(40))) % np.uint64(SLOTS)).astype(np.int64)


def _margins(docs: DataFrame, table, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and margin: the best stretch of a text, 0 for a text without words."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.array([_best(value) for value, _, _ in _scored(batch.column(text), table.value)], float)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(margin)], [*keep, "margin"])

    return docs.select(*keep, text).mapInArrow(run, f"{fields}, margin DOUBLE")


def _joined_margins(docs: DataFrame, table, more: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """As _margins, for a model of which only a part is in ``table``; the other rows, ``more``, are joined.

    Only keys that may be among these rows travel, each with its place; a text without one is done in the first pass.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            margin, values, others, places = [], [], [], []
            for value, other, place in _scored(batch.column(text), table.value):
                margin.append(_best(value))
                values.append(value if len(other) else value[:0])
                others.append(other)
                places.append(place.astype(np.int32))
            rows = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [
                    pa.array(rows), pa.array(margin, pa.float64()), pa.array(values, pa.list_(pa.float64())),
                    pa.array(others, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())),
                ], [*keep, "_at", "margin", "_values", "_others", "_places"],
            )

    parts = materialize(docs.select(*keep, text).mapInArrow(
        run, f"{fields}, _at BIGINT, margin DOUBLE, _values ARRAY<DOUBLE>, _others ARRAY<BIGINT>, _places ARRAY<INT>"
    ), "parts")
    spread = parts.select("_at", F.explode(F.arrays_zip("_others", "_places")).alias("_of")).select("_at", F.col("_of._others").alias("key"), F.col("_of._places").alias("place"))
    found = spread.join(more.select("key", "ratio"), "key").groupBy(F.col("_at").alias("_found_at")).agg(F.array_sort(F.collect_list(F.struct("place", "ratio"))).alias("_found"))
    found = found.select("_found_at", F.col("_found.place").alias("_where"), F.col("_found.ratio").alias("_more"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
            values, where, more_of = (batch.column(n) for n in ("_values", "_where", "_more"))
            for i in np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False)):
                value = values[i].values.to_numpy(zero_copy_only=False).copy()
                np.add.at(value, where[i].values.to_numpy(zero_copy_only=False), more_of[i].values.to_numpy(zero_copy_only=False))
                margin[i] = _best(value)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(margin)], [*keep, "margin"])

    joined = parts.join(found, F.col("_at") == F.col("_found_at"), "left").select(*keep, "margin", "_values", "_where", "_more")
    return joined.mapInArrow(mend, f"{fields}, margin DOUBLE")


def _curve(labelled: DataFrame, toxic: str) -> tuple[float, float, float]:
    """scale, slope, offset of the logistic curve, from counts on a fixed number of steps of the margin."""
    middle = labelled.where(F.col(toxic) == 1).agg(F.percentile_approx("margin", 0.5, 1000)).head()[0]
    scale = float(middle) if middle and middle > 0 else 1.0
    step = F.round(F.greatest(F.least(F.col("margin") / scale, F.lit(2.0)), F.lit(-2.0)) * (STEPS // 4)).cast("int")
    rows = labelled.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(toxic).cast("int")).alias("k")).collect()
    if not rows:
        return scale, 0.0, -2.0
    x = np.array([r.step for r in rows]) / (STEPS // 4)
    n, k = np.array([r.n for r in rows], float), np.array([r.k for r in rows], float)
    design, weights = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([1e-5, 1e-7]) * n.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (k - n * p) - ridge @ weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(2)
        move = np.clip(np.linalg.solve(curve, slope), -5, 5)
        weights += move
        if np.abs(move).max() < 1e-9:
            break
    return scale, float(weights[0]), float(weights[1])


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """key, held_out, margin, score (0 to 1), predicted for every row of ``docs``.

    Models and curve are learnt from all rows whose key has a label and a remainder other than HELD; a key with
    several labels counts as toxic if one says so. Rows with a null key or label are not learnt from, and a null key
    is not held out. Null, empty and wordless texts have the margin 0 and the score of a text that says nothing.
    Without labels of both classes every margin is 0.
    """
    spark = docs.sparkSession
    train = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(key))).groupBy(
        F.col(key).alias("_label_key")
    ).agg(F.max(F.col(toxic).cast("int")).alias("_label"))
    train = bounded_broadcast(materialize(train, "labels"))
    labelled = docs.join(train, F.col(key) == F.col("_label_key")).select(F.col(text).alias("text"), F.col("_label").alias("toxic"))
    ratios, rest = word_ratios(materialize(count_pairs(labelled), "pairs"))
    whole = ratios.count() <= BROADCAST_WORDS
    # The order is total, so that the rows left to join are the others.
    first = ratios if whole else materialize(ratios.orderBy(F.desc("docs"), "key").limit(BROADCAST_WORDS), "first")
    found = first.select("key", "ratio").toArrow()
    known, slots = found.column("key").to_numpy().view(np.uint64), None
    order = np.argsort(known)
    if not whole:
        more = materialize(ratios.join(first.select("key"), "key", "left_anti").select("key", "ratio"), "more")
        slot = F.pmod(F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 40)), F.lit(SLOTS))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned("key", 24), F.lit(64)).cast("int"))
        bits = more.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
        slots = np.zeros(SLOTS, np.uint64)
        slots[bits.column("slot").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    table = spark.sparkContext.broadcast((known[order], found.column("ratio").to_numpy()[order], rest, slots))
    margins = _margins(docs, table, text, [key]) if whole else _joined_margins(docs, table, more, text, [key])
    margins = materialize(margins, "margins")
    known = margins.join(train, F.col(key) == F.col("_label_key")).select("margin", F.col("_label").alias("toxic"))
    scale, slope, offset = _curve(known, "toxic")
    line = F.greatest(F.least(F.col("margin") / scale, F.lit(2.0)), F.lit(-2.0)) * slope + offset
    value = 1 / (1 + F.exp(-line))
    return margins.select(
        key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "margin", value.alias("score"),
        F.when(value >= TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )
