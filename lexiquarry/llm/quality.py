"""Quality rules whose thresholds adapt to each language and source.

Per text, fixed measures are counted in one pass. For the rules that adapt, the values of every (language, source)
go into a mergeable quantile sketch: counts in buckets of constant relative width, so that sketches of parts of a
corpus add up to the sketch of the whole, in any order, with a known relative error. The thresholds read from the
sketches are joined back by (language, source), and a document that lies far outside of its group is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import bounded_broadcast, fresh
from .words import SPACE, Texts, mixed, runs, span_hashes, spans, windows, words_of

#: Fixed: characters that count as symbols, the window, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Relative error of a quantile read from a sketch.
ACCURACY = 0.01
#: Values below this are one bucket.
LEAST = 1e-4
#: A value is far outside if it is beyond the median (the word length: the quartile) by this many times the distance between the quartiles, ...
FENCE = 6.0
#: ... where that distance counts as this much at least, by measure; measures are ratios but for the word length, ...
SPREAD = {"symbol_ratio": 0.02, "dup_line_ratio": 0.05, "repeat_ratio": 0.02, "word_length": 0.5}
#: ... and, for ratios, as this many times that much at most, so that a group full of junk does not lift its own fence.
MOST_SPREAD = 4
#: Measures of which low values count as far outside too.
TWO_SIDED = ("word_length",)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

MEASURES = pa.schema(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
)


def _measure(texts: Texts) -> list[np.ndarray]:
    words = words_of(texts)
    n_words = np.diff(words.first)
    solid = ~SPACE[texts.data]
    chars = texts.per_text(solid & ((texts.data & 0xC0) != 0x80))
    symbols = texts.per_text(_SYMBOL[texts.data])
    lines = spans(texts, texts.data != 0x0A)
    total = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    full = np.flatnonzero(total[lines.end] > total[lines.start])
    owner = lines.text[full].astype(np.uint64)
    keys = span_hashes(texts.data, lines.start[full], lines.end[full]) ^ mixed(owner + np.uint64(1))
    first = np.unique(keys, return_index=True)[1]
    n_lines = np.bincount(lines.text[full], minlength=len(texts))
    dup_lines = n_lines - np.bincount(lines.text[full][first], minlength=len(texts))
    value, at = windows(words, span_hashes(texts.data, words.start, words.end), WINDOW)
    repeat = np.zeros(len(texts), np.int64)
    if len(value):
        keys = value ^ mixed(words.text[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeat = np.bincount(words.text[covered], minlength=len(texts))
    return [n_words, chars, symbols, n_lines, dup_lines, repeat]


def with_measures(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words, in place of the text or beside it.

    Whole texts count. A null or empty text has zero everywhere. Columns of ``docs`` with one of these names are
    replaced.
    """
    names = list(MEASURES.names)
    rest = docs.drop(*[n for n in names if n in docs.columns and n != text])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if keep_text or f.name != text]
    out = ", ".join(fields + [f"{n} BIGINT" for n in names])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(t) for t in runs(batch.column(text))]
            found = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(names))]
            kept = [n for n in batch.schema.names if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(x) for x in found], kept + names)

    return rest.mapInArrow(measure, out)


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def quantile_sketches(values: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """Counts per bucket: keys, bucket, n. Sketches merge by adding the counts of equal buckets.

    Bucket b holds the values in (g**(b-1), g**b] with g = (1+a)/(1-a); values up to LEAST are in one bucket below.
    """
    growth = np.log((1 + accuracy) / (1 - accuracy))
    low = int(np.floor(np.log(LEAST) / growth)) - 1
    bucket = F.when(F.col(value) <= LEAST, F.lit(low)).otherwise(F.ceil(F.log(value) / F.lit(growth)).cast("int"))
    return values.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """Quantiles of each key from its sketch. A sketch has a bounded number of buckets, whatever it has counted."""
    growth = np.log((1 + accuracy) / (1 - accuracy))
    low = int(np.floor(np.log(LEAST) / growth)) - 1
    by = Window.partitionBy(*keys)
    seen = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.when(F.col("bucket") == low, F.lit(0.0)).otherwise(F.exp(F.col("bucket") * growth) * (1 - accuracy))
    counted = sketches.withColumns({"seen": seen, "all": F.sum("n").over(by), "middle": middle})
    return counted.groupBy(*keys).agg(
        *[F.min(F.when(F.col("seen") >= F.col("all") * q, F.col("middle"))).alias(name) for name, q in at.items()],
        F.max("all").alias("n_group"),
    )


def thresholds(measured: DataFrame, keys: list[str], fence: float = FENCE) -> DataFrame:
    """Per group one row with <measure>_high, and <measure>_low for the two-sided ones."""
    ratios = _ratios()
    sound = measured.where((F.col("n_words") >= MIN_WORDS) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * MAX_REPEAT_PERCENT))
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in ratios.items()])
    long = sound.select(*keys, F.inline(pairs))
    read = sketch_quantiles(
        quantile_sketches(long, [*keys, "measure"], "value"), [*keys, "measure"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    )
    spread = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])[F.col("measure")]
    between = F.col("q3") - F.col("q1")
    bounded = F.when(F.col("measure").isin(*TWO_SIDED), between).otherwise(F.least(between, spread * MOST_SPREAD))
    width = F.greatest(bounded, spread) * fence
    return read.withColumn("width", width).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("q3" if m in TWO_SIDED else "q2") + F.col("width"))).alias(f"{m}_high") for m in ratios],
        *[F.max(F.when(F.col("measure") == m, F.col("q1") - F.col("width"))).alias(f"{m}_low") for m in TWO_SIDED],
    )


def group_limits(measured: DataFrame, lang: str = "lang", source: str = "source", fence: float = FENCE) -> DataFrame:
    """The thresholds of every (language, source), written."""
    keyed = measured.select(*MEASURES.names, F.col(lang).alias("_lq_lang"), F.col(source).alias("_lq_source"))
    limits = materialize(thresholds(keyed, ["_lq_lang", "_lq_source"], fence), "thresholds")
    inner = [c for c in limits.columns if c not in ("_lq_lang", "_lq_source")]
    return bounded_broadcast(limits).select("_lq_lang", "_lq_source", F.struct(*inner).alias("_lq_limits"))


def verdicts(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with base_failed and kept."""
    joined = measured.join(
        limits, F.col(lang).eqNullSafe(F.col("_lq_lang")) & F.col(source).eqNullSafe(F.col("_lq_source")), "left"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    far = F.lit(False)
    for name, value in _ratios().items():
        far = far | F.coalesce(value > F.col(f"_lq_limits.{name}_high"), F.lit(False))
        if name in TWO_SIDED:
            far = far | F.coalesce(value < F.col(f"_lq_limits.{name}_low"), F.lit(False))
    return joined.select(
        *[c for c in measured.columns if c not in ("base_failed", "kept")], failed.alias("base_failed"), (~failed & ~far).alias("kept")
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed and kept.

    ``base_failed``: fewer than 10 words, or over 20 percent of them in repeated windows. ``kept`` is false if
    base_failed, or if a ratio is beyond the fence of the document's (language, source). Null languages and sources
    are groups of their own; with no group to compare with, only the base rules count. Rows are judged one by one, so
    repeated rows get equal verdicts. An empty table gives an empty result.
    """
    measured = materialize(with_measures(docs, text), "quality")
    return verdicts(measured, group_limits(measured, lang, source, fence), lang, source)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE) -> DataFrame:
    """The rows and columns of ``docs`` that ``judge`` keeps. Texts are measured again, which is cheaper than moving them.

    Columns that are named like a measure keep their own values.
    """
    made = {*MEASURES.names, "base_failed", "kept", "_lq_lang", "_lq_source", "_lq_limits"}
    aside = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c in made}
    rows = docs.withColumnsRenamed(aside)
    text, lang, source = (aside.get(c, c) for c in (text, lang, source))
    measured = materialize(with_measures(rows.select(text, lang, source), text), "quality")
    limits = group_limits(measured, lang, source, fence)
    kept = verdicts(with_measures(rows, text, keep_text=True), limits, lang, source).where("kept")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
