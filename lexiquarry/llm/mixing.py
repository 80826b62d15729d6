"""Mixing sources to target weights by capped water-filling.

A source may be repeated at most ``most_epochs`` times. Sources whose share by weight is more than that stop there, and
what they leave goes to the others by weight, until no source is above its cap. A source that gets 2.4 times its size
gives every document twice and a seeded 0.4 of its words once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import bounded_broadcast, fresh, seeded_bits

#: Fixed: what a word is, the weights in turn, and the most repetitions.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 17

#: Levels of 10 bits each in which the cut of a source is found; together the bits of ``seeded_bits``.
_SHIFTS = (20, 10, 0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def turn_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: sources in code-point order, null last, weigh ``weights`` in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    )


def water_fill(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to source, source_size, weight: the share by weight, at most ``most_epochs`` sizes.

    In the order of cap over weight, the sources before the first one that stays below its cap are full; the others
    share the rest by weight. That is where passing the excess on, again and again, ends.
    """
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    cap = (F.col("source_size") * most_epochs).cast("double")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sources.withColumn("_cap", cap)
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
        .withColumns({"_level": level, "_place": F.row_number().over(order)})
        .withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_place", "_level"))).over(every))
        .withColumn("target", F.when(
            F.col("_place") >= F.col("_first._place"), F.least(F.col("_first._level") * F.col("weight"), F.col("_cap"))
        ).otherwise(F.col("_cap")))
        .drop("_cap", "_full_at", "_level", "_place", "_first")
    )


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the number below which a document's seeded bits give it one more copy.

    The seeded bits put the documents of a source into a random order. Sums of sizes per cell of that order, in three
    levels of 1,024 cells, find the cell in which the wanted words are reached. So a source with a third of all
    documents is neither sorted nor brought together.
    """
    state = plan.select(
        F.col("source").alias("of"), F.col("part"), F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("cell")
    ).where(F.col("part") > 0)
    for shift in _SHIFTS:
        state = bounded_broadcast(materialize(state, "cut"))
        cell = F.shiftright("bits", shift)
        sums = (
            sized.join(state, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bits", shift + 10) == F.col("cell")))
            .groupBy("of", "part", "below", cell.alias("next")).agg(F.sum("size").alias("inside"))
        )
        run = F.sum("inside").over(Window.partitionBy("of").orderBy("next")) - F.col("inside")
        state = (
            sums.withColumn("start", F.col("below") + run).where((F.col("start") < F.col("part")) | (F.col("start") == 0))
            .groupBy("of", "part").agg(F.max(F.struct("next", "start", "inside")).alias("at"))
            .select("of", "part", F.col("at.start").alias("below"), F.col("at.next").alias("cell"), F.col("at.inside").alias("inside"))
        )
    nearer = F.abs(F.col("below") + F.col("inside") - F.col("part")) <= F.abs(F.col("below") - F.col("part"))
    return state.select(F.col("of").alias("cut_of"), (F.col("cell") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target (both of the source) and copies: how often the mix takes the document.

    The words taken from a source differ from its target by at most half of one document (of the documents with one
    key, which are taken together). Null texts have size 0 and a null source is a source. The same key and seed give
    the same choice in any run. Columns of ``docs`` with one of the new names are replaced.
    """
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "copies") if c in docs.columns and c not in (text, source, key)])
    bits = fresh(docs, "_mix_bits")
    sized = materialize(
        docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"), seeded_bits(F.col(key), seed).alias("bits")),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(turn_weights(sources, weights), most_epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = materialize(
        plan.withColumn("times", times).withColumn("part", F.col("target") - F.col("times") * F.col("source_size")), "mix"
    )
    cuts = _cuts(sized, plan)
    plan = bounded_broadcast(materialize(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_of")), "left").select(
            F.col("source").alias("_mix_source"), F.struct("source_size", "target", "times", F.coalesce("cut", F.lit(0)).alias("cut")).alias("_mix")
        ), "mix",
    ))
    joined = docs.withColumn(bits, seeded_bits(F.col(key), seed)).join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
    more = F.when(F.col(bits) < F.col("_mix.cut"), 1).otherwise(0)
    return joined.select(
        *docs.columns, size_of(F.col(text)).alias("size"), F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"), (F.col("_mix.times") + more).cast("bigint").alias("copies"),
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes; documents with no copy go."""
    return mixed.where(F.col("copies") > 0).withColumn(
        fresh(mixed, "_copy"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    ).select(*columns)
