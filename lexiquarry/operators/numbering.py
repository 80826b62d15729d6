"""Row numbers and running sums over groups of any size.

A window over a group sends the group to one task. Here the groups are cut
into ranges of the order key first: a sum per range gives each range its
offset, and only the rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Keys per range that are looked at to place the bounds.
SAMPLE_KEYS = 50


def _comparable(df: DataFrame, column: str) -> Column:
    """The column itself, or a number that grows with it: dates and times as literals depend on the session."""
    kind = df.schema[column].dataType.typeName()
    if kind == "date":
        return F.unix_date(column)
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def _ranged(df: DataFrame, order_by: str, ranges: int | None) -> DataFrame:
    """Add ``_range``, increasing with the order key. Only a sample of keys, to place the bounds, reaches the driver.

    Bounds are whole keys of any type, so keys with a common beginning are
    told apart; nulls are in the first range, NaN in the last.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = _comparable(df, order_by)
    keys = df.select(key.alias("k")).where("k IS NOT NULL")
    sample = [r.k for r in keys.orderBy(F.rand(11)).limit(SAMPLE_KEYS * ranges).sort("k").collect()] if ranges > 1 else []
    cuts: list = []
    for i in range(1, ranges):
        if sample and (not cuts or sample[i * len(sample) // ranges] != cuts[-1]):
            cuts.append(sample[i * len(sample) // ranges])

    def place(low: int, high: int) -> Column:
        """The number of bounds up to the key, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    return df.withColumn("_range", F.when(key.isNull(), 0).otherwise(place(0, len(cuts))).cast("int"))


def _with_offsets(ranged: DataFrame, keys: list[str], weight: Column, total: str | None) -> DataFrame:
    """Join to each row the weight of all earlier ranges of its group (and of the whole group)."""
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"))
    # One row per group and range.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    same = F.col("o._range") == F.col("r._range")
    for key in keys:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}"))
    extra = [F.col(f"o.{total}").alias(total)] if total else []
    return ranged.alias("r").join(offsets.alias("o"), same).select("r.*", F.col("o._offset"), *extra)


def number_rows(
    df: DataFrame,
    order_by: str,
    partition_by: list[str] | None = None,
    name: str = "rn",
    total: str | None = None,
    ties: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``name`` = 1, 2, ... by ``order_by`` (then ``ties``) within ``partition_by``.

    ``total`` names an extra column with the size of the group. The order key
    should be nearly unique within a group, since equal keys share a range.
    """
    keys = list(partition_by or [])
    placed = _with_offsets(_ranged(df, order_by, ranges), keys, F.lit(1), total)
    within = Window.partitionBy(*keys, "_range").orderBy(order_by, *(ties or []))
    return placed.withColumn(
        name, (F.col("_offset") + F.row_number().over(within)).cast("bigint")
    ).drop("_offset", "_range")


def running_sum(
    df: DataFrame,
    order_by: str,
    weight: str,
    partition_by: list[str] | None = None,
    name: str = "cumulative",
    total: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over the rows up to this one within ``partition_by``."""
    keys = list(partition_by or [])
    placed = _with_offsets(_ranged(df, order_by, ranges), keys, F.col(weight), total)
    within = Window.partitionBy(*keys, "_range").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.col("_offset") + F.sum(weight).over(within)).drop("_offset", "_range")
