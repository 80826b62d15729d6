"""Service metrics over event rows: histograms, quantiles, rates, totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..params import RESPONSE_BOUNDS
from ..session import materialize
from .numbering import running_sum


def _bound_columns(value: Column, bounds) -> list[Column]:
    return [
        F.sum(F.when(value <= F.lit(float(b)), 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(bounds)
    ]


def bucket_sums(df: DataFrame, value_col: str, bounds=RESPONSE_BOUNDS, keys=()) -> DataFrame:
    """One row per group with a cumulative count per bound; sums only, so it also works on streams."""
    value = F.col(value_col)
    return df.where(value.isNotNull()).groupBy(*keys).agg(
        *_bound_columns(value, bounds), F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum")
    )


def to_buckets(sums: DataFrame, bounds=RESPONSE_BOUNDS, keys=()) -> DataFrame:
    """Rows (keys, le, cumulative) of ``bucket_sums``."""
    pairs = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)
    ])
    return sums.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.le", "p.cumulative")


def latency_histogram(df: DataFrame, value_col: str = "value", bounds=RESPONSE_BOUNDS, keys=()) -> DataFrame:
    """Cumulative counts (keys, le, cumulative) of values up to each bound."""
    return to_buckets(bucket_sums(df, value_col, bounds, keys), bounds, keys)


def histogram_quantile(sums: DataFrame, q: float, bounds=RESPONSE_BOUNDS, keys=()) -> DataFrame:
    """Quantile by linear interpolation in the bucket it falls into: (keys, quantile).

    Above the last finite bound the quantile is that bound. An expression over
    the row of one group; nothing is shuffled.
    """
    if not math.isinf(bounds[-1]):
        raise ValueError("the last bound must be infinity")
    rank = F.lit(q) * F.col("count")
    finite = [float(b) for b in bounds[:-1]]
    value = F.lit(finite[-1])
    for i in range(len(finite) - 1, -1, -1):
        low = finite[i - 1] if i else 0.0
        below = F.col(f"_b{i - 1}") if i else F.lit(0)
        inside = F.col(f"_b{i}") - below
        here = F.when(inside > 0, low + (finite[i] - low) * (rank - below) / inside).otherwise(F.lit(finite[i]))
        value = F.when(F.col(f"_b{i}") >= rank, here).otherwise(value)
    return sums.select(*keys, F.when(F.col("count") > 0, value).alias("quantile"))


def exact_quantile(df: DataFrame, q: float, value_col: str = "value", keys=()) -> DataFrame:
    """Exact quantile per group, interpolated between neighbouring values.

    Values are counted before the shuffle and ranked in ranges, so neither a
    hot group nor a hot value has to fit into one task.
    """
    keys = list(keys)
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("_n"))
    # Read three times below: for the ranges, their sums and the rows.
    counts = materialize(counts, "value-counts")
    ranked = running_sum(counts, value_col, "_n", keys, "_upto", "_total")
    place = F.lit(q) * (F.col("_total") - 1)
    value = F.col(value_col)
    ends = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor(place), value)).alias("_low"),
        F.min(F.when(F.col("_upto") > F.ceil(place), value)).alias("_high"),
        F.max(place - F.floor(place)).alias("_part"),
    )
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))


def request_rate(events: DataFrame, window: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Requests and requests per second by window; the input may be a stream."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = events.groupBy(frame).agg(F.count(F.lit(1)).alias("requests"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests",
        (F.col("requests") / seconds).alias("per_second"),
    )


def latency_quantile_by_window(
    events: DataFrame, q: float = 0.95, window: str = "5 minutes", value_col: str = "value",
    bounds=RESPONSE_BOUNDS, ts: str = "ts",
) -> DataFrame:
    """Quantile per window from bucket counts; the input may be a stream."""
    framed = events.where(F.col(value_col).isNotNull()).groupBy(F.window(ts, window)).agg(
        *_bound_columns(F.col(value_col), bounds), F.count(F.lit(1)).alias("count")
    )
    flat = framed.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end"))
    return histogram_quantile(flat, q, bounds, ["window_start", "window_end", "count"])


def documents_added(events: DataFrame, keys=("event_type",), ts: str = "ts") -> DataFrame:
    """Documents so far, with the time of the last one; also as a running stream aggregate."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.max(ts).alias("last_ts"))


def running_total(events: DataFrame, period: str = "day", ts: str = "ts") -> DataFrame:
    """Documents added up to the end of each period."""
    per = events.groupBy(F.date_trunc(period, F.col(ts)).alias("period")).agg(F.count(F.lit(1)).alias("added"))
    return running_sum(per, "period", "added", name="total")
