import random

from pyspark.sql import functions as F

from lexiquarry.operators.metrics import exact_quantile
from lexiquarry.operators.numbering import number_rows, running_sum


def test_hot_group_is_numbered_in_ranges(spark):
    rows = [("hot", i * 3 % 1009) for i in range(1009)] + [("cold", 5), ("cold", 2), (None, 9)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int")
    out = number_rows(df, "k", ["g"], total="n", ranges=16).collect()
    by_group = {}
    for r in out:
        by_group.setdefault(r.g, []).append((r.rn, r.k, r.n))
    assert [k for _, k, _ in sorted(by_group["hot"])] == list(range(1009))
    assert [rn for rn, _, _ in sorted(by_group["hot"])] == list(range(1, 1010))
    assert sorted(by_group["cold"]) == [(1, 2, 2), (2, 5, 2)] and by_group[None] == [(1, 9, 1)]


def test_order_by_text_time_and_date(spark):
    words = sorted({f"{random.Random(i).randrange(10**6):x}é" for i in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = sorted((r.rn, r.w) for r in number_rows(df, "w", ranges=9).collect())
    assert [w for _, w in out] == words and [n for n, _ in out] == list(range(1, len(words) + 1))
    times = spark.range(100).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 61)).alias("t"), "id")
    assert all(r.rn == r.id + 1 for r in number_rows(times, "t").collect())
    days = spark.range(50).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"), "id")
    assert all(r.rn == r.id + 1 for r in number_rows(days, "d").collect())


def test_single_row_and_empty(spark):
    assert number_rows(spark.range(1), "id").collect()[0].rn == 1
    assert number_rows(spark.range(0), "id").count() == 0


def test_running_sum(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("w"))
    out = {r.id: r.cumulative for r in running_sum(df, "id", "w", total="t").collect()}
    assert all(out[i] == sum(j % 7 for j in range(i + 1)) for i in range(200))


def test_exact_quantile_with_a_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 0.0).otherwise(F.col("id").cast("double")).alias("value"))
    for q in (0.0, 0.25, 0.6, 0.95, 1.0):
        want = df.agg(F.percentile("value", q)).head()[0]
        assert abs(exact_quantile(df, q).head().quantile - want) < 1e-9


def test_keys_with_a_common_beginning_are_spread(spark):
    from lexiquarry.operators.numbering import _ranged

    keys = spark.range(4000).select(F.concat(F.lit("https://example.org/"), F.hex(F.xxhash64("id"))).alias("k"))
    sizes = [r["count"] for r in _ranged(keys, "k", 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_nan_and_null_have_places(spark):
    values = [3.0, float("nan"), None, 1.0, float("inf"), float("-inf"), 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [repr(r.v) for r in number_rows(df, "v", ranges=4).orderBy("rn").collect()]
    assert got == ["None", "-inf", "1.0", "2.0", "3.0", "inf", "nan"]
