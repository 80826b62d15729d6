"""Metrics over ``events``: batch forms and the same as streams."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..params import RESPONSE_BOUNDS, RETRIEVAL_BOUNDS
from ..session import work_path
from ..streaming import metrics as X
from .registry import query, table, table_stream


def latency(spark, folder):
    """Values as seconds; times are read as UTC, as in the SQL."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, folder, "events").withColumn("seconds", F.col("value") / 10).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def _le(column):
    return F.when(column == float("inf"), "+Inf").otherwise(column.cast("string"))


def _bounds_sql(bounds):
    return "[" + ", ".join("'infinity'::DOUBLE" if b == float("inf") else f"{b}::DOUBLE" for b in bounds) + "]"


def _histogram_sql(bounds):
    return f"""
    SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END AS le, count(*) FILTER (value / 10 <= le) AS cumulative
    FROM events, (SELECT unnest({_bounds_sql(bounds)}) AS le) GROUP BY event_type, le"""


@query("latency_histogram", _histogram_sql(RESPONSE_BOUNDS))
def latency_histogram(spark, folder):
    hist = M.latency_histogram(latency(spark, folder), "seconds", RESPONSE_BOUNDS, ["event_type"])
    return hist.withColumn("le", _le(F.col("le")))


@query("retrieval_histogram", _histogram_sql(RETRIEVAL_BOUNDS))
def retrieval_histogram(spark, folder):
    hist = M.latency_histogram(latency(spark, folder), "seconds", RETRIEVAL_BOUNDS, ["event_type"])
    return hist.withColumn("le", _le(F.col("le")))


def quantile_ctes(source, key, q):
    """CTEs ending in ``quantiles(key, quantile)``: interpolation inside the bucket of rank q * count."""
    finite = [b for b in RESPONSE_BOUNDS if b != float("inf")]
    return f"""
    bounds AS (SELECT unnest({_bounds_sql(RESPONSE_BOUNDS)}) AS le, unnest({[0.0, *finite]}::DOUBLE[]) AS low),
    hist AS (SELECT {key}, le, low, count(*) FILTER (s <= le) AS c, count(*) AS n FROM ({source}), bounds GROUP BY {key}, le, low),
    steps AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY {key} ORDER BY le), 0) AS below, {q} * n AS r FROM hist),
    quantiles AS (
      SELECT {key}, CASE WHEN isinf(le) THEN {finite[-1]}::DOUBLE WHEN c > below THEN low + (le - low) * (r - below) / (c - below) ELSE le END AS quantile, n
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY le) AS place FROM steps WHERE c >= r) WHERE place = 1
    )"""


@query("histogram_quantile", f"""
    WITH {quantile_ctes('SELECT event_type, value / 10 AS s FROM events', 'event_type', 0.3)}
    SELECT event_type, round(quantile, 6) AS quantile FROM quantiles""")
def histogram_quantile(spark, folder):
    sums = M.bucket_sums(latency(spark, folder), "seconds", RESPONSE_BOUNDS, ["event_type"])
    return M.histogram_quantile(sums, 0.3, RESPONSE_BOUNDS, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


@query("exact_quantile", "SELECT event_type, round(quantile_cont(value / 10, 0.95), 6) AS quantile FROM events GROUP BY event_type")
def exact_quantile(spark, folder):
    return M.exact_quantile(latency(spark, folder), 0.95, "seconds", ["event_type"]).withColumn(
        "quantile", F.round("quantile", 6)
    )


START = "time_bucket(INTERVAL '5 minutes', ts)"


def _stamp(df):
    """Window bounds as text, so both engines print them alike."""
    for name in ("window_start", "window_end"):
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return df


RATE = f"""
    SELECT strftime({START}, '%Y-%m-%d %H:%M:%S') AS window_start, strftime({START} + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
           count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM events"""


@query("request_rate", f"{RATE} GROUP BY {START}")
def request_rate(spark, folder):
    return _stamp(M.request_rate(latency(spark, folder))).withColumn("per_second", F.round("per_second", 6))


@query("request_rate_sliding", """
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
           count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS per_second
    FROM (SELECT unnest(list_transform(range(0, 5), lambda i: time_bucket(INTERVAL '1 minute', ts) - to_minutes(i))) AS s FROM events) GROUP BY s""")
def request_rate_sliding(spark, folder):
    rate = M.request_rate(latency(spark, folder), "5 minutes", "1 minute")
    return _stamp(rate).withColumn("per_second", F.round("per_second", 6))


@query("documents_added", """
    SELECT event_type, count(*) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type""")
def documents_added(spark, folder):
    return M.documents_added(latency(spark, folder)).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("running_total", """
    SELECT strftime(d, '%Y-%m-%d') AS period, n AS added, sum(n) OVER (ORDER BY d)::BIGINT AS total
    FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1)""")
def running_total(spark, folder):
    return M.running_total(latency(spark, folder)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


# ---- streams ----------------------------------------------------------------------------

CLOSED = f"{START} + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


def _stream(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("seconds", F.col("value") / 10)


@query("stream_request_rate", f"{RATE} WHERE {CLOSED} GROUP BY {START}")
def stream_request_rate(spark, folder):
    out, mark = work_path(spark, "rate"), work_path(spark, "rate-checkpoint")
    done = X.run_to_parquet(X.stream_request_rate(_stream(spark, folder)), out, mark)
    return _stamp(done).withColumn("per_second", F.round("per_second", 6))


@query("latency_p95_stream", f"""
    WITH {quantile_ctes(f"SELECT {START} AS w, value / 10 AS s FROM events WHERE {CLOSED}", 'w', 0.95)}
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
           n AS count, round(quantile, 6) AS quantile FROM quantiles""")
def latency_p95_stream(spark, folder):
    out, mark = work_path(spark, "p95"), work_path(spark, "p95-checkpoint")
    stream = X.stream_latency_quantile(_stream(spark, folder), 0.95, value_col="seconds")
    return _stamp(X.run_to_parquet(stream, out, mark)).withColumn("quantile", F.round("quantile", 6))


@query("documents_added_stream", """
    SELECT event_type, count(*) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type""")
def documents_added_stream(spark, folder):
    out, mark = work_path(spark, "added"), work_path(spark, "added-checkpoint")
    done = X.run_complete(X.stream_documents_added(_stream(spark, folder)), out, mark)
    return done.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))
