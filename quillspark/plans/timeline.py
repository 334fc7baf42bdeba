"""Queries over time: as-of, interval and window operators, and their streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.band import overlapping, within_bounds
from quillspark.operators.temporal import as_timestamp, asof, sessions, within
from quillspark.sources.tables import shared_dir, table
from quillspark.streaming import windows as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p.event_id, p.user_id, v.event_id AS seen_event_id FROM (FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, d):
    """For each purchase the user's last view before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought, viewed = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    return asof(bought, viewed, "user_id", "ts", "ts", ["event_id"], "seen_").select("event_id", "user_id", "seen_event_id")


@query("""SELECT e.event_id AS error_id, v.event_id AS view_id FROM events e JOIN events v ON v.event_type = 'view' AND e.event_type = 'error' AND v.ts >= e.ts AND v.ts < e.ts + INTERVAL 20 MINUTE""")
def interval_join(spark, d):
    """Views within twenty minutes after each error, by slots of time."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("us").alias("start"), (F.col("us") + 1_200_000_000).alias("end"))
    points = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "us")
    return within(points, spans, "us", "start", "end", 1_200_000_000).select("error_id", "view_id")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_acctbal >= s_acctbal - 25 AND c_acctbal <= s_acctbal + 25")
def band_join(spark, d):
    """Customers whose balance is within 25 of a supplier's: two inequalities, by ranges of the balances."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return within_bounds(s, table(spark, d, "customer").select("c_custkey", "c_acctbal"), "low", "high", "c_acctbal").select("s_suppkey", "c_custkey")


@query("""SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM events e JOIN events p ON e.event_type = 'error' AND p.event_type = 'purchase' AND e.ts <= p.ts + INTERVAL 3 MINUTE AND p.ts <= e.ts + INTERVAL 10 MINUTE""")
def overlap_join(spark, d):
    """Ten minutes after an error and three after a purchase, where they overlap."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").alias("start"))
    span = lambda kind, length, name: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "start", (F.col("start") + F.expr(f"interval {length}")).alias("end"))
    return overlapping(span("error", "10 minutes", "error_id"), span("purchase", "3 minutes", "purchase_id"), "start", "end").select("error_id", "purchase_id")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query("""SELECT CAST(started AS TIMESTAMP) AS started, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS started FROM events) GROUP BY 1""")
def sliding_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("started"), "n")


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CAST(gap IS NULL OR gap >= INTERVAL 6 HOUR AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s
FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


def _fresh(spark: SparkSession) -> tuple[str, str]:
    """A folder for a stream's checkpoint and one for its rows, in the folder that all executors share."""
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{own}/checkpoint", f"{own}/rows"


CLOSED = """SELECT CAST(started AS TIMESTAMP) AS started, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


@query(CLOSED)
def stream_tumbling(spark, d):
    """Closed windows of the event stream: those that the watermark has passed."""
    out = st.drained(st.tumbling(st.events_stream(spark, d)), *_fresh(spark))
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query(CLOSED)
def stream_late(spark, d):
    """The same windows, though all events of more than a day before the end come a second time, behind the watermark: late rows are dropped."""
    checkpoint, rows = _fresh(spark)
    folder, e = f"{checkpoint}-source", table(spark, d, "events")
    e.write.parquet(folder)
    arriving = lambda: st.tumbling(as_timestamp(spark.readStream.schema(e.schema).parquet(folder), "ts"))
    st.drained(arriving(), checkpoint, rows)
    end = e.agg(F.max("ts")).first()[0]
    e.where(F.col("ts") < F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 day")).write.mode("append").parquet(folder)
    return st.drained(arriving(), checkpoint, rows).select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_state(spark, d):
    """The last state of each user in the stream."""
    out = st.updates(st.running_totals(st.events_stream(spark, d)), *_fresh(spark))
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_first_seen(spark, d):
    out = st.drained(st.first_seen(st.events_stream(spark, d), ["event_id"]).select("event_id"), *_fresh(spark))
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.user_id, a.ts AS first_ts, b.ts AS then_ts FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""")
def stream_join(spark, d):
    e = st.events_stream(spark, d)
    out = st.drained(st.followed(e.where("event_type = 'signup'"), st.events_stream(spark, d).where("event_type = 'purchase'"), "user_id", "2 hours"), *_fresh(spark))
    return out.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("then_ts").cast("timestamp_ntz").alias("then_ts"))
