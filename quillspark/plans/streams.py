"""Streams whose state ends: answers within a time, visits, outer joins, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.temporal import as_timestamp
from quillspark.plans.timeline import _fresh
from quillspark.sources.tables import table
from quillspark.streaming import state
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


def plain_times(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def run(stream: DataFrame, empty_batches: bool = True) -> DataFrame:
    """What the stream has written when all there is has been read."""
    checkpoint, rows = _fresh(stream.sparkSession)
    state.finished(stream, checkpoint, rows, empty_batches)
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)


@query("""SELECT user_id, event_id AS id, ts AS first_ts, (SELECT min(ts) FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 2 HOUR) AS then_ts
FROM events s WHERE event_type = 'signup' AND epoch_us(ts) + 7_200_000_000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600_000_000 FROM events WHERE event_type IN ('signup', 'purchase'))""")
def stream_answered(spark, d):
    """Each signup with the user's first purchase within two hours, or none: by timers and lists in state."""
    out = state.answered(st.events_stream(spark, d), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", "2 hours")
    return plain_times(run(out), "first_ts", "then_ts")


@query("""SELECT user_id, started, ended, event_type, n FROM (SELECT user_id, s, event_type, count(*) AS n, min(min(ts)) OVER (PARTITION BY user_id, s) AS started, max(max(ts)) OVER (PARTITION BY user_id, s) AS ended
FROM (SELECT *, sum(CAST(gap IS NULL OR gap >= INTERVAL 6 HOUR AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s
FROM (SELECT user_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s, event_type)
WHERE epoch_us(ended) + 21_600_000_000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600_000_000 FROM events)""")
def stream_visits(spark, d):
    """Events of each kind in each visit of a user that has ended: open visits in state, handed out by timers."""
    return plain_times(run(state.visits(st.events_stream(spark, d), "user_id", "event_type", "6 hours")), "started", "ended")


@query("SELECT user_id, event_type, min(event_id) AS id FROM events GROUP BY user_id, event_type")
def stream_fresh(spark, d):
    """The first event of each type of a user that hasn't been seen for a day of the clock."""
    return run(state.fresh(st.events_stream(spark, d), "user_id", "event_type", "event_id", "1 day"), False)


@query("""SELECT user_id, first_ts, then_ts FROM (SELECT a.user_id, a.ts AS first_ts, b.ts AS then_ts FROM (FROM events WHERE event_type = 'signup') a
LEFT JOIN (FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR)
WHERE then_ts IS NOT NULL OR epoch_us(first_ts) + 7_200_000_000 <
(SELECT (least(epoch_ms(max(ts) FILTER (event_type = 'signup')), epoch_ms(max(ts) FILTER (event_type = 'purchase'))) - 600_000) * 1000 FROM events)""")
def stream_outer_join(spark, d):
    """Signups with each purchase within two hours; those without any once the watermark has passed."""
    e = lambda kind: st.events_stream(spark, d).where(F.col("event_type") == kind)
    return plain_times(run(st.followed_or_not(e("signup"), e("purchase"), "user_id", "2 hours")), "first_ts", "then_ts")


CLOSED = """SELECT user_id, started, ended, n FROM (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CAST(gap IS NULL OR gap >= INTERVAL 6 HOUR AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s
FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s)
WHERE epoch_us(ended) + 21_600_000_000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600_000_000 FROM events)"""


@query(CLOSED)
def stream_sessions(spark, d):
    """The sessions of the batch query that the watermark has passed."""
    return plain_times(run(st.session_windows(st.events_stream(spark, d), "user_id", "6 hours")), "started", "ended")


@query(CLOSED)
def stream_sessions_late(spark, d):
    """The same, though every event of more than two days before the end comes again, behind the watermark, after a session's rows came in two runs."""
    checkpoint, rows = _fresh(spark)
    folder, e = f"{checkpoint}-source", table(spark, d, "events")
    end = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    arriving = lambda: st.session_windows(as_timestamp(spark.readStream.schema(e.schema).parquet(folder), "ts"), "user_id", "6 hours")
    # the last day comes last, so sessions that are open between are merged from two runs
    for part in (F.col("ts") < end - F.expr("interval 1 day"), F.col("ts") >= end - F.expr("interval 1 day"), F.col("ts") < end - F.expr("interval 2 days")):
        e.where(part).write.mode("append").parquet(folder)
        state.finished(arriving(), checkpoint, rows)
    return plain_times(spark.read.schema(arriving().schema).parquet(rows), "started", "ended")
