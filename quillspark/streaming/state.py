"""State of one's own on streams: lists, maps and values by key, timers in event time, state that leaves.

State is kept in RocksDB, beside the heap of each executor, and its changes are written to the
checkpoint with each batch, so a lost executor's state is read again from there. Rows of a key
meet in one task; what is kept of a key is bounded by the watermark, not by its history.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; the session's own settings come back afterwards.

    State by the clock asks for batches without rows for ever; `empty_batches` False keeps a run over what is there from waiting for them.
    """
    own = PROVIDER | {"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def finished(stream: DataFrame, checkpoint: str, out: str, empty_batches: bool = True) -> StreamingQuery:
    """Runs the stream over what is there, into parquet files in `out`, and returns the query with its progress."""
    with rocksdb(stream.sparkSession, empty_batches):
        query = stream.writeStream.format("parquet").outputMode("append").options(path=out, checkpointLocation=checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def _millis(us: int) -> int:
    """The first millisecond at which the time has passed: a timer fires when the watermark is beyond it."""
    return -(-us // 1000)


class Alarm:
    """One timer for each key, at the earliest time that something is due; each call of state costs a round trip to the JVM."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("alarm", "ms long")

    def at_latest(self, us: int) -> None:
        """The timer goes off at `us` or before."""
        ms, set_ = _millis(us), self.at.get()
        if set_ is not None and set_[0] <= ms:
            return
        if set_ is not None:
            self.handle.deleteTimer(set_[0])
        self.handle.registerTimer(ms)
        self.at.update((ms,))

    def gone_off(self, next_us: int | None) -> None:
        """The timer has fired, and the next one is due at `next_us`, if at all."""
        if next_us is None:
            self.at.clear()
        else:
            self.handle.registerTimer(_millis(next_us))
            self.at.update((_millis(next_us),))


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class Answers(StatefulProcessor):
    """For each opening row of a key the first closing row at or after it, at most `within` later, or none.

    Both kinds wait in lists, as rows come in any order until the watermark has passed them. When the alarm goes off
    every opening whose time has passed is settled, and a closing is forgotten once it is behind the watermark and no open row is before it.
    """

    def __init__(self, within_us: int) -> None:
        self.within = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "us long, id long")
        self.closing = handle.getListState("closing", "us long")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, closed = [], set()
        for r in rows:
            first = r["opens"].to_numpy(bool)
            opened += zip(r["us"][first].tolist(), r["id"][first].tolist(), strict=True)
            closed.update(r["us"][~first].tolist())
        if opened:
            self.open.appendList(opened)
        if closed:
            self.closing.appendList([(us,) for us in sorted(closed)])
        self.alarm.at_latest(min([us + self.within for us, _ in opened] + list(closed)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        open_, closing = list(self.open.get()), sorted({us for (us,) in self.closing.get()})
        due = [x for x in open_ if x[0] + self.within <= now]
        left = [x for x in open_ if x[0] + self.within > now]
        kept = closing[bisect_left(closing, min([now, *(us for us, _ in left)])) :]
        if due:
            _put(self.open, left)
        if len(kept) < len(closing):
            _put(self.closing, [(us,) for us in kept])
        # what is behind the watermark already is kept for a row that is open, so it goes with that one
        self.alarm.gone_off(min([us + self.within for us, _ in left] + [us for us in kept if us > now], default=None))
        if due:
            then = [next(iter(closing[bisect_left(closing, us) :][:1]), None) for us, _ in due]
            then = [t if t is not None and t <= us + self.within else None for t, (us, _) in zip(then, due, strict=True)]
            yield pd.DataFrame({"key": [key[0]] * len(due), "id": [i for _, i in due], "first_us": [us for us, _ in due], "then_us": pd.Series(then, dtype="Int64")})


def answered(stream: DataFrame, by: str, id_: str, opens: Column, closes: Column, within: str, late: str = "10 minutes") -> DataFrame:
    """by, id, first_ts, then_ts: every opening row of a stream (ts), settled once `within` has passed behind the watermark.

    then_ts is the time of the key's first closing row from first_ts on, `within` later at most; null
    where none came: the row that a join can't give before its state is dropped. Keys and ids are longs;
    rows without a key or time are left out, of rows of one time any closing one will do.
    """
    us = _interval_micros(stream.sparkSession, within)
    rows = stream.where((opens | closes) & F.col(by).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    kinds = rows.select(F.col(by).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), "ts", micros("ts").alias("us"), opens.alias("opens"))
    out = kinds.groupBy("key").transformWithStateInPandas(Answers(us), "key long, id long, first_us long, then_us long", "append", "eventtime")
    return out.select(F.col("key").alias(by), "id", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("then_us").alias("then_ts"))


class Visits(StatefulProcessor):
    """Runs of rows of a key with less than `gap` between neighbours, tallied by kind, in a list.

    A row joins the runs it touches, so rows may come in any order. When the alarm goes off all runs whose end
    is `gap` past are handed out and forgotten.
    """

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "start long, end long, kinds array<string>, counts array<long>")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(start, end, dict(zip(kinds, counts, strict=True))) for start, end, kinds, counts in self.runs.get()]
        for r in rows:
            held += [(us, us, {kind: 1}) for us, kind in zip(r["us"].tolist(), r["kind"].tolist(), strict=True)]
            held = self._merged(held)  # what is held are runs, not rows
        self.runs.put([(start, end, list(kinds), list(kinds.values())) for start, end, kinds in held])
        self.alarm.at_latest(min(end for _, end, _ in held) + self.gap)
        yield from ()

    def _merged(self, runs: list[tuple[int, int, dict[str, int]]]) -> list[tuple[int, int, dict[str, int]]]:
        out: list[tuple[int, int, dict[str, int]]] = []
        for start, end, kinds in sorted(runs, key=lambda r: r[:2]):
            if out and start - out[-1][1] < self.gap:
                begun, until, tally = out[-1]
                for kind, n in kinds.items():
                    tally[kind] = tally.get(kind, 0) + n
                out[-1] = begun, max(until, end), tally
            else:
                out.append((start, end, dict(kinds)))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.runs.get())
        due, left = [r for r in held if r[1] + self.gap <= now], [r for r in held if r[1] + self.gap > now]
        if due:
            _put(self.runs, left)
        # an alarm set for a run that has grown since may find nothing due
        self.alarm.gone_off(min((end + self.gap for _, end, _, _ in left), default=None))
        if due:
            rows = [(key[0], start, end, kind, n) for start, end, kinds, counts in due for kind, n in zip(kinds, counts, strict=True)]
            yield pd.DataFrame(rows, columns=["key", "start_us", "end_us", "kind", "n"])


def visits(stream: DataFrame, by: str, kind: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """by, started, ended, kind, n: runs of a stream's rows (ts) of a key with less than `gap` between neighbours, with the number of each kind, once the watermark is `gap` past the run.

    Rows without a key or time are left out; a null kind counts as ''.
    """
    us = _interval_micros(stream.sparkSession, gap)
    rows = stream.where(F.col(by).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col(by).cast("long").alias("key"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), "ts", micros("ts").alias("us"))
    out = rows.groupBy("key").transformWithStateInPandas(Visits(us), "key long, start_us long, end_us long, kind string, n long", "append", "eventtime")
    return out.select(F.col("key").alias(by), F.timestamp_micros("start_us").alias("started"), F.timestamp_micros("end_us").alias("ended"), F.col("kind").alias(kind), "n")


class Fresh(StatefulProcessor):
    """The first row of each kind of a key, and the next one only after `ttl_ms` without that kind in the key's map."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "id long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least: dict[str, int] = {}
        for r in rows:
            for kind, i in r.groupby("kind")["id"].min().items():
                least[kind] = min(int(i), least.get(kind, int(i)))
        new = [(kind, i) for kind, i in least.items() if not self.seen.containsKey((kind,))]
        for kind, i in new:
            self.seen.updateValue((kind,), (i,))
        if new:
            yield pd.DataFrame({"key": [key[0]] * len(new), "kind": [kind for kind, _ in new], "id": [i for _, i in new]})


def fresh(stream: DataFrame, by: str, kind: str, id_: str, ttl: str) -> DataFrame:
    """by, kind, id: of each batch the least id of every kind of a key that hasn't been seen for `ttl` of the clock; what is older leaves the state by itself.

    Run it without empty batches, which the clock asks for without end. Rows without a key or id are left out; a null kind counts as ''.
    """
    ms = max(1, _interval_micros(stream.sparkSession, ttl) // 1000)
    rows = stream.where(F.col(by).isNotNull() & F.col(id_).isNotNull()).select(F.col(by).cast("long").alias("key"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), F.col(id_).cast("long").alias("id"))
    out = rows.groupBy("key").transformWithStateInPandas(Fresh(ms), "key long, kind string, id long", "append", "processingtime")
    return out.select(F.col("key").alias(by), F.col("kind").alias(kind), "id")


def _interval_micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-02 00:00:00' + interval {interval}) - unix_micros(timestamp'1970-01-02 00:00:00')")).first()[0]
