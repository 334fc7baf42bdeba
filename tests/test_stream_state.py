"""State on streams: answers, visits, expiry; late and disordered rows; what state holds."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import state
from quillspark.streaming import windows as streams

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def at(minutes: float) -> dt.datetime:
    return BEGIN + dt.timedelta(minutes=minutes)


@pytest.fixture
def source(spark, tmp_path):
    """put(rows) adds a file; stream() reads what is there; run(stream) goes on behind what was read."""

    class Source:
        folder, checkpoint, out = (f"{tmp_path}/{x}" for x in ("source", "checkpoint", "rows"))

        def put(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self):
            return spark.readStream.schema(SCHEMA).parquet(self.folder)

        def run(self, stream, empty_batches=True):
            query = state.finished(stream, self.checkpoint, self.out, empty_batches)
            return spark.read.schema(stream.schema).parquet(self.out), query

    return Source()


def held(query) -> int:
    """Rows in the state store after the last batch that says so."""
    return [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators][-1]


def test_answers_in_any_order_and_state_that_leaves(spark, source):
    """Batches overlap within the watermark's delay; an answer may be read before its question. State falls when time has passed."""
    r, rows = random.Random(3), []
    for i in range(160):
        rows.append((i, at(r.uniform(0, 900)), r.randrange(4), r.choice(("signup", "purchase", "view"))))
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.uniform(0, 9)))
    stream = lambda: state.answered(source.stream(), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", "60 minutes")
    sizes = []
    for i in range(0, 160, 40):
        source.put(arrival[i : i + 40])
        sizes.append(held(source.run(stream())[1]))
    source.put([(900, at(5000), 1, "view"), (901, at(5001), 9, "signup")])
    out, query = source.run(stream())
    sizes.append(held(query))
    want = set()
    for i, ts, user, kind in rows:
        if kind == "signup":
            then = [t for _, t, u, k in rows if k == "purchase" and u == user and ts <= t <= ts + dt.timedelta(minutes=60)]
            want.add((user, i, ts, min(then, default=None)))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want and any(x[3] is None for x in want) and any(x[3] for x in want)
    # what is open is a question or an answer of the last hour or so, with its timer; at the end the last question alone
    assert max(sizes[:-1]) < 70 and sizes[-1] < min(sizes[:-1])


def test_visits_merge_and_leave(spark, source):
    """Two runs that a late row joins are one; kinds are tallied; a visit leaves the state when it is handed out."""
    stream = lambda: state.visits(source.stream(), "user_id", "event_type", "30 minutes")
    source.put([(1, at(0), 1, "a"), (2, at(50), 1, "b"), (3, at(0), 2, None), (4, at(3), None, "a"), (5, None, 1, "a")])
    source.put([(6, at(27), 1, "a"), (7, at(52), 1, "a")])  # behind the first, before the watermark of 40 is set
    out, query = source.run(stream())
    assert out.where("user_id = 1").count() == 0 and held(query) > 0
    source.put([(8, at(45), 1, "c"), (9, at(300), 3, "z")])
    out, query = source.run(stream())
    got = {(x["user_id"], x["started"], x["ended"], x["event_type"], x["n"]) for x in out.collect()}
    assert got == {(1, at(0), at(52), "a", 3), (1, at(0), at(52), "b", 1), (1, at(0), at(52), "c", 1), (2, at(0), at(0), "", 1)}
    first = held(query)
    source.put([(10, at(900), 4, "z"), (11, at(901), 4, "z")])
    out, query = source.run(stream())
    assert (3, at(300), at(300), "z", 1) in {tuple(x) for x in out.collect()} and held(query) <= first + 2


def test_state_with_an_age_leaves_by_the_clock(spark, source):
    stream = lambda: state.fresh(source.stream(), "user_id", "event_type", "event_id", "6 seconds")
    source.put([(5, at(0), 1, "a"), (4, at(1), 1, "a"), (6, at(0), 2, "a"), (None, at(0), 2, "a"), (7, at(0), 2, None)])
    began = time.time()
    assert {tuple(x) for x in source.run(stream(), False)[0].collect()} == {(1, "a", 4), (2, "a", 6), (2, "", 7)}
    source.put([(7, at(2), 1, "a"), (8, at(2), 3, "a")])
    out = {tuple(x) for x in source.run(stream(), False)[0].collect()}
    assert (3, "a", 8) in out and ((1, "a", 7) not in out or time.time() - began > 6)
    time.sleep(7)
    source.put([(9, at(3), 1, "a")])
    assert (1, "a", 9) in {tuple(x) for x in source.run(stream(), False)[0].collect()}


def test_unmatched_rows_come_once_time_has_passed(spark, source):
    kind = lambda k: source.stream().where(F.col("event_type") == k)
    stream = lambda: streams.followed_or_not(kind("a"), kind("b"), "user_id", "60 minutes")
    source.put([(1, at(0), 1, "a"), (2, at(10), 2, "a"), (3, at(30), 1, "b"), (4, at(60), 1, "b"), (5, at(61), 1, "b")])
    assert {tuple(x) for x in source.run(stream())[0].collect()} == {(1, at(0), at(30)), (1, at(0), at(60))}
    source.put([(6, at(400), 5, "a"), (7, at(400), 6, "b")])
    assert {tuple(x) for x in source.run(stream())[0].collect()} == {(1, at(0), at(30)), (1, at(0), at(60)), (2, at(10), None)}


def test_sessions_of_a_stream(spark, source):
    stream = lambda: streams.session_windows(source.stream(), "user_id", "30 minutes")
    source.put([(1, at(0), 1, "a"), (2, at(50), 1, "a"), (3, at(9), None, "a")])
    source.put([(4, at(25), 1, "a")])
    source.run(stream())
    source.put([(5, at(200), 2, "a"), (6, at(45), 1, "a")])
    source.run(stream())
    source.put([(7, at(10), 1, "a"), (8, at(400), 2, "a")])  # 7 is behind the watermark
    assert {tuple(x) for x in source.run(stream())[0].collect()} == {(1, at(0), at(50), 4), (2, at(200), at(200), 1)}
