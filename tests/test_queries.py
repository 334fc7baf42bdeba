"""Every query outside the llm subpackage against its SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.sources.tables import TABLES

from .compare import duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
VIEWS = {t: f"{FOLDER}/{t}.parquet" for t in TABLES}
QUERIES = {k: f for m in entry.MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry.MODULES for k, s in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(SQL[name], VIEWS)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_sketches_are_close_to_exact_counts(spark):
    values = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_type", "user_id", "value").collect():
        values.setdefault(r["event_type"], []).append((r["user_id"], r["value"]))
    got = QUERIES["approximate"](spark, FOLDER).collect()
    assert len(got) == len(values)
    for r in got:
        users, order = len({u for u, _ in values[r["event_type"]]}), sorted(v for _, v in values[r["event_type"]])
        assert abs(r["users"] - users) <= 0.06 * users and abs(r["users_hll"] - users) <= 0.06 * users
        assert sum(v < r["median"] for v in order) <= 0.51 * len(order) and sum(v <= r["median"] for v in order) >= 0.49 * len(order)


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Events of more users than one sketch counts exactly, on days with a gap, with nulls."""
    folder = tmp_path_factory.mktemp("busy")
    at = F.timestamp_seconds((F.col("id") % 5 + F.when(F.col("id") % 5 > 3, 2).otherwise(0)) * 86400)
    e = spark.range(120_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 997 > 0, at).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 499 > 0, F.col("id") * 7919 % 50_021).alias("user_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    e.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["sketch_retention", "sketch_totals"])
def test_kept_sketches_count_many_users(spark, busy, name):
    got, want = spark_rows(QUERIES[name](spark, busy)), duck_rows(SQL[name], {"events": f"{busy}/events.parquet/*.parquet"})
    assert got == want and len(want[1]) > 2


def test_late_rows_are_dropped(spark):
    """Without the late rows, and with them, the stream gives the same windows; in a batch query they would count."""
    rows = lambda name: spark_rows(QUERIES[name](spark, FOLDER))
    assert rows("stream_late") == rows("stream_tumbling")
