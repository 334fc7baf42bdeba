"""Queries through functions of one's own: scalar, aggregate, table-valued, grouped; and through other formats."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.mergeable import Moments, Quantiles, Spread, aggregated
from quillspark.sources import arrow_files
from quillspark.sources.tables import load, save, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n FROM documents")
def scalar_function(spark, d):
    @F.pandas_udf("long")
    def letters(s: pd.Series) -> pd.Series:
        return s.str.count("e")

    return table(spark, d, "documents").select("doc_id", letters("text").alias("n"))


@query("SELECT c_custkey, CAST(list_aggregate(list_transform(string_split(c_name, ''), lambda c: unicode(c)), 'sum') AS BIGINT) AS code_sum FROM customer")
def row_function(spark, d):
    """A function called row by row, the slow path: its rows still travel in Arrow batches."""

    @F.udf("long", useArrow=True)
    def code_sum(name: str) -> int | None:
        return None if name is None else sum(map(ord, name))

    return table(spark, d, "customer").select("c_custkey", code_sum("c_name").alias("code_sum"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, CAST(list_position(v, list_max(v)) AS BIGINT) AS peak FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def arrow_function(spark, d):
    """Length and place of the greatest number of vectors, on Arrow arrays, without pandas between."""

    @F.arrow_udf("length double, peak long")
    def measured(v: pa.Array) -> pa.Array:
        offsets, numbers = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(float)
        parts = [numbers[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        length, peak = [float(np.sqrt(p @ p)) if len(p) else None for p in parts], [int(p.argmax()) + 1 if len(p) else None for p in parts]
        return pa.StructArray.from_arrays([pa.array(length, pa.float64()), pa.array(peak, pa.int64())], ["length", "peak"])

    found = table(spark, d, "embeddings").select("vec_id", measured(F.col("embedding").cast("array<double>")).alias("m"))
    return found.select("vec_id", F.round("m.length", 6).alias("length"), "m.peak")


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def aggregate_function(spark, d):
    """A mergeable aggregate of one's own: each task folds its rows, states are merged."""
    return aggregated(table(spark, d, "events"), ["event_type"], "value", Spread())


@query("""SELECT event_type, n, round(mean, 5) AS mean, round(variance, 4) AS variance, round(skewness, 5) AS skewness FROM (SELECT event_type, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance, skewness(value) AS skewness FROM events GROUP BY event_type)""")
def aggregate_moments(spark, d):
    found = aggregated(table(spark, d, "events"), ["event_type"], "value", Moments())
    return found.select("event_type", "n", *(F.round(c, n).alias(c) for c, n in (("mean", 5), ("variance", 4), ("skewness", 5))))


@query(None)
def aggregate_quantiles(spark, d):
    """Quartiles of each type by a t-digest, and the share of rows below each: how far its rank is off can be read off."""
    e = table(spark, d, "events").select("event_type", "value")
    found = aggregated(e, ["event_type"], "value", Quantiles((0.25, 0.5, 0.75)))
    below = e.join(F.broadcast(found.select("event_type", "quantiles")), "event_type")  # a row for each type
    below = below.groupBy("event_type").agg(*(F.avg((F.col("value") < F.col("quantiles")[i]).cast("double")).alias(f"below_{c}") for i, c in enumerate(("q1", "q2", "q3"))))
    return found.select("event_type", "n", "low", "high", *(F.col("quantiles")[i].alias(c) for i, c in enumerate(("q1", "q2", "q3")))).join(below, "event_type")


@query("SELECT doc_id, CAST(n AS INT) AS n, text[n * 100 + 1:n * 100 + 100] AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 99) // 100)) AS n FROM documents)")
def table_function(spark, d):
    @F.arrow_udtf(returnType="doc_id long, n int, piece string")
    class Pieces:
        def eval(self, batch: pa.RecordBatch):
            """All pieces of a batch of texts at once: they are cut out of the texts joined."""
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            pieces, ends = -(-sizes // 100), np.cumsum(sizes)
            of = np.repeat(np.arange(len(texts)), pieces)
            n = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = (ends - sizes)[of] + 100 * n
            joined = "".join(texts)
            found = [joined[a:b] for a, b in zip(start.tolist(), np.minimum(start + 100, ends[of]).tolist(), strict=True)]
            yield pa.table({"doc_id": batch.column(0).take(pa.array(of)), "n": pa.array(n, pa.int32()), "piece": pa.array(found, pa.string())})

    return Pieces(table(spark, d, "documents").select("doc_id", "text").asTable())


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chars_so_far FROM conversations")
def grouped_function(spark, d):
    def so_far(t: pa.Table) -> pa.Table:
        t = t.sort_by("turn")
        return pa.table({"conv_id": t["conv_id"], "turn": t["turn"], "chars_so_far": pc.cumulative_sum(pc.cast(pc.utf8_length(t["text"]), pa.int64()))})

    return table(spark, d, "conversations").groupBy("conv_id").applyInArrow(so_far, "conv_id long, turn long, chars_so_far long")


@query("""SELECT c_custkey, count(o_orderkey) AS n, max(c_acctbal) AS balance FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def cogrouped_function(spark, d):
    def both(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": [key[0]], "n": [len(right)], "balance": [left["c_acctbal"].max()]}) if len(left) else pd.DataFrame({"c_custkey": [], "n": [], "balance": []})

    c, o = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return c.groupBy("c_custkey").cogroup(o.groupBy("o_custkey")).applyInPandas(both, "c_custkey long, n long, balance double")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def batches_function(spark, d):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.table({"role": b.column(0)}).group_by("role").aggregate([("role", "count")])
            yield from pa.table({"role": got["role"], "n": got["role_count"]}).to_batches()

    parts = table(spark, d, "conversations").select("role").mapInArrow(tally, "role string, n long")
    return parts.groupBy("role").agg(F.sum("n").alias("n"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/formats-{uuid.uuid4().hex}"


def _through(kind: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        nation, path = table(spark, d, "nation"), _scratch(spark)
        save(nation, path, kind, **options)
        return load(spark, path, kind, nation.schema, **options)

    return run


for _kind, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
    QUERIES[f"format_{_kind}"] = _through(_kind, **_options)
    ORACLE_SQL[f"format_{_kind}"] = "SELECT * FROM nation"


@query("SELECT n_name AS value FROM nation")
def format_text(spark, d):
    path = _scratch(spark)
    save(table(spark, d, "nation").select("n_name"), path, "text")
    return load(spark, path, "text")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_sink(spark, d):
    """Written by status and read again: the filter prunes folders."""
    path = _scratch(spark)
    save(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, by=("o_orderstatus",))
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey <= 5000")
def source_of_own(spark, d):
    """Orders through a data source in Python and back, with a filter that reaches it."""
    arrow_files.use(spark)
    path = _scratch(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    rows.repartitionByRange("o_orderkey").write.format(arrow_files.NAME).option("path", path).mode("append").save()
    return spark.read.format(arrow_files.NAME).option("path", path).load().where("o_orderkey <= 5000")
