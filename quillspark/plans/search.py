"""Nearest vectors through an index of lists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import lists
from quillspark.operators.vectors import nearest
from quillspark.sources.tables import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Numbers of a vector, lists, neighbours; the recall for which the number of probed lists is chosen.
WIDTH, LISTS, K, TARGET = 64, 32, 5, 0.95


def query(sql: str | None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _index(spark: SparkSession, d: str) -> lists.Index:
    return lists.Index.build(_vectors(spark, d), f"{shared_dir(spark)}/vector-lists-{uuid.uuid4().hex}", WIDTH, LISTS)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT q.vec_id AS query, x.vec_id AS neighbour, round(list_dot_product(q.v, x.v), 6) AS likeness, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, x.v), 9) DESC, x.vec_id) AS INT) AS place
FROM e q JOIN e x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id QUALIFY place <= 5""")
def indexed_vectors_all_lists(spark, d):
    """The five nearest of every twentieth vector, from all lists of the index: what exact search gives, so every row is in it."""
    found = _index(spark, d).search(_vectors(spark, d).where("id % 20 = 0"), K, LISTS)
    return found.select("query", "neighbour", F.round("likeness", 6).alias("likeness"), "place")


def _found(spark: SparkSession, d: str) -> DataFrame:
    v, index = _vectors(spark, d), _index(spark, d)
    queries = v.where("id % 20 = 0")
    return index.search(queries, K, index.probes_for(queries, v, K, TARGET, _groups(spark)))


def _groups(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query(None)
def indexed_vectors(spark, d):
    """The same from as few lists as `TARGET` recall takes, measured on a sample of the queries."""
    return _found(spark, d).select("query", "neighbour", F.round("likeness", 6).alias("likeness"), "place")


@query(None)
def indexed_vectors_recall(spark, d):
    """How many of the exact neighbours of each query the probed lists hold."""
    v = _vectors(spark, d)
    return lists.recall(_found(spark, d), nearest(v.where("id % 20 = 0"), v, K, _groups(spark)))
