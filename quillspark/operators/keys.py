"""Joins of tables that lie by key already, and sides cut down to likely keys before a join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import shared_dir

#: Bits of a key filter at most, as a power of two: it has 2**(MOST - 6) broadcast rows at most.
MOST = 24


def bucketed(df: DataFrame, by: list[str], buckets: int, name: str | None = None) -> DataFrame:
    """df kept as a table in buckets of a key, sorted in each: the one shuffle that later joins and groupings on the key are spared.

    Rows go to their bucket before they are written, so a bucket is one file. The files lie in the shared folder, the table's name in the session's catalog,
    until DROP TABLE. Two tables of the same number of buckets meet bucket by bucket. A key that holds most rows is one
    bucket: keep such keys apart.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def likely(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """df without most rows whose column is none of the keys, before a shuffle: a filter of bits, sized by the number of keys, is broadcast, and met by an equi-join on its words.

    No row that has a key is lost; of the others some six in a hundred stay, and more where keys are more than 2**MOST / 16, up to all: the
    filter doesn't grow with them. Null is no key. Column and key are of one type; column names may be any.
    """
    keys = keys.where(F.col(key).isNotNull())
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = max(6, min(MOST, (16 * n).bit_length()))

    def spot(c: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))

    own = uuid.uuid4().hex
    word, bit = spot(key)
    words = keys.select(word.alias(f"word_{own}"), bit.alias("bit")).groupBy(f"word_{own}").agg(F.bit_or("bit").alias(f"bits_{own}"))
    word, bit = spot(column)
    met = df.where(F.col(column).isNotNull()).join(F.broadcast(words), (word == F.col(f"word_{own}")) & (F.col(f"bits_{own}").bitwiseAND(bit) != 0))
    return met.drop(f"word_{own}", f"bits_{own}")
