"""Rows by what another table lacks, and samples of rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.aggregates import top_rows


def not_in(left: DataFrame, right: DataFrame, column: str, other: str) -> DataFrame:
    """The rows of left for which `column NOT IN (other of right)` is true, by SQL's rules for nulls.

    A null among the others makes it true of no row, a null of one's own of none unless right is
    empty, when it is true of all. Counts of right, one row, decide that; the rest is an anti join
    on equality, which is shuffled by key where a null-aware one must be broadcast.
    """
    told = right.agg(F.count(F.lit(1)).alias("__n"), F.count(other).alias("__known"))
    kept = left.join(F.broadcast(told), (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(column).isNotNull())).drop("__n", "__known")
    return kept.join(right.select(F.col(other).alias("__other")).distinct(), F.col(column) == F.col("__other"), "left_anti")


def sampled_by_key(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """About one row in `one_in`, chosen by the digest of its key: the same rows on any cluster; rows of one key go together. Null keys aren't chosen."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % one_in == 0)


def weighted_sample(df: DataFrame, by: list[str], weight: str, key: str, k: int) -> DataFrame:
    """k rows of each group, all of a smaller one, without replacement: in each draw a row's chance is its share of the weight that is left.

    Each row's arrival, an exponential of its weight made from the digest of its key, is compared:
    the k first ones are the sample, so it is the same on any cluster, each task keeps k of a group before the
    shuffle, and samples of parts can be merged by taking the k first again. Weights that are null, NaN or not above 0
    are never drawn; ties go to the lesser key. The column `arrival` comes with the rows.
    """
    part = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double")
    w = F.col(weight).cast("double")
    rows = df.where((w > 0) & ~F.isnan(w) & F.col(key).isNotNull()).withColumn("arrival", -F.log((part + 0.5) / 4294967296.0) / w)
    return top_rows(rows, by, [F.asc("arrival"), F.asc(key)], k, "place").drop("place")
