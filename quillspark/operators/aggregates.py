"""Aggregation that holds under skew, and top rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def salted_distinct(df: DataFrame, by: list[str], column: str, name: str, salts: int = 32) -> DataFrame:
    """The number of distinct values of a column for each group, where a group may hold most rows.

    Values of a group are dealt by their hash, counted apart and then summed: no task gets a whole group.
    """
    parts = df.where(F.col(column).isNotNull()).groupBy(*by, F.pmod(F.xxhash64(column), F.lit(salts)).alias("__salt")).agg(F.count_distinct(column).alias("__n"))
    found = parts.groupBy(*by).agg(F.sum("__n").alias(name))
    groups = df.select(*by).distinct()
    same = [groups[b].eqNullSafe(found[b]) for b in by]
    joined = groups.join(found, same, "left")
    return joined.select(*(groups[b] for b in by), F.coalesce(found[name], F.lit(0)).alias(name))


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order, numbered from 1; each task keeps k of a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def money(column: Column | str, digits: int = 2) -> Column:
    """A double as a decimal: sums of it don't depend on the order of rows."""
    return F.col(column).cast(f"decimal(18,{digits})") if isinstance(column, str) else column.cast(f"decimal(18,{digits})")
