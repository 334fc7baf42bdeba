"""Sketches that are kept: one row for each day and group, merged and intersected later without reading the events again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**SIZE values of a theta sketch: up to that many its counts are exact, beyond that within 3 / sqrt(2**SIZE) in 99 of 100 cases.
SIZE = 14
#: Values of a part on average: half of what its sketches count exactly, as parts differ a little.
PART = 2**SIZE // 2
#: k of a KLL sketch: ranks are within about 1.33 percent at 200, half of that at 400.
K = 400


def in_parts(df: DataFrame, who: str, part: str = "part") -> DataFrame:
    """df with the part of each row, by a hash of `who` (null where that is null): so many parts that a part's sketches,
    however merged, count exactly. A sum over parts is then an exact count of any number of values. One number comes to the driver."""
    n = df.agg(F.approx_count_distinct(who)).first()[0] // PART + 1
    return df.withColumn(part, F.when(F.col(who).isNotNull(), F.pmod(F.xxhash64(who), F.lit(n))))


def sketched(df: DataFrame, by: list[str], who: str, value: str) -> DataFrame:
    """by, n, who (theta sketch of distinct values), value (KLL sketch, null without values): each task sketches its rows, only sketches are shuffled."""
    number = F.col(value).cast("double")
    sketches = F.theta_sketch_agg(who, SIZE).alias("who"), F.kll_sketch_agg_double(F.when(~F.isnan(number), number), K).alias("value")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sketches)


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the kept rows of each group as one."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_union_agg("who", SIZE).alias("who"), F.kll_merge_agg_double("value", K).alias("value"))


def distinct(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def exact(sketch: str) -> Column:
    """The theta sketch, whose counts are no estimates: one of more than 2**SIZE values is an error."""
    return F.when(distinct(sketch) > 2**SIZE, F.raise_error(F.lit(f"a part of more than {2**SIZE} values has no exact sketch"))).otherwise(F.col(sketch))


def in_both(a: str | Column, b: str | Column) -> Column:
    """About how many values two theta sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_in(a: str | Column, b: str | Column) -> Column:
    """About how many values of a aren't in b."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(sketch: str | Column, at: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(at))


def rank(sketch: str | Column, value: float | Column) -> Column:
    """About which share of the values is at most `value`."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(value) if isinstance(value, float) else value)
