"""Operators over time that Spark has no join for: as-of, interval, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Keys at most that are cut into slices of time: others hold less than this part of all rows.
HOT_KEYS = 1024


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: list[str], prefix: str = "asof_", slices: int = 64, hot: int = 1_000_000) -> DataFrame:
    """left with the values of the last right row of the same key at or before its time; null where there is none.

    Both sides meet in one shuffle by key, and one window sorted by time finds the last row. Keys of more
    than `hot` rows, `HOT_KEYS` of the largest, are cut into `slices` of time with about as many rows: a window in each slice, and where that finds
    nothing the last row of the key's earlier slices, from a table of one row for each key and slice. So a key that holds
    most rows is `slices` tasks, whatever the number of matches. Of right rows at one time the greatest values win.
    Rows with a null key or time match nothing and stay out of the shuffle.
    """
    packed = F.struct(*values).alias("__v")
    kind = right.select(packed).schema[0].dataType
    row = F.struct(*left.columns)
    ours = left.where(F.col(by).isNotNull() & F.col(left_on).isNotNull())
    sides = ours.select(F.col(by).alias("__k"), F.col(left_on).alias("__t"), F.lit(1).alias("__s"), F.lit(None).cast(kind).alias("__v"), row.alias("__row"))
    other = right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull())
    other = other.select(F.col(by).alias("__k"), F.col(right_on).alias("__t"), F.lit(0).alias("__s"), packed, F.lit(None).cast(sides.schema["__row"].dataType).alias("__row"))
    both = sides.unionAll(other)
    large = both.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).orderBy(F.desc("__n")).limit(HOT_KEYS)
    keys = [r["__k"] for r in large.collect()]
    is_large = F.col("__k").isin(keys) if keys else F.lit(False)
    so_far = Window.partitionBy("__k").orderBy("__t", "__s", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.where(~is_large).withColumn("__last", F.last("__v", ignorenulls=True).over(so_far)).where("__s = 1").select("__row", "__last")
    if keys:
        out = out.unionAll(_sliced(both.where(is_large), slices))
    rest = left.where(F.col(by).isNull() | F.col(left_on).isNull()).select(row.alias("__row"), F.lit(None).cast(kind).alias("__last"))
    return out.unionAll(rest).select("__row.*", *(F.col(f"__last.{v}").alias(f"{prefix}{v}") for v in values))


def _sliced(both: DataFrame, slices: int) -> DataFrame:
    """__row and __last of the rows of keys that are cut into slices of time."""
    numeric = isinstance(both.schema["__t"].dataType, T.NumericType)
    at = F.col("__t").cast("double") if numeric else F.unix_micros(F.col("__t").cast("timestamp")).cast("double")
    cuts = sorted(set(both.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0])) if slices > 1 else []
    # the slice of a time: how many cuts are at or before it
    both = both.withColumn("__slice", sum(((at >= F.lit(c)).cast("int") for c in cuts), F.lit(0)))
    inside = Window.partitionBy("__k", "__slice").orderBy("__t", "__s", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__v", ignorenulls=True).over(inside)).where("__s = 1")
    before = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    held = both.groupBy("__k", "__slice").agg(F.max(F.when(F.col("__s") == 0, F.struct("__t", "__v"))).alias("__most"))
    carried = held.select(F.col("__k").alias("__key"), F.col("__slice").alias("__in"), F.last("__most", ignorenulls=True).over(before)["__v"].alias("__carried")).where("__carried is not null")
    found = found.join(carried, (F.col("__k") == F.col("__key")) & (F.col("__slice") == F.col("__in")), "left")
    return found.select("__row", F.coalesce("__last", "__carried").alias("__last"))


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, by: str | None = None) -> DataFrame:
    """Pairs of a point and a span with start <= at < end (numbers), of the same `by` if given.

    Points and spans meet in slots of `width`, an equi-join: a span is copied to each slot it
    reaches, a point has one. Choose a width near the usual length of a span.
    """
    p = points.withColumn("__slot", F.floor(F.col(at) / width))
    s = spans.withColumn("__slots", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(end) > F.col(start))
    s = s.withColumnRenamed("__slots", "__span_slot")
    on: Column = F.col("__slot") == F.col("__span_slot")
    if by:
        s = s.withColumnRenamed(by, f"__{by}")
        on &= F.col(by) == F.col(f"__{by}")
    out = p.join(s, on & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return out.drop("__slot", "__span_slot", *([f"__{by}"] if by else []))


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """One row for each run of events of a key with less than `gap` between neighbours: by, started, ended, n."""
    w = F.session_window(F.col(at), gap)
    return events.groupBy(by, w.alias("__w")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n")).drop("__w")


def as_timestamp(df: DataFrame, column: str) -> DataFrame:
    """A timestamp without a zone as one with the session's, which streams need for watermarks."""
    return df.withColumn(column, F.col(column).cast(T.TimestampType()))
