"""Joins on two inequalities: values within bounds, and intervals that overlap, without a nested loop and without a width to guess."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of either side that a cell is meant to hold; ranges at most; pairs in a batch that is handed on.
ROWS, RANGES, OUT = 100_000, 1024, 32_768


def _comparable(df: DataFrame, column: str, whole: bool) -> Column:
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long" if whole else "double")


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType))


def within_bounds(left: DataFrame, right: DataFrame, low: str, high: str, at: str, prefix: str = "right_", above: bool = False, rows: int = ROWS) -> DataFrame:
    """Pairs of a row of left and one of right with left.low <= right.at <= left.high (low < at with `above`), all columns of both.

    Right's values are cut into ranges of about `rows` by approximate quantiles; a left row goes to each
    range that it reaches, of whose rows, but in its first and last, all are in the result. A range that holds
    more than `rows` of a side (a value that most rows have, bounds that all rows share) is a grid of cells, each with a part of
    either side, by the digest of rows. In a cell right's rows are held sorted and left's are streamed past them
    by binary search, so only pairs of the result are formed. Held are `rows` and as many as are equal in all columns.
    Nulls and NaN match nothing, nor do bounds the wrong way round. Repeated rows pair each by itself.
    Columns of right that left has too get `prefix`. Numbers are compared as doubles unless all three are integers or times.
    """
    spark = left.sparkSession
    whole = _whole(left, low) and _whole(left, high) and _whole(right, at)
    kind = "long" if whole else "double"
    fine: Callable[[Column], Column] = lambda c: c.isNotNull() if whole else c.isNotNull() & ~F.isnan(c)
    points = right.select(_comparable(right, at, whole).alias("at"), F.struct(*right.columns).alias("r")).where(fine(F.col("at")))
    spans = left.select(_comparable(left, low, whole).alias("low"), _comparable(left, high, whole).alias("high"), F.struct(*left.columns).alias("l"))
    spans = spans.where(fine(F.col("low")) & fine(F.col("high")) & (F.col("low") <= F.col("high")))
    n, cuts = points.agg(F.count(F.lit(1)), F.percentile_approx("at", [i / RANGES for i in range(1, RANGES)], 10_000)).first()
    ranges = max(1, min(RANGES, -(-n // rows)))
    cuts = np.array(cuts or [], np.int64 if whole else float)
    edges = np.unique(cuts[[i * RANGES // ranges - 1 for i in range(1, ranges)]]) if len(cuts) else cuts  # `RANGES` at most

    def placed(*columns: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [pa.array(np.searchsorted(edges, b.column(b.schema.get_field_index(c)).to_numpy(), "right"), pa.int32()) for c in columns]
                yield pa.RecordBatch.from_arrays([*found, *b.columns], [*(f"in_{c}" for c in columns), *b.schema.names])

        return run

    def struct_of(schema: T.StructType, *columns: str) -> T.StructType:
        return T.StructType([*(T.StructField(f"in_{c}", T.IntegerType()) for c in columns), *schema.fields])

    points = points.mapInArrow(placed("at"), struct_of(points.schema, "at")).withColumnRenamed("in_at", "range")
    spans = spans.mapInArrow(placed("low", "high"), struct_of(spans.schema, "low", "high"))
    spans = spans.withColumn("range", F.explode(F.sequence("in_low", "in_high"))).drop("in_low", "in_high")
    # a row for each range says how many parts either side has there; where one side has nothing there is nothing to do
    sizes = points.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / rows).alias("p")).join(spans.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / rows).alias("s")), "range")
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes.select("range", "p", "s").collect()], "range int, p long, s long"))

    def celled(df: DataFrame, value: str, row: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(value, row), F.col(own))
        return df.join(sizes, "range").withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    ours = celled(spans, "low", "l", "s", "p").select("range", F.col("other").alias("p"), F.col("own").alias("s"), F.lit(1).alias("side"), F.col("low").alias("value"), "high", "l", none(points, "r"))
    theirs = celled(points, "at", "r", "p", "s").select("range", F.col("own").alias("p"), F.col("other").alias("s"), F.lit(0).alias("side"), F.col("at").alias("value"), F.lit(None).cast(kind).alias("high"), none(spans, "l"), "r")
    cells = theirs.unionAll(ours).repartition("range", "p", "s").sortWithinPartitions("range", "p", "s", "side", "value")
    first = "right" if above else "left"

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values, kept, held = None, [], [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if b.num_rows else []
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here, part = tuple(keys[i, :3]), b.slice(i, j - i)
                if here != cell:
                    cell, values, kept, held = here, [], [], None
                if keys[i, 3] == 0:
                    values.append(part.column(4).to_numpy())
                    kept.append(part.column(7))
                    continue
                if not kept:
                    continue
                if held is None:
                    held = np.concatenate(values), pa.chunked_array(kept)
                low = np.searchsorted(held[0], part.column(4).to_numpy(), first)
                count = np.maximum(np.searchsorted(held[0], part.column(5).to_numpy(), "right") - low, 0)
                ends = np.cumsum(count)
                for a in range(0, int(ends[-1]), OUT):  # pair number a and those after it
                    number = np.arange(a, min(a + OUT, int(ends[-1])))
                    of = np.searchsorted(ends, number, "right")
                    found = held[1].take(pa.array(low[of] + number - (ends - count)[of]))
                    yield pa.RecordBatch.from_arrays([part.column(6).take(pa.array(of)), found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found], ["l", "r"])

    pairs = cells.mapInArrow(pair, T.StructType([spans.schema["l"], points.schema["r"]]))
    return pairs.select("l.*", *(F.col(f"r.`{c}`").alias(prefix + c if c in left.columns else c) for c in right.columns))


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, prefix: str = "right_", rows: int = ROWS) -> DataFrame:
    """Pairs of intervals, both ends included, that have a moment in common: left.start <= right.end and right.start <= left.end.

    Of such a pair one begins within the other: right within left, or left within right and later. Intervals that end before they start overlap nothing.
    """
    a, b = left.where(F.col(start) <= F.col(end)), right.where(F.col(start) <= F.col(end))
    one = within_bounds(a, b, start, end, start, prefix, rows=rows)
    other = within_bounds(b, a, start, end, start, prefix, above=True, rows=rows)
    # the other way round: names with the prefix are left's there
    both = set(left.columns) & set(right.columns)
    back = [F.col(f"`{prefix}{c}`" if c in both else f"`{c}`").alias(c) for c in left.columns]
    return one.unionAll(other.select(*back, *(F.col(f"`{c}`").alias(prefix + c if c in both else c) for c in right.columns)))
