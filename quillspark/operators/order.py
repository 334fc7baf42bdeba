"""Order over all rows without a task that has them all: values at ranks, exact quantiles, numbers of rows."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import shared_dir

#: Rows between two bounds that are looked at one by one; more are narrowed again.
FEW = 50_000
#: Accuracy of the sketch that narrows: a round leaves about two of so many parts of the rows.
PARTS = 10_000


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> list:
    """The values at ranks (from 1) of the sorted non-null values of a numeric or time column; exact. A rank outside is an error.

    Each round a sketch bounds every rank, and counts tell how many values are below, at and between the bounds.
    A value that most rows have is a bound itself, so it ends the search; what is between falls to about
    a five-thousandth each round, until `FEW` values are left to look at. No row is sorted or shuffled before that.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    found: dict[int, object] = {}
    #: rank -> (bounds that the value is strictly between, values below the lower one and at it)
    open_: dict[int, tuple[object, object, int]] = dict.fromkeys(ranks, (None, None, 0))
    total = None
    while open_:
        groups: dict[tuple, list[int]] = {}
        for r, span in open_.items():
            groups.setdefault(span, []).append(r)
        open_ = {}
        for (low, high, before), wanted in groups.items():
            inside = values
            if low is not None:
                inside = inside.where(F.col("v") > F.lit(low))
            if high is not None:
                inside = inside.where(F.col("v") < F.lit(high))
            n = inside.count()
            total = n if total is None else total
            if not all(1 <= r <= total for r in wanted):
                raise ValueError("no such rank")
            if n <= FEW:
                seen = before
                for value, many in sorted((tuple(r) for r in inside.groupBy("v").count().collect()), key=lambda x: x[0]):
                    found |= {r: value for r in wanted if seen < r <= seen + many}
                    seen += many
                continue
            spots = sorted({min(1.0, max(0.0, (r - before + d * n / PARTS) / n)) for r in wanted for d in (-1, 1)})
            bounds = sorted(set(inside.agg(F.percentile_approx("v", spots, PARTS)).first()[0]))
            counts = inside.agg(*(F.count(F.when(F.col("v") < F.lit(b), 1)) for b in bounds), *(F.count(F.when(F.col("v") == F.lit(b), 1)) for b in bounds)).first()
            below, at = counts[: len(bounds)], counts[len(bounds) :]
            for r in wanted:
                i = max((i for i in range(len(bounds)) if before + below[i] < r), default=-1)
                if i >= 0 and r <= before + below[i] + at[i]:
                    found[r] = bounds[i]
                else:
                    open_[r] = bounds[i] if i >= 0 else low, bounds[i + 1] if i + 1 < len(bounds) else high, before + (below[i] + at[i] if i >= 0 else 0)
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """Exact quantiles of a numeric column, between neighbours by proportion, as SQL's percentile_cont gives them; None of no values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(at)
    spots = [q * (n - 1) for q in at]
    ranks = sorted({k for s in spots for k in (math.floor(s) + 1, math.ceil(s) + 1)})
    value = dict(zip(ranks, at_ranks(df, column, ranks), strict=True))
    return [value[math.floor(s) + 1] + (value[math.ceil(s) + 1] - value[math.floor(s) + 1]) * (s - math.floor(s)) for s in spots]


def numbered(df: DataFrame, order: list[Column], name: str = "number", slices: int | None = None) -> DataFrame:
    """df with the number of each row, from 1, in the given order over all rows.

    Rows are dealt by ranges of the order, sorted in each and written to the shared folder once; a row's number is its
    place there and what the ranges before hold, a number for each range. Ties are settled, and split over ranges, by the digest of the whole row,
    so a value that most rows have isn't one task; rows equal in all columns are numbered in any order.
    """
    spark = df.sparkSession
    slices = slices or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*order, F.xxhash64(*df.columns)]
    at, taken = f"__at_{uuid.uuid4().hex}", f"__part_{uuid.uuid4().hex}"
    laid = df.repartitionByRange(slices, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path).withColumn(taken, F.shiftright(at, 33))
    before, rows = 0, []
    for part, n in sorted(tuple(r) for r in laid.groupBy(taken).count().collect()):  # a row for each range
        rows.append((part, before))
        before += n
    add = F.broadcast(spark.createDataFrame(rows, f"{taken} long, __before long"))
    return laid.join(add, taken).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).alias(name))
