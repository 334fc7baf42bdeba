"""Nearest neighbours of vectors, exactly, by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a block of queries, and in a block of what is searched.
QUERIES, ROWS = 512, 4096
#: Digits to which likenesses are taken; ties go to the least id.
DIGITS = 9


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(ids, width, numbers): vectors (id long, v array<double>), `size` a row; null ids and null vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(width: int, got: list) -> pa.RecordBatch:
            ids, rows = zip(*got, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([np.stack(rows).tobytes()], pa.binary())], ["ids", "width", "numbers"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                numbers = v.values.to_numpy(zero_copy_only=False).astype(float)
                got = held.setdefault(len(numbers), [])
                got.append((i, numbers))
                if len(got) == size:
                    yield row(len(numbers), held.pop(len(numbers)))
        for width, got in held.items():
            yield row(width, got)

    return vectors.where("id is not null and v is not null").mapInArrow(pack, "ids binary, width int, numbers binary")


def nearest(queries: DataFrame, rows: DataFrame, k: int, groups: int) -> DataFrame:
    """(query, neighbour, likeness, place): the k rows of greatest inner product with each query, itself excepted.

    queries and rows: (id long, v array<double>). Rows are dealt to `groups`; each group gets each
    block of queries, multiplies blocks and keeps k of each query, so what is shuffled are the
    queries once for each group and k rows for each query and block. Vectors of other widths
    aren't compared. Null vectors match nothing; repeated ids are rows of their own.
    """
    x = blocks(rows, ROWS).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    q = blocks(queries, QUERIES).select(F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("numbers").alias("q_numbers"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("q_g"))
    pairs = x.join(q, (F.col("g") == F.col("q_g")) & (F.col("width") == F.col("q_width"))).select("ids", "numbers", "q_ids", "q_numbers", "width")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, numbers, q_ids, q_numbers, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, j = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                like = np.round(np.frombuffer(q_numbers, float).reshape(len(j), width) @ np.frombuffer(numbers, float).reshape(len(i), width).T, DIGITS)
                like[j[:, None] == i[None, :]] = -np.inf
                order = np.argsort(i, kind="stable")  # so that of equal ones the least id stays
                best = order[np.argsort(-like[:, order], 1, kind="stable")[:, :k]]
                found = np.take_along_axis(like, best, 1)
                live = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(j, live.sum(1))), pa.array(i[best][live]), pa.array(found[live])], ["query", "neighbour", "likeness"])

    few = pairs.mapInArrow(multiply, "query long, neighbour long, likeness double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("likeness"), "neighbour"))
    return few.withColumn("place", place).where(F.col("place") <= k)
