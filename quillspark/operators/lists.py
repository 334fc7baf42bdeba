"""Approximate nearest neighbours: vectors in lists around trained centres, searched by list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.vectors import DIGITS, QUERIES, ROWS, nearest

#: Vectors that centres are trained on at most, and lists at most: both go through the driver.
SAMPLE, LISTS = 65_536, 4096
#: Blocks of a list that one task multiplies; a list of more is split over tasks.
BLOCKS = 16
#: Queries on which recall is measured.
MEASURED = 256


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _usable(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.where(F.col("id").isNotNull() & (F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def train(vectors: DataFrame, width: int, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """`lists` centres at most of vectors (id, v), by k-means on a sample of `SAMPLE`, chosen by the digest of the ids.

    An empty centre moves to the vector that is farthest from its own. Fewer different vectors than lists: as many centres.
    """
    lists = min(lists, LISTS)
    drawn = _usable(vectors, width).select("v", F.xxhash64("id", F.lit(seed)).alias("at")).orderBy("at").limit(SAMPLE).select("v").toArrow()
    x = np.unique(_matrix(drawn["v"].combine_chunks(), width), axis=0) if drawn.num_rows else np.zeros((0, width))
    if len(x) <= lists:
        return x
    r = np.random.RandomState(seed)
    centres = x[r.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near, far = _assigned(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (n == 0).any():
            centres[n == 0] = x[np.argsort(-far, kind="stable")[: int((n == 0).sum())]]
    return centres


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the square of its distance."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    norms = (centres**2).sum(1)
    for i in range(0, len(x), ROWS):
        part = x[i : i + ROWS]
        apart = norms[None, :] - 2 * part @ centres.T
        near[i : i + ROWS] = apart.argmin(1)
        far[i : i + ROWS] = apart.min(1) + (part**2).sum(1)
    return near, far


@dataclass
class Index:
    """Vectors on disk, a folder for each list, in blocks; and the centres of the lists."""

    path: str
    centres: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, width: int, lists: int, seed: int = 1) -> Index:
        """Indexes every vector (id long, v array<double>) of `width` numbers; null ids, null or other vectors are left out, repeated ids are rows of their own.

        Rows are dealt to lists by broadcast centres, brought together by list (large lists over several tasks) and packed into blocks.
        """
        centres = train(vectors, width, lists, seed=seed)
        spark = vectors.sparkSession
        shared = spark.sparkContext.broadcast(centres)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near, _ = _assigned(_matrix(b.column(1), width), shared.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())], ["id", "v", "list"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list, list]] = {}

            def block(which: int) -> pa.RecordBatch:
                ids, rows = held.pop(which)
                return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.stack(rows).tobytes()], pa.binary())], ["list", "n", "ids", "numbers"])

            for b in batches:  # sorted by list
                for which, i, row in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), _matrix(b.column(1), width), strict=True):
                    if which not in held:
                        yield from map(block, list(held))
                        held[which] = [], []
                    held[which][0].append(i)
                    held[which][1].append(row)
                    if len(held[which][0]) == ROWS:
                        yield block(which)
            yield from map(block, list(held))

        rows = _usable(vectors.select("id", "v"), width).mapInArrow(deal, "id long, v array<double>, list int") if len(centres) else vectors.select("id", "v", F.lit(0).alias("list")).limit(0)
        packed = rows.hint("rebalance", "list").sortWithinPartitions("list", "id").mapInArrow(pack, "list int, n int, ids binary, numbers binary")
        packed.write.partitionBy("list").parquet(path)
        return cls(path, centres)

    def blocks(self, spark) -> DataFrame:
        return spark.read.schema("n int, ids binary, numbers binary, list int").parquet(self.path)

    def probes_for(self, queries: DataFrame, vectors: DataFrame, k: int, target: float, groups: int) -> int:
        """The least number of lists to probe for `target` recall of k neighbours, measured on `MEASURED` queries, by the digest of their ids, against exact search among all vectors.

        A neighbour is found if its list is among those probed, so one exact search tells the recall of every number.
        """
        width = self.centres.shape[1]
        drawn = _usable(queries.select("id", "v"), width).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MEASURED)
        near = nearest(drawn, vectors.select("id", "v"), k, groups).select("query", "neighbour").alias("n")
        own = near.join(drawn.alias("q"), F.col("n.query") == F.col("q.id")).join(_usable(vectors.select("id", "v"), width).alias("x"), F.col("n.neighbour") == F.col("x.id"))
        held = own.select(F.col("q.v").alias("q"), F.col("x.v").alias("x")).toArrow()  # `MEASURED` times k rows
        if not held.num_rows:
            return len(self.centres)
        q, x = (_matrix(held[c].combine_chunks(), width) for c in ("q", "x"))
        near, _ = _assigned(x, self.centres)
        apart = (self.centres**2).sum(1)[None, :] - 2 * q @ self.centres.T
        place = (np.argsort(apart, 1, kind="stable") == near[:, None]).argmax(1)
        reached = np.cumsum(np.bincount(place, minlength=len(self.centres))) / len(place)
        return int(np.argmax(reached >= target - 1e-12)) + 1

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, neighbour, likeness, place): k vectors of great inner product with each query (id, v), of its `probes` nearest lists; of all lists it is exact.

        Only folders of lists that some query probes are read. A query goes to each part of its lists,
        `BLOCKS` blocks a part, so a list that holds most vectors is many tasks; k rows of each query and
        block are shuffled. A vector of the query's own id is left out. Of equal ones the least id comes first.
        """
        spark, centres, width = queries.sparkSession, self.centres, self.centres.shape[1]
        shared, probes = spark.sparkContext.broadcast(centres), min(probes, len(centres))
        if not probes:
            return spark.createDataFrame([], "query long, neighbour long, likeness double, place int")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norms = (shared.value**2).sum(1)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1), width)
                    near = np.argsort(norms[None, :] - 2 * x @ shared.value.T, 1, kind="stable")[:, :probes]
                    of = np.repeat(np.arange(len(x)), probes)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(near.ravel(), pa.int32())], ["id", "v", "list"])

        probed = _usable(queries.select("id", "v"), width).mapInArrow(probe, "id long, v array<double>, list int")
        wanted = [r[0] for r in probed.select("list").distinct().collect()]  # `LISTS` at most
        stored = self.blocks(spark).where(F.col("list").isin(wanted))
        # a part of a list: its blocks, `BLOCKS` of them on the average; the number of parts is a row for each list
        parts = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCKS).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("ids"), F.col("parts").cast("long"))
        x = stored.join(F.broadcast(parts), "list").withColumn("part", part)
        q = probed.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        one = Window.partitionBy("list", "part").orderBy("id")
        q = q.withColumn("block", F.floor((F.row_number().over(one) - 1) / QUERIES)).groupBy("list", "part", "block").agg(F.collect_list(F.struct("id", "v")).alias("q"))
        pairs = x.join(q, ["list", "part"]).select("ids", "numbers", "q.id", "q.v")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in range(b.num_rows):
                    i = np.frombuffer(b.column(0)[n].as_py(), np.int64)
                    rows = np.frombuffer(b.column(1)[n].as_py()).reshape(len(i), width)
                    j = b.column(2)[n].values.to_numpy()
                    like = np.round(_matrix(b.column(3)[n].values, width) @ rows.T, DIGITS)
                    like[j[:, None] == i[None, :]] = -np.inf
                    order = np.argsort(i, kind="stable")
                    best = order[np.argsort(-like[:, order], 1, kind="stable")[:, :k]]
                    got = np.take_along_axis(like, best, 1)
                    live = got > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(j, live.sum(1))), pa.array(i[best][live]), pa.array(got[live])], ["query", "neighbour", "likeness"])

        few = pairs.mapInArrow(multiply, "query long, neighbour long, likeness double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("likeness"), "neighbour"))
        return few.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query, wanted, hit: how many of the exact neighbours of each query were found."""
    got = found.select("query", "neighbour", F.lit(1).alias("hit"))
    return exact.select("query", "neighbour").join(got, ["query", "neighbour"], "left").groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hit"))
