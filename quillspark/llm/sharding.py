"""Longest-processing-time sharding of groups that must stay together. Native: DataFrame functions only."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, ranked, read, stage


def place(classes: Iterable[tuple[int, int]], shards: int) -> pa.Table:
    """Longest processing time over (size, groups), largest size first: the runs (size, end, shard).

    Groups go, largest first, to the least-loaded shard of a heap (of equal ones to the lowest). Many
    groups of one size are poured in at once: the level is found up to which all shards fill, what is
    left goes through the heap; the outcome is that of the heap alone. `end` counts groups from the
    largest on: a run holds those from the run before to its own.
    """
    heap, done = [(0, i) for i in range(shards)], 0
    sizes, ends, targets = array("q"), array("q"), array("i")
    for size, n in classes:
        got = dict.fromkeys(range(shards), 0) if n > 2 * shards and size > 0 else {}
        if got:
            low, high = min(heap)[0], max(heap)[0] + (n // shards + 2) * size
            while high - low > 1:
                mid = (low + high) // 2
                if sum(-(-(mid - x) // size) for x, _ in heap if x < mid) <= n:
                    low = mid
                else:
                    high = mid
            filled = []
            for x, i in heap:
                got[i] = -(-(low - x) // size) if x < low else 0
                filled.append((x + got[i] * size, i))
            heap = filled
            heapq.heapify(heap)
        for _ in range(n - sum(got.values())):
            x, i = heap[0]
            got[i] = got.get(i, 0) + 1
            heapq.heapreplace(heap, (x + size, i))
        for i, k in got.items():
            if k:
                done += k
                sizes.append(size)
                ends.append(done)
                targets.append(i)
    return pa.table({"__size": pa.array(sizes, pa.int64()), "__end": pa.array(ends, pa.int64()), "shard": pa.array(targets, pa.int32())})


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts share a shard.

    Null text: size 8, CRC 0, one group of its own (with the empty text, which has the same bytes).
    Long texts count whole; their digest is shuffled, not they. Repeated rows are rows like others.
    Empty table: no rows. Rows with a null doc_id are kept, first in their shard. Ties between groups
    go by the digest of their text. Columns besides doc_id and text, whatever their names, are ignored.

    The driver holds a row for each different size of a group. Different sizes add up to no more
    than the corpus, so that there are fewer than the root of twice its bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = doc_texts(docs).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("__text"))
    rows = stage(rows, "shard-rows")
    groups = rows.groupBy("__text").agg(F.sum("size").alias("__bytes"))
    groups = ranked(groups, [], [F.desc("__bytes"), "__text"], "__rank", "shard-groups")
    classes = groups.groupBy("__bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("__bytes")).toArrow()
    runs = spark.createDataFrame(place(zip(classes["__bytes"].to_pylist(), classes["n"].to_pylist(), strict=True), shards), "__size long, __end long, shard int")
    # `shards` runs of a size at most; joined by size, by shuffle unless the table is small
    runs = runs.groupBy("__size").agg(F.sort_array(F.collect_list(F.struct("__end", "shard"))).alias("__runs"))
    placed = groups.join(runs, groups["__bytes"] == runs["__size"]).select(
        F.col("__text").alias("__t"), F.element_at(F.filter("__runs", lambda x: x["__end"] > F.col("__rank")), 1)["shard"].alias("shard"))
    out = rows.join(placed, rows["__text"] == placed["__t"]).drop("__text", "__t")
    out = ranked(out, ["shard"], ["doc_id", "text_crc32", "size"], "slot", "shard-slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), 24)
