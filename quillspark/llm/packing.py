"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, per_slice, ranked, read, stage
from .tokens import encoder, vocabulary

LENGTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of text that a worker remembers at most, and bytes of text it cuts at a time: it keeps the former from task to task.
MEMORY, SLICE = 200_000, 2 << 20
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def fill(stock: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths in stock whose sum comes closest to room from below.

    Bit s of `sums` tells whether s can be reached with the lengths seen so far, longest
    first; the sets before each length are kept, and walked back for the counts.
    """
    mask = (1 << (room + 1)) - 1
    sums, trail = 1, []
    for size in sorted((s for s in stock if s <= room and stock[s] > 0), reverse=True):
        trail.append((size, sums))
        left, step = min(stock[size], room // size), 1
        while left > 0:
            take = min(step, left)
            sums |= (sums << take * size) & mask
            left -= take
            step *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for size, before in reversed(trail):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            used[size] = n
    return used


def plan(stock: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, per sequence, offset of the first).

    Each round opens a window with the longest piece left and fills its rest by `fill`; the
    same filling is repeated while the stock lasts, so rounds follow the number of lengths.
    """
    stock = {k: v for k, v in stock.items() if v > 0}
    given, runs, sequence = dict.fromkeys(stock, 0), [], 0
    while stock:
        longest = max(stock)
        stock[longest] -= 1
        used = fill(stock, length - longest)
        stock[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(stock[k] // n for k, n in used.items()), 0
        for size in sorted(used, reverse=True):
            n = used[size]
            runs.append((size, given[size], given[size] + times * n, sequence, n, offset))
            offset += n * size
            given[size] += times * n
            stock[size] -= times * n
            if not stock[size]:
                del stock[size]
        sequence += times
    return runs


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The ids of each document, with the end id, in pieces of `length` and a rest: a row for each piece."""

    def make() -> Callable:
        enc, end = encoder(path or vocabulary(VOCABULARY), False, MEMORY), np.array([end_id], np.uint32).tobytes()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = enc.encode(b.column(b.schema.get_field_index("text")))
            rows = []
            for doc, x in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), ids, strict=True):
                view = memoryview(x.tobytes() + end)
                n = len(view) // 4
                rows += [(doc, i, min(length, n - i), zlib.crc32(view[4 * i : 4 * (i + length)]), n) for i in range(0, n, length)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return step

    return per_slice(doc_texts(docs), make, PIECES, size=SLICE)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; a long one is cut at every `length` ids. Repeated rows
    are packed each by itself; ties between pieces of one length go by doc_id and start. Empty table:
    no rows. Columns besides doc_id and text, whatever their names, are ignored. Only the count of
    each length, `length` numbers at most, comes to the driver.
    """
    spark = docs.sparkSession
    # staged, as dealing by ranges reads its input twice
    cut = stage(pieces(docs, length, path, end_id), "pieces")
    laid = ranked(cut, ["length"], ["doc_id", "start"], "__rank", "packing")
    stock = {r["length"]: r["n"] for r in laid.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(stock, length), "__l int, __from long, to long, sequence long, n long, offset long")
    runs = runs.groupBy("__l").agg(F.sort_array(F.collect_list(F.struct("to", "__from", "sequence", "n", "offset"))).alias("__runs"))
    # `length` rows at most, with a few runs each
    out = laid.join(F.broadcast(runs), laid["length"] == runs["__l"]).withColumn("__run", F.element_at(F.filter("__runs", lambda x: x["to"] > F.col("__rank")), 1))
    at = F.col("__rank") - F.col("__run.__from")
    return out.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("__run.sequence") + F.floor(at / F.col("__run.n"))).cast("long").alias("sequence_id"),
        (F.col("__run.offset") + F.pmod(at, F.col("__run.n")) * F.col("length")).cast("long").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
