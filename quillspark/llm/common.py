"""What the operators of this subpackage share: staged tables, distributed ranks, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.tables import shared_dir

#: Bytes of text handed to one step of a Python worker at a time.
SLICE_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, not only by rows: long texts don't make a batch large. Holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can: a worker is kept for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def stage(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, outlives executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes staged folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """Staged tables of one piece of work, deleted together once its result is staged elsewhere."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        small_batches(self.spark)
        self.paths.append(f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def close(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def offsets_of(sizes: DataFrame, part: str, n: str) -> DataFrame:
    """(__part int, __offset long): what the parts before each hold together. One row for each part comes to the driver."""
    spark = sizes.sparkSession
    rows, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r[part]):
        rows.append((r[part], total))
        total += r[n]
    return spark.createDataFrame(rows, "__part int, __offset long")


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], rank: str, what: str, put: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """df with a gapless rank from 0 within keys, without gathering a key in one task.

    Rows are dealt by ranges of (keys, order) and sorted; the place in the partition
    is corrected by what earlier partitions hold of the key. The correction has at most
    one row for each key and one more for each partition, so keys must be few.
    """
    spark = df.sparkSession
    by = [*keys, *order]
    laid = df.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    laid = put(laid.withColumn("__at", F.monotonically_increasing_id()), what)
    laid = laid.withColumn("__pid", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    held = laid.groupBy(*keys, "__pid").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = T.StructType([*(laid.schema[k] for k in keys), T.StructField("__pid", T.LongType()), T.StructField("__add", T.LongType())])
    rows, seen = [], {}
    for r in sorted(held.collect(), key=lambda r: r["__pid"]):
        key = tuple(r[k] for k in keys)
        rows.append((*key, r["__pid"], seen.get(key, 0) - r["__first"]))
        seen[key] = seen.get(key, 0) + r["__n"]
    add = F.broadcast(spark.createDataFrame(rows, before).withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__pid": "__k_pid"}))
    same = laid["__pid"] == add["__k_pid"]
    for k in keys:
        same &= laid[k].eqNullSafe(add[f"__k_{k}"])
    return laid.join(add, same).withColumn(rank, F.col("__row") + F.col("__add")).drop("__at", "__pid", "__row", "__add", "__k_pid", *(f"__k_{k}" for k in keys))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, one row at least."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        step = max(1, min(n, int(n * size / max(1, b.column(b.schema.get_field_index(text)).nbytes))))
        for i in range(0, n, step):
            yield b.slice(i, step)


def per_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str, text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of text; make() runs once in each task and returns the step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in slices(batches, text, size):
            yield step(b)
        del step
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the sieve: 2**BITS, in words of 64, so that what is broadcast has 2**(BITS - 6) rows at most.
BITS = 24


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _sieve(df: DataFrame, column: str, ids: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with a column of truth values, and its name: false where `column` is surely none of the ids.

    The more ids the more rows may be one; the broadcast stays of one size.
    """
    w, bits, maybe = (unused(c, df) for c in ("__word", "__bits", "__maybe"))

    def spot(c: str) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << BITS))
        return F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))

    word, bit = spot(key)
    words = ids.select(word.alias(w), bit.alias("bit")).groupBy(w).agg(F.bit_or("bit").alias(bits))
    word, bit = spot(column)
    found = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return df.join(F.broadcast(words), word == F.col(w), "left").withColumn(maybe, found).drop(w, bits), maybe


def likely(df: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """df without most of the rows whose `column` is none of the ids, and without a shuffle. Columns may have any names."""
    told, maybe = _sieve(df, column, ids, key)
    return told.where(F.col(maybe)).drop(maybe)


def having(df: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose `column` is one of the ids; few others are shuffled."""
    own = unused("__key", df)
    return likely(df, column, ids, key).join(ids.select(F.col(key).alias(own)), F.col(column) == F.col(own), "left_semi")


def lacking(df: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose `column` is none of the ids, null too; few of them are shuffled."""
    own = unused("__key", df)
    told, maybe = _sieve(df, column, ids, key)
    rest = told.where(F.col(maybe)).drop(maybe).join(ids.select(F.col(key).alias(own)), F.col(column) == F.col(own), "left_anti")
    return told.where(~F.col(maybe)).drop(maybe).unionAll(rest)
