"""Structured Streaming: windows with watermarks, deduplication, stream joins, state of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.temporal import as_timestamp


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder's table as a stream with event times that can carry a watermark."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders: the table may be one, or a file whose folder holds others
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return as_timestamp(stream, "ts")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def tumbling(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), "event_type", "n")


def first_seen(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows without those whose keys came before within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def followed(first: DataFrame, then: DataFrame, by: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams of one key, the second at most `within` after the first; state is dropped behind the watermarks."""
    a = first.withWatermark("ts", late).select(F.col(by), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", late).select(F.col(by).alias("__k"), F.col("ts").alias("then_ts"))
    return a.join(b, (a[by] == b["__k"]) & (b["then_ts"] >= a["first_ts"]) & (b["then_ts"] <= a["first_ts"] + F.expr(f"interval {within}"))).drop("__k")


def followed_or_not(first: DataFrame, then: DataFrame, by: str, within: str, late: str = "10 minutes") -> DataFrame:
    """The pairs of `followed`, and each first row that none follows, once, with a null then_ts.

    Such a row comes out when the watermark of both streams, the lesser of the two, has left its
    time behind: only then can nothing follow it any more. Null keys follow nothing.
    """
    a = first.withWatermark("ts", late).select(F.col(by), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", late).select(F.col(by).alias("__k"), F.col("ts").alias("then_ts"))
    return a.join(b, (a[by] == b["__k"]) & (b["then_ts"] >= a["first_ts"]) & (b["then_ts"] <= a["first_ts"] + F.expr(f"interval {within}")), "left_outer").drop("__k")


def session_windows(stream: DataFrame, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """by, started, ended, n: closed sessions of a key. Open ones are merged in state as rows come, in whatever order; rows behind the watermark are dropped."""
    w = F.session_window("ts", gap)
    rows = stream.where(F.col(by).isNotNull()).withWatermark("ts", late)
    return rows.groupBy(by, w.alias("__w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).select(by, "started", "ended", "n")


def running_totals(stream: DataFrame) -> DataFrame:
    """For each user, after each batch, events and value so far: a small state by key, in Arrow batches."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for r in rows:
            n, total = n + len(r), total + float(r["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Runs the stream over what is there and returns all that it has written to the folder `out`, this time and before.

    Files are written by the tasks; their log makes each batch count once. Started again with the
    same folders, the stream goes on behind what it has read, with its state and watermark.
    """
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def updates(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Runs the stream in update mode and returns the rows of all batches, with `batch`, from the folder `out`.

    A batch that is run again after a failure replaces its own folder, so it counts once.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    into(stream, "update", checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch long").parquet(out)


def into(stream: DataFrame, mode: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    """Hands each batch with its number to put, which must leave the same for a number it has seen: exactly once in effect."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
