"""Sources and sinks: tables of a folder by name, other formats by their readers, partitioned writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of the folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """The tables as temporary views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir where it is set.

    Unset, a local session gets a temporary folder; any other session must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A csv, json, orc, text, binaryFile or parquet source. csv and json need a schema: none is inferred by a scan."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def save(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Writes df. With `by`, rows of a partition value are brought together first, large values over several
    tasks, so that a value gets few files and none becomes one task."""
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.mode(mode).options(**options).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
