"""Recursion over data: what can be reached along links, by rounds that join new facts alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import shared_dir


def reached(links: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, steps): the nodes of starts (node) and all that links (a, b) lead to from there, with the least number of links.

    Each round joins only what the round before found with the links, drops what is known, and is
    written to the shared folder, so lineage stays short and a lost executor's work is read again. It ends when
    a round finds nothing, or after `rounds`. Links are read once and kept there too. Null nodes reach nothing; cycles,
    loops, repeated links and starts without links are fine. The result reads one small table for each round.
    """
    spark, folder = links.sparkSession, f"{shared_dir(links.sparkSession)}/reached-{uuid.uuid4().hex}"
    kind = dict(starts.dtypes)["node"]

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = keep(links.where("a is not null and b is not null and a <> b").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).distinct(), "links")
    new = keep(starts.where("node is not null").select("node", F.lit(0).alias("steps")).distinct(), "steps=0")
    known, steps = new, 0
    while rounds is None or steps < rounds:
        steps += 1
        ahead = links.join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        new = keep(ahead.join(known.select("node"), "node", "left_anti").select("node", F.lit(steps).alias("steps")), f"steps={steps}")
        if new.isEmpty():
            break
        known = known.unionAll(new)
    return known
