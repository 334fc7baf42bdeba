"""Column functions over texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def share(text: Column, kind: str) -> Column:
    """The share of characters that match a regular expression's class, null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, f"[^{kind}]", "")), F.length(text))


def mean_word_length(text: Column) -> Column:
    w = words(text)
    return F.try_divide(F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)), F.size(w))
