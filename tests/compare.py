"""Rows of a Spark query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import math

import duckdb


def plain(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(v) if isinstance(v, float) else str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sql: str, views: dict[str, str]) -> tuple[list[str], list[tuple]]:
    with duckdb.connect(config={"threads": 2}) as c:
        for name, path in views.items():
            c.sql(f"CREATE VIEW {name} AS FROM '{path}'")
        found = c.sql(sql)
        at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        return [found.columns[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
