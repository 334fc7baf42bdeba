"""Small documents with what is awkward: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "la", "ri", "p")]
#: Names that operators use on the way.
CLASHING = ("__scanned", "__key", "__word", "__bits", "__maybe", "__rank", "__gone", "__in")
SCHEMA = T.StructType([T.StructField(*f) for f in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.StringType()), ("shard", T.StringType()), ("kept", T.StringType()), ("label", T.StringType()), ("start", T.StringType()), *((c, T.StringType()) for c in CLASHING))])


def prose(r: random.Random, n: int) -> str:
    out = [r.choice(WORDS) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += r.choice((".", ".\n", ","))
    return " ".join(out)


def texts(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    base = [prose(r, n) for n in (1, 3, 5, 19, 20, 21, 60, 100, 400)]
    near = base[7].split(" ")
    near[50] = "changed"
    return [
        None, "", "   \n\t ", "...", *base, base[6], base[6], base[8].upper(), " ".join(near), "a b c d e " * 9, base[7][:200] + " " + base[8][:900], prose(r, 6000),
        "é à ü ñ ß Ω 漢字 🙂 ́ " * 7, "x\x1cy z w  v", base[5] + " " + base[5],
    ]


def documents(spark, rows: list[tuple[int | None, str | None]] | None = None, seed: int = 1, lang: str | None = None):
    """Documents with columns whose names clash with those of results; the third row twice, a null id last."""
    if rows is None:
        found = texts(seed)
        rows = [(3 * i + 1, t) for i, t in enumerate(found)]
        rows += [rows[8], (None, found[6])]
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", None, "z", "q", *CLASHING) for i, t in rows], SCHEMA)


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def in_order(rows: list[tuple]) -> list[tuple]:
    import zlib

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
