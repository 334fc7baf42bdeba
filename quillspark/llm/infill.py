"""Fill-in-the-middle: texts cut at the ends of two units and laid out anew, and put together again."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, give_back, read, small_batches

#: The units of a text, the marks of prefix, suffix and middle.
UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
P, S, M = "<P>", "<S>", "<M>"

CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cut(text: str, seed: str, moved: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, characters of prefix and of middle, output) of one text."""
    ends = array("I", (m.end() for m in UNIT.finditer(text)))
    n, drawn = len(ends), digest(seed)
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or h3 % 100 >= moved or P in text or S in text or M in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def whole(output: str, form: str) -> str:
    """The text of an output. A text that was moved holds no mark, and none arises where a mark meets it, so the first of each kind is the one that was set."""
    if form == "plain":
        return output
    one, two = (P, S) if form == "psm" else (S, P)
    head, _, rest = output.removeprefix(one).partition(two)
    tail, _, middle = rest.partition(M)
    return head + middle + tail if form == "psm" else tail + middle + head


def transform(docs: DataFrame, seed: int = 1, moved: int = 90, spm: int = 20) -> DataFrame:
    """A row for each document: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256.

    Of 100 documents about `moved` are laid out anew, `spm` of 100 of them suffix first; the digest
    of seed and doc_id decides, so a lost task gives the same again. A null or empty text, or one
    that holds a mark, stays as it is: plain, without counts of characters. Long texts are cut whole:
    four bytes a unit are held for one text at a time, and Arrow batches go by bytes. Repeated rows
    give equal rows, a null doc_id is drawn as no digits, so rows without one are cut by equal draws.
    Two equal draws give an empty middle. An empty table gives none; columns besides doc_id and text,
    whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(CUT)
    def laid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [cut(t, f"{seed}:{i}", moved, spm) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            yield out.assign(output_sha256=[digest(r[4]) for r in rows])
        give_back()

    rows = doc_texts(docs).select("doc_id", laid(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("cut"))
    return rows.select("doc_id", "cut.*")


def restore(rows: DataFrame) -> DataFrame:
    """rows (output, form) of `transform` with the exact text of each, and its digest: text, restored_sha256. A null text comes back empty."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("text string, restored_sha256 string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [whole(o, f) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "restored_sha256": pd.Series([digest(t) for t in texts], dtype=object)})
        give_back()

    return rows.select(*rows.columns, back("output", "form").alias("back")).select(*rows.columns, "back.*")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(transform(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = """WITH units AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS drawn, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
draws AS (SELECT *, len(u)::BIGINT AS n, ('0x' || drawn[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || drawn[9:16])::BIGINT % (len(u) + 1) AS b,
text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || drawn[17:24])::BIGINT % 100 >= 90 AS plain, ('0x' || drawn[25:32])::BIGINT % 100 < 20 AS spm FROM units),
cut AS (SELECT doc_id, n, text, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
array_to_string(u[greatest(a, b) + 1:], '') AS s FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut"""
