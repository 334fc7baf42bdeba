"""Fill-in-the-middle against a plain reading of its rules."""

import hashlib
import re
from collections import Counter

import pytest

from quillspark.llm import infill

from .fixtures import SCHEMA, documents, pairs


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return doc_id, n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


ODD = [(i, t) for i, t in enumerate(["<P>", "a <S> b", "x<M", "<<P", "<S", "<M<P<S", "\n\n", "é🙂é", "<", "ab<P >cd", "<P<S<M" * 9] * 6)]


@pytest.mark.parametrize("rows", [None, ODD])
def test_equals_the_rules_and_comes_back(spark, rows):
    docs = documents(spark, rows).cache()
    given = pairs(docs)
    out = infill.transform(docs)
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(expected(*r) for r in given)
    assert all(r["output_sha256"] == sha(r["output"]) for r in got)
    back = infill.restore(out).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t in given)
    assert all(r["restored_sha256"] == sha(r["text"]) for r in back)
    assert rows or {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_every_form_of_every_cut_comes_back():
    text = "ab <P b<S\n<M>"[:-1] + "<"
    for i in range(400):
        n, form, p, m, out = infill.cut(text, f"7:{i}", 100, 50)
        assert form in ("psm", "spm") and infill.whole(out, form) == text and n == 12


def test_very_long_text(spark):
    text = "abc. " * 1_500_000
    (r,) = infill.restore(infill.transform(documents(spark, [(5, text)]), moved=100)).collect()
    assert r["n"] == 4_500_000 and r["form"] != "plain" and r["text"] == text and len(r["output"]) == len(text) + 9


def test_empty_table(spark):
    assert infill.restore(infill.transform(spark.createDataFrame([], SCHEMA))).count() == 0
