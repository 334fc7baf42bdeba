"""Importance resampling against a plain reading of its rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from quillspark.llm import importance

from .fixtures import SCHEMA, documents, pairs, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams_of(text, grams):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]


def expected(rows, items, percent=10, grams=(1, 1), buckets=10_000, seed=2024, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in grams_of(x, grams)) for texts in ([x for _, x in rows], items))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, x in rows:
        f = grams_of(x, grams)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(order) // 100
    return [(*r, None) for r in out if r[1] < least] + [(*r, i + 1 if i < drawn else None) for i, r in enumerate(order)]


@pytest.mark.parametrize(("size", "grams", "percent", "key"), [(1 << 16, (1, 1), 10, 64), (0, (1, 2), 50, 64), (7, (2, 3), 100, 8)])
def test_equals_the_rules(spark, size, grams, percent, key, monkeypatch):
    """With all, none and few features looked up from memory; with long features that go by their digest."""
    monkeypatch.setattr(importance, "KEY_BYTES", key)
    docs = documents(spark).cache()
    rows = pairs(docs)
    r = random.Random(4)
    items = [prose(r, 30), "A b C d", None, "", "漢字 é"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = importance.resample(docs, target, percent, grams, size=size).collect()
    want = expected(rows, items, percent, grams)
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert sum(r["rank"] is not None for r in got) > (0 if percent == 10 else 5)


def test_hot_and_long_words(spark):
    """A word of 300,000 letters that most documents share, a word in all of them, repeats of one row."""
    long = "é" * 150_000 + "x" * 150_000
    rows = [(i, f"{long if i % 3 else 'short'} " + "common " * 25 + f"word{i}") for i in range(40)] + [(3, "same " * 30)] * 5
    target = spark.createDataFrame([("common word1 word7",)], "text string")
    got = importance.resample(documents(spark, rows), target, 30, size=3).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(rows, ["common word1 word7"], 30))


def test_words_across_texts():
    texts = ["ab", "cd", None, "", " x", "Y ", "é9-9é", "a\0b"]
    for lot in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array([], pa.string())):
        got, at = importance.words_of(lot)
        assert [got.to_pylist()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [words(t) for t in lot.to_pylist()]


def test_empty_tables(spark):
    empty, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.resample(empty, target).count() == 0
    rows = [(1, "a b " * 20), (2, None)]
    got = importance.resample(documents(spark, rows), target, 100).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(rows, [], 100))
