"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import doc_texts, per_slice, read

#: Bits of a letter's code (there are some 140,000 letters), and of an n-gram's; above them stands its length.
BITS = 18
GRAM_BITS = 3 * BITS
#: n-grams in a profile.
TOP = 400
#: Profiles are learned from about this many labelled documents at most (all, when there are fewer),
#: chosen by a hash of their text.
SAMPLE = 20_000
#: Code points of text counted at a time.
PIECE = 1 << 20
#: Counts that a task which learns holds before it hands them on.
GRAMS = 1 << 20


@lru_cache(1)
def lower_letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; the code point of its lower case (its own, if that is several)."""
    letter, low = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(x := c.lower()) == 1:
                low[i] = ord(x)
    return letter, low


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def summed(found: list[np.ndarray]) -> np.ndarray:
    """Rows of keys and counts as one: each key once, in order."""
    both = np.concatenate(found, axis=1)
    if len(found) > 1:
        both = both[:, np.argsort(both[0], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], both[0, 1:] != both[0, :-1])))
    return np.stack((both[0, first], np.add.reduceat(both[1], first)))


class Grams:
    """Counts of 1-, 2- and 3-grams of letters and gaps. Every letter has a code of its own, those of the alphabet first."""

    def __init__(self, alphabet: list[int]) -> None:
        letter, low = lower_letters()
        own = np.zeros(0x110000, np.int64)
        every = np.concatenate((np.array(alphabet, np.int64), np.setdiff1d(low[letter], alphabet)))
        own[every] = np.arange(1, len(every) + 1)
        self.code = np.where(letter, own[low], 0)

    def count(self, text: str) -> np.ndarray | None:
        """A row of the n-grams that occur, in order, and one of their counts; None without a letter. Letters at both ends have a gap beside them."""
        p = points(text)
        found, any_letter, tail = [], False, np.zeros(1, np.int64)
        for i in range(0, len(p), PIECE):
            c = self.code[p[i : i + PIECE]]
            any_letter = any_letter or bool(c.any())
            c = np.concatenate((tail, c, np.zeros(2 if i + PIECE >= len(p) else 0, np.int64)))
            c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]  # one gap for many
            if i + PIECE >= len(p):
                c = np.concatenate((c, np.zeros(2, np.int64)))
            if len(c) > 2:
                k = np.sort(c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])
                found.append(summed([np.stack((k, np.ones(len(k), np.int64)))]))
            tail = c[-2:]
        if not any_letter:
            return None
        three = summed(found)
        two = summed([np.stack((three[0] >> BITS, three[1]))])
        one = summed([np.stack((two[0] >> BITS, two[1]))])
        out = []
        for n, x in enumerate((one, two, three)):
            x = x[:, int(x[0, 0] == 0) :]  # gaps alone say nothing
            out.append(np.stack((x[0] | n << GRAM_BITS, x[1])))
        return np.concatenate(out, axis=1)


def ranks(count: np.ndarray, top: int = TOP) -> np.ndarray:
    """The places of the greatest counts, ties by place."""
    at = np.flatnonzero(count)
    if len(at) > top:
        least = np.partition(count[at], len(at) - top)[len(at) - top]
        at = at[count[at] >= least]
    return at[np.lexsort((at, -count[at]))][:top]


class Profiles:
    def __init__(self, alphabet: list[int], langs: list[str], counts: list[np.ndarray]) -> None:
        self.alphabet, self.langs = alphabet, langs
        best = [c[0, ranks(c[1])] for c in counts]
        # the last stands for all that no profile holds
        self.grams = np.append(np.unique(np.concatenate(best)) if best else np.zeros(0, np.int64), 1 << 62)
        self.rank = np.full((max(1, len(langs)), len(self.grams)), TOP, np.int16)
        for i, b in enumerate(best):
            self.rank[i, np.searchsorted(self.grams, b)] = np.arange(len(b))

    def judge(self, grams: Grams, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, and how clearly it wins, 0 to 1."""
        count = grams.count(text) if text and self.langs else None
        if count is None:
            return "und", 0.0
        best = count[0, ranks(count[1])]
        at = np.searchsorted(self.grams, best)
        rank = self.rank[:, np.where(self.grams[at] == best, at, -1)].astype(np.int32)
        away = np.abs(rank - np.arange(len(best), dtype=np.int32))
        away[rank == TOP] = TOP
        d = away.sum(1) / (TOP * max(1, len(best)))
        k = int(d.argmin())
        e = np.exp(-20 * (d - d[k]))
        return self.langs[k], float((1 - d[k]) ** 0.25 / e.sum()) if d[k] < 1 else 0.0


def learn(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from the non-null lang and text of docs, by a bounded sample of documents.

    The bound holds for the documents; what comes to the driver are the letters that occur
    and TOP n-grams of each language.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.select("lang").count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def letters(batches):
        total = np.zeros(0x110000, np.int64)
        letter, low = lower_letters()
        for b in batches:
            for t in b.column(0):
                p = points(t.as_py())
                np.add.at(total, *np.unique(low[p[letter[p]]], return_counts=True))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["c", "n"])

    seen = rows.select("text").mapInArrow(letters, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()
    alphabet = [r["c"] for r in seen]

    def grams(batches):
        own, total, held = Grams(alphabet), {}, 0

        def out():
            for lang, found in total.items():
                for g, n in found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "g", "n"])

        for b in batches:
            for t, lang in zip(b.column(0), b.column(1), strict=True):
                if (c := own.count(t.as_py())) is None:
                    continue
                total.setdefault(lang.as_py(), []).append(c)
                held += c.shape[1]
                if held > GRAMS:
                    total = {k: [summed(found)] for k, found in total.items()}
                    held = sum(found[0].shape[1] for found in total.values())
                    if held > GRAMS // 2:
                        yield from out()
                        total, held = {}, 0
        total = {k: [summed(found)] for k, found in total.items()}
        yield from out()

    counts = rows.mapInArrow(grams, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    # the TOP of each language is all that a profile needs; each task cuts to it before a language meets in one
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))
    best = {}
    for r in counts.withColumn("__place", place).where(F.col("__place") <= TOP).orderBy("lang", "g").collect():
        best.setdefault(r["lang"], []).append((r["g"], r["n"]))
    return Profiles(alphabet, list(best), [np.array(x, np.int64).T for x in best.values()])


def identify(docs: DataFrame, profiles: Profiles, keep: float | None = None) -> DataFrame:
    """docs with lang_pred and score; with `keep`, docs as they are, without those of `und` and those whose score isn't above it: with 0, texts like no language go.

    Nothing learned: only texts without a letter go.
    `und` and 0: null or empty texts, texts without a letter, and all texts if nothing was learned.
    Long texts are counted whole, in pieces. Repeated rows get equal results; of languages at one
    distance (a tie) the first by name holds. Empty table: no rows. Columns named lang_pred or score
    give way to the results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    if keep is None:
        schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("lang_pred", "score")), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    else:
        schema = docs.schema

    def make():
        own = shared.value
        grams = Grams(own.alphabet)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [own.judge(grams, t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            if keep is not None:
                return b.filter(pa.array([g[1] > keep if g[0] != "und" else not own.langs and grams.count(t.as_py() or "") is not None for g, t in zip(got, b.column(b.schema.get_field_index("text")), strict=True)], pa.bool_()))
            cols = [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema.names)

        return step

    return per_slice(docs, make, schema)


def held_out(n: int) -> Column:
    """crc32 of the id as text, by n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs.where(held_out(5) != 0))
    return identify(doc_texts(docs), profiles).select("doc_id", F.coalesce(held_out(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
