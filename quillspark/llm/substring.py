"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is 20 consecutive words. Of the hashes of the 6-word grams in a window the least is
its fingerprint; neighbouring windows mostly share it, so a document has about an eighth as
many fingerprints as words, and equal windows have equal fingerprints.

The index is a list of immutable runs, bucketed and sorted by fingerprint: which document holds
a window of this fingerprint that occurs nowhere earlier. A new batch of documents is merge-joined
with each run; what meets there, or within the batch, is verified, in two steps:

1. A place of a fingerprint is hashed with all words that its windows can hold. Where that
   stretch also occurs earlier, all windows of the place do.
2. The windows of other places are hashed one by one. The first of its like always is among
   them, since it can't occur earlier.

Then the batch's own first windows become a run. When there are several runs, they are compacted
to one. A passage that many documents share has one entry, whatever their number.

Two places are alike if both their fingerprints and these hashes agree: 128 bits, of words that
are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, discard, doc_texts, lacking, likely, partitions, per_slice, ranked, read, shared_dir, stage
from .minhash import mixed, rolled

WINDOW = 20
GRAM = 6
#: Batches of documents that the query adds one after the other.
BATCHES = 4
#: Runs of one tier that are compacted to one of the next.
RUNS = 3
_NOTHING = hashlib.sha256(b"").hexdigest()


#: A place is the rank of its document, then its word in this many bits: a text of 2**31 bytes, the most that a row holds, has no more words.
PLACE = 30
#: Bytes hashed at a time; a text that is longer is cut between words.
PIECE = 2 << 20
#: Bytes of text in one step; some eight arrays of a number for each byte are held meanwhile.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.random.RandomState(19).randint(1, 2**63 - 1, 256, np.int64).astype(np.uint64)
_BYTE[_SPACE] = 0


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, for sums that can be shifted."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            one = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n - 1, b, np.uint64))), dtype=np.uint64)
            self.up, self.down = one(self.base), one(pow(self.base, -1, 2**64))


class Hasher:
    """Hashes the words of many texts at once."""

    def __init__(self) -> None:
        self.bytes, self.words = Powers(_BASE), Powers(0xD6E8FEB86659FD93)

    def _piece(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of bytes that end in white space."""
        self.bytes.reach(len(raw) + 1)
        space = _SPACE[raw]
        edge = np.diff(np.concatenate(([True], space)).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.bytes.up[: len(raw)], out=total[1:])
        return start, mixed((total[end] - total[start]) * self.bytes.down[start] + (end - start).astype(np.uint64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and the number of the text of each."""
        coded = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        starts, hashes, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            while end < len(raw) and not _SPACE[raw[end - 1]]:
                later = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
                end += int(later[0]) + 1 if len(later) else PIECE
            end = min(end, len(raw))
            s, h = self._piece(raw[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        bounds = np.cumsum([len(c) + 1 for c in coded])
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(bounds, start, "right")

    def stretches(self, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of the words from low to high of each stretch."""
        self.words.reach(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.words.up[: len(h)], out=total[1:])
        return mixed((total[high] - total[low]) * self.words.down[low] + (high - low).astype(np.uint64))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Prints:
    """Fingerprints of the windows of many texts: `whole` tells which windows lie in one text."""

    def __init__(self, hasher: Hasher, texts: list[str], window: int, gram: int) -> None:
        self.h, self.doc = hasher(texts)
        self.window, self.gram, n = window, gram, len(self.h) - window + 1
        if n > 0:
            self.grams = rolled(self.h, gram)
            self.low = least(self.grams, window - gram + 1)[:n]
            self.whole = self.doc[:n] == self.doc[window - 1 :]
        else:
            self.grams, self.low, self.whole = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def places(self, of: np.ndarray | None = None) -> np.ndarray:
        """Where the grams are that are the least of some whole window (of those in `of`), each place of one by itself."""
        chosen, n = np.zeros(len(self.grams), bool), len(self.low)
        live = self.whole if of is None else self.whole & of
        for i in range(self.window - self.gram + 1 if n else 0):
            chosen[i : i + n] |= live & (self.grams[i : i + n] == self.low)
        return np.flatnonzero(chosen)

    def again(self, keys: list[np.ndarray]) -> np.ndarray:
        """The windows whose fingerprint is one of the keys of their text."""
        part = lambda key, doc: mixed(key + doc.astype(np.uint64) * np.uint64(_BASE))
        all_keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        return self.whole & np.isin(part(self.low, self.doc[: len(self.low)]), part(all_keys, of))

    def firsts(self) -> np.ndarray:
        """The first word of the text of each word."""
        return np.searchsorted(self.doc, self.doc, "left")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, which stands for both."""
    return doc_texts(docs).select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))


SPLIT = "doc_id long, row long, n_words long, words_sha256 string, keys array<long>"


def split(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The number of words of each document, the digest of its words, and the fingerprint at each place of one."""

    def make() -> Callable:
        hasher = Hasher()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            words = [t.encode().split() for t in texts]
            p = Prints(hasher, texts, window, gram)
            at = p.places()
            ends = np.searchsorted(p.doc[at], np.arange(b.num_rows + 1), "left")
            keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p.grams[at].view(np.int64)))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(map(len, words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]), keys], ["doc_id", "row", "n_words", "words_sha256", "keys"])

        return step

    return per_slice(rows, make, SPLIT, size=SLICE)


def batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """rows in n ranges of doc_id of like size."""
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    if not cuts:
        return [rows]
    d = F.col("doc_id")
    return [rows.where(d.isNull() | (d <= cuts[0])), *(rows.where((d > a) & (d <= b)) for a, b in zip(cuts, cuts[1:], strict=False)), rows.where(d > cuts[-1])]


def _keys(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column]


PLACES = "key long, print long, place long, row long"


def stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, print, place, row): the places of fingerprints that occur again, with a hash of all that their windows can hold."""

    def make() -> Callable:
        hasher = Hasher()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            p = Prints(hasher, b.column(0).to_pylist(), window, gram)
            at = p.places(p.again(_keys(b.column(3))))
            doc, first = p.doc[at], p.firsts()[at]
            low = np.maximum(first, at - (window - gram))
            high = np.minimum(np.searchsorted(p.doc, doc, "right"), at + window)
            f = mixed(hasher.stretches(p.h, low, high) ^ mixed(p.grams[at] + (at - low).astype(np.uint64)))
            place = (b.column(2).to_numpy()[doc] << PLACE) + (at - first)
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(p.grams[at].view(np.int64)), pa.array(place), pa.array(b.column(1).to_numpy()[doc])], ["key", "print", "place", "row"])

        return step

    return per_slice(texts.select("text", "row", "rank", "keys"), make, PLACES, size=SLICE)


def later(found: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(row, at): the places, as words of their text, whose key and fingerprint also occur at a lesser place."""
    first = found.groupBy(F.col("key").alias("__key"), F.col("print").alias("__print")).agg(F.min("place").alias("__first"), F.max("place").alias("__last")).where("__first < __last").drop("__last")
    first = put(first, "firsts")  # so that the join deals both sides anew and a key that many places share is split
    again = found.join(first, (F.col("key") == F.col("__key")) & (F.col("print") == F.col("__print"))).where("place > __first")
    return again.select("row", F.col("place").bitwiseAND((1 << PLACE) - 1).cast("int").alias("at"))


def windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, print, place, row): the windows that are still open, of (text, row, rank, keys, settled)."""

    def make() -> Callable:
        hasher = Hasher()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            p = Prints(hasher, b.column(0).to_pylist(), window, gram)
            first = p.firsts()
            open_ = p.again(_keys(b.column(3)))
            base = np.searchsorted(p.doc, np.arange(b.num_rows), "left")
            done = np.zeros(len(p.h) + 1, np.int32)
            for i, x in enumerate(b.column(4)):
                if x.is_valid:
                    at = x.values.to_numpy() + base[i]
                    np.add.at(done, np.maximum(base[i], at - (window - gram)), 1)
                    np.add.at(done, at + 1, -1)
            at = np.flatnonzero(open_ & (np.cumsum(done)[: len(open_)] == 0))
            k = rolled(p.h, window)[at] if len(at) else np.zeros(0, np.uint64)
            place = (b.column(2).to_numpy()[p.doc[at]] << PLACE) + (at - first[at])
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(p.low[at].view(np.int64)), pa.array(place), pa.array(b.column(1).to_numpy()[p.doc[at]])], ["key", "print", "place", "row"])

        return step

    return per_slice(texts.select("text", "row", "rank", "keys", "settled"), make, PLACES, size=SLICE)


def cleaned(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(__row, gone, sha, open): words removed, digest of the others, fingerprints of windows that are left, of (row, text, low, high)."""

    def make() -> Callable:
        hasher = Hasher()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            p = Prints(hasher, texts, window, gram)
            base = np.searchsorted(p.doc, np.arange(b.num_rows + 1), "left")
            edge, over = np.zeros(len(p.h) + 1, np.int32), np.zeros(len(p.h) + 1, np.int32)
            for i, (low, high) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                if low.is_valid:
                    start = base[i] + np.maximum(0, low.values.to_numpy())
                    end = base[i] + high.values.to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, np.minimum(base[i + 1], end + window), -1)
                    np.add.at(over, start, 1)
                    np.add.at(over, np.minimum(base[i + 1], end + 1), -1)
            keep = np.cumsum(edge[:-1]) == 0
            left = np.flatnonzero(p.whole & (np.cumsum(over)[: len(p.whole)] == 0))
            gone, sha, kept = [], [], []
            for i, t in enumerate(texts):
                words, own = t.encode().split(), np.flatnonzero(keep[base[i] : base[i + 1]])
                gone.append(len(words) - len(own))
                sha.append(hashlib.sha256(b" ".join([words[j] for j in own.tolist()])).hexdigest())
                kept.append(np.unique(p.low[left[slice(*np.searchsorted(left, base[i : i + 2]))]]).view(np.int64))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.list_(pa.int64()))], ["__row", "gone", "sha", "open"])

        return step

    return per_slice(texts.select("row", "text", "low", "high"), make, "__row long, gone long, sha string, open array<long>", size=SLICE)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Index:
    """Windows that documents held first, of all batches so far, in the shared folder.

    Batches come in ascending order of doc_id; rows of one doc_id are in one batch.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> None:
        self.spark, self.window, self.gram, self.buckets = spark, window, gram, buckets or partitions(spark)
        self.folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
        #: names of the runs: (key, row); folders of the ranks (row, rank) and of the texts' digests (words_sha256) of each batch
        self.runs: list[str] = []
        self.tiers: list[int] = []
        self.ranks: list[DataFrame] = []
        self.digests: list[DataFrame] = []
        self.documents = 0

    def _table(self, df: DataFrame, by: str) -> str:
        name = f"window_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, f"{self.folder}/{name}")

    def _keep(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, pairs: DataFrame) -> None:
        """(key, row) becomes a run of tier 0; where that makes `RUNS` of a tier, they are compacted to one of the next, and so on, all in one pass.

        A run is rewritten only together with runs of its own tier, so each pair is written once for each tier that the history has, which grows with its logarithm.
        """
        tier, old = 0, []
        while self.tiers[len(self.tiers) - len(old) - RUNS + 1 : len(self.tiers) - len(old)] == [tier] * (RUNS - 1):
            old += self.runs[len(self.runs) - len(old) - RUNS + 1 : len(self.runs) - len(old)]
            tier += 1
        fresh = reduce(DataFrame.unionAll, map(self.spark.table, old), pairs)
        kept = len(self.runs) - len(old)
        self.runs, self.tiers = [*self.runs[:kept], self._table(fresh.repartition(self.buckets, "key"), "key")], [*self.tiers[:kept], tier]
        self._drop(old)

    def met(self, keys: DataFrame) -> DataFrame:
        """(key, row) of the history whose key is one of keys: a merge join with each run. Runs are bucketed by key, so only keys are shuffled; a bucket's rows are sorted as it is read."""
        known = keys.select(F.col("key").alias("__key"))
        found = [self.spark.table(r).hint("merge").join(known, F.col("key") == F.col("__key")).select("key", "row") for r in self.runs]
        return reduce(DataFrame.unionAll, found) if found else self.spark.createDataFrame([], "key long, row long")

    def add(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """RESULT of a new batch (doc_id, text) against itself and all batches before, whose documents `earlier` holds.

        What joins put into the folder is deleted but for the runs, the ranks and the digests.
        """
        work, window, gram = Stages(self.spark), self.window, self.gram
        rows = keyed(batch)
        held = work(split(rows, window, gram), "words")
        all_rows = held.drop("keys")
        # a document with the words of an earlier one goes whole, and what it holds starts there already
        order = F.coalesce("doc_id", F.lit(-(1 << 63)))
        first = all_rows.groupBy(F.col("words_sha256").alias("__w")).agg(F.min(order).alias("__first"))
        if self.digests:
            before = reduce(DataFrame.unionAll, self.digests).select(F.col("words_sha256").alias("__d"), F.lit(True).alias("__old"))
            first = first.join(before, F.col("__w") == F.col("__d"), "left").drop("__d")
        else:
            first = first.withColumn("__old", F.lit(None).cast("boolean"))
        first = work(first, "first-words")
        again = F.col("__old").isNotNull() | (order > F.col("__first"))
        all_rows = work(all_rows.join(first, F.col("words_sha256") == F.col("__w")).select("doc_id", "row", "n_words", "words_sha256", (again & (F.col("n_words") >= window)).alias("copy")), "copies")
        self.digests.append(self._keep(first.where("__old is null").select(F.col("__w").alias("words_sha256")), "digests"))
        here = ranked(all_rows.where("not copy").select("doc_id", "row").distinct(), [], ["doc_id", "row"], "rank", "order", work)
        here = here.select("row", (F.col("rank") + self.documents).alias("rank"))
        self.ranks.append(self._keep(here, "ranks"))
        start = self.documents
        self.documents += self.ranks[-1].count()
        if self.documents >= 1 << 63 - PLACE:
            raise ValueError(f"more than {1 << 63 - PLACE} documents in one index")

        # whole copies hold nothing new; the others' fingerprints are counted by key, which a passage in many documents doesn't burden
        copies = work(all_rows.where("copy").select(F.col("row").alias("__copy")).distinct(), "copies")
        fresh = work(lacking(held.select("row", "keys"), "row", copies, "__copy"), "prints")
        own = fresh.select("row", F.explode("keys").alias("key"))
        counts = work(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
        old = work(self.met(counts), "met")
        twice = work(counts.where("n > 1").select(F.col("key").alias("__k")).unionAll(old.select("key")).distinct(), "again")
        hits = own.join(twice, F.col("key") == F.col("__k")).select("row", "key").unionAll(old.select("row", "key"))
        hits = hits.groupBy(F.col("row").alias("__row")).agg(F.collect_set("key").alias("keys"))
        ranks = reduce(DataFrame.unionAll, self.ranks)
        hits = work(hits.join(ranks, F.col("__row") == ranks["row"]).select("__row", "rank", "keys"), "hits")

        # text goes through one shuffle, to buckets by row, in which all that follows meets it
        source = rows if earlier is None else rows.unionByName(keyed(earlier))
        few = likely(source.select("row", "text"), "row", hits, "__row")
        found = few.join(hits, F.col("row") == F.col("__row")).drop("__row").dropDuplicates(["row"]).select("row", "rank", "text", "keys")
        name = self._table(found, "row")
        texts = self.spark.table(name)
        settled = work(later(work(stretches(texts, window, gram), "stretches"), work), "settled")
        lists = settled.groupBy(F.col("row").alias("__row")).agg(F.collect_set("at").alias("settled"))
        open_ = texts.join(lists, F.col("row") == F.col("__row"), "left")
        single = later(work(windows(open_, window, gram), "windows"), work)
        # a settled place stands for the windows that hold it
        cut = settled.select("row", (F.col("at") - (window - gram)).alias("low"), F.col("at").alias("high")).unionAll(single.select("row", F.col("at").alias("low"), F.col("at").alias("high")))
        cut = work(cut.groupBy(F.col("row").alias("__row")).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "cut")
        new = texts.where(F.col("rank") >= start).select("row", "text").join(cut, F.col("row") == F.col("__row"), "left")
        changed = work(cleaned(new, window, gram), "changed")
        out = all_rows.join(changed, F.col("row") == F.col("__row"), "left").select(
            "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("sha", "words_sha256")).alias("kept_sha256"))
        out = stage(out, "cleaned")
        untouched = lacking(fresh, "row", changed, "__row").select(F.explode(F.array_distinct("keys")).alias("key"), "row")
        self.run(untouched.unionAll(changed.select(F.explode("open").alias("key"), F.col("__row").alias("row"))))
        self._drop([name])
        work.close()
        return out

    def close(self) -> None:
        """Deletes the index."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE {r}")
        discard(self.spark, self.folder)
        self.runs, self.tiers, self.ranks, self.digests = [], [], [], []


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, n_batches: int = BATCHES) -> DataFrame:
    """For each row doc_id, n_words, n_removed, kept_sha256: without the words of windows that also start earlier.

    Null and empty texts: no words. Fewer words than a window: nothing is removed. Long texts are
    hashed in pieces and judged whole. Repeated rows are one document: neither is earlier. A null
    doc_id comes first. Other texts of one doc_id come one after the other, in the order of a hash.
    Empty table: no rows. Columns besides doc_id and text, whatever their names, are ignored.
    """
    docs = doc_texts(docs)
    index, out, earlier = Index(docs.sparkSession, window, gram), [], None
    for batch in batches(docs, n_batches):
        out.append(index.add(batch, earlier))
        earlier = batch if earlier is None else earlier.unionAll(batch)
    index.close()
    return reduce(DataFrame.unionAll, out)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT g, min({'d': doc_id, 'i': i}) AS first FROM g GROUP BY g HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM g JOIN f USING (g) WHERE {'d': doc_id, 'i': i} > first),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT w.doc_id, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE r.p IS NULL) AS kept FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.p = r.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
