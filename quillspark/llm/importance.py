"""Importance resampling towards a target's distribution of n-grams, through a dictionary of distinct features.

N-gram strings are counted over all documents and over the target; each distinct string is hashed
once, in the dictionary; buckets are summed from it, and their gains go back, by string, to the
counts of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, doc_texts, give_back, per_slice, ranked, read, slices, small_batches

BUCKETS = 10_000
GRAMS = (1, 1)
PERCENT, SEED, LEAST_WORDS = 10, 2024, 20
#: Features looked up from memory at most: the most frequent ones; all others meet the dictionary in a join.
HEAD = 1 << 16
#: A key of so many bytes at most stands for its feature: itself where it is no longer, else a space and its SHA-256.
KEY_BYTES = 64
#: Distinct features that a task holds before it hands their counts on.
HELD = 400_000

_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

COUNTED = "feature string, n long"
COUNTS = "doc_id long, n_words long, n_features long, known long, keys array<string>, counts array<long>"


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts one after the other, A-Z lower-cased, and where each text's begin (one number more than texts). A null text has none."""
    texts = pc.fill_null(texts, "")
    _, spots, data = texts.buffers()
    offsets = np.frombuffer(spots, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > low) & (offsets < high)] - low
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    kept = _LOWER[raw[inside]]
    # where a word's letters begin among those kept
    ends = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept))
    return words, np.searchsorted(start, offsets - low)


def features_of(texts: pa.Array, grams: tuple[int, int] = GRAMS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of grams[0] to grams[1] words of each text, repeats and all: the strings, the row of the text that each is of, and each text's number of words."""
    words, at = words_of(texts)
    n_words = np.diff(at)
    of = np.repeat(np.arange(len(n_words)), n_words)
    strings, rows = [], []
    for n in range(grams[0], grams[1] + 1):
        fits = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1 :])
        runs = [words.take(pa.array(fits + i)) for i in range(n)]
        strings.append(runs[0] if n == 1 else pc.binary_join_element_wise(*runs, " "))
        rows.append(of[fits])
    return (pa.concat_arrays(strings), np.concatenate(rows), n_words) if len(strings) > 1 else (strings[0], rows[0], n_words)


def feature_counts(texts: DataFrame, grams: tuple[int, int] = GRAMS) -> DataFrame:
    """(feature, n): counts of what a task has seen, of which those of one feature are still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def total() -> pa.Table:
            got = pa.concat_tables(held).group_by("feature").aggregate([("n", "sum")])
            return pa.table({"feature": got["feature"], "n": got["n_sum"]})

        for b in slices(batches):
            found = pc.value_counts(features_of(b.column(0), grams)[0])
            held.append(pa.table({"feature": found.field(0), "n": found.field(1)}))
            if sum(t.num_rows for t in held) >= HELD:
                held[:] = [total()]
                if held[0].num_rows >= HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from total().to_batches()
        held.clear()
        give_back()

    small_batches(texts.sparkSession)
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def dictionary(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(key, s, t, bucket) of each distinct feature: s times in docs, t times in target; its hash is taken here and nowhere else."""
    both = [feature_counts(df, grams).select("feature", *(F.when(F.lit(mine), F.col("n")).otherwise(0).alias(c) for c, mine in (("s", i == 0), ("t", i == 1)))) for i, df in enumerate((docs, target))]
    found = both[0].unionAll(both[1]).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    raw = F.col("feature").cast("binary")
    key = F.when(F.octet_length("feature") <= KEY_BYTES, F.col("feature")).otherwise(F.concat(F.lit(" "), F.sha2(raw, 256)))
    return found.select(key.alias("key"), "s", "t", F.pmod(F.crc32(raw), F.lit(buckets)).alias("bucket"))


def gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that hold a feature: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a row for each of `buckets` at most."""
    held = words.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    all_s, all_t = held.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return held.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def head(words: DataFrame, size: int = HEAD) -> list[tuple[str, int]]:
    """(key, gain) of the most frequent features, `size` at most: as many whole levels of frequency as fit, eight to a doubling."""
    level = F.floor(8 * F.log2("s"))
    fits, least = 0, None
    for r in words.where("s > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # a few hundred levels
        fits += r["n"]
        if fits > size:
            break
        least = r["level"]
    return [] if least is None else [tuple(r) for r in words.where((F.col("s") > 0) & (level >= least)).select("key", "gain").collect()]


def counts_of_documents(docs: DataFrame, known: list[tuple[str, int]], grams: tuple[int, int] = GRAMS) -> DataFrame:
    """A row for each document: how many words and features, the sum of the gains of its features in `known`, the keys and counts of its others."""
    keys, gain = pa.array([k for k, _ in known], pa.string()), np.array([g for _, g in known] + [0], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((keys, gain))  # `HEAD` keys of `KEY_BYTES` at most

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        keys, gain = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            found, of, n_words = features_of(b.column(1), grams)
            told = found.dictionary_encode()
            size = max(1, len(told.dictionary))
            # each document's distinct features, with their counts
            pairs, n = np.unique(of * size + told.indices.to_numpy(), return_counts=True)
            doc, feature = np.divmod(pairs, size)
            names = told.dictionary
            long = np.flatnonzero(pc.greater(pc.binary_length(names), KEY_BYTES).to_numpy(zero_copy_only=False))
            if len(long):
                list_ = names.to_pylist()
                for i in long.tolist():
                    list_[i] = " " + hashlib.sha256(list_[i].encode()).hexdigest()
                names = pa.array(list_, pa.string())
            spot = pc.fill_null(pc.index_in(names, keys), len(keys)).to_numpy()[feature] if len(names) else np.zeros(0, np.int64)
            rest = spot == len(keys)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, doc, n * gain[spot])
            total = np.bincount(of, minlength=b.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[rest], minlength=b.num_rows)))), pa.int32())
            tail = names.take(pa.array(feature[rest])), pa.array(n[rest], pa.int64())
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(total, pa.int64()), pa.array(sums), *(pa.ListArray.from_arrays(offsets, x) for x in tail)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "known", "keys", "counts"])

        return step

    return per_slice(doc_texts(docs), make, COUNTS)


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, floored, from the digest of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, size: int = HEAD,
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_features, weight, score, rank (from 1; null if not drawn).

    weight is the floored mean of the gains of the document's features, score adds Gumbel noise;
    of the documents of `least_words` words or more the `percent` hundredth of greatest scores
    is drawn, ties to the smaller doc_id (null last). A null or empty text has no words, weight 0 and isn't
    drawn; long texts count whole. Repeated rows count and compete each by itself. Empty documents give
    no rows; an empty target leaves gains by the documents alone. Columns besides doc_id and text,
    whatever their names, are ignored.

    The `size` most frequent features take their gains from memory; each other one is in at most as many
    documents as the least of them is frequent, so the join by string that it goes through has no hot key.
    """
    spark, work = docs.sparkSession, Stages(docs.sparkSession)
    words = work(dictionary(docs, target, grams, buckets), "dictionary")
    words = work(words.join(F.broadcast(gains(words, buckets)), "bucket").select("key", "s", "gain"), "dictionary-gains")
    counts = counts_of_documents(docs, head(words, size), grams).withColumn("row", F.monotonically_increasing_id())
    counts = work(counts, "document-features")
    tail = counts.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    met = tail.join(words.where("s > 0").select("key", "gain"), "key").select("row", (F.col("n") * F.col("gain")).alias("part"))
    met = met.groupBy("row").agg(F.sum("part").alias("rest")).withColumnRenamed("row", "met_row")
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    told = counts.drop("keys", "counts").join(met, F.col("row") == F.col("met_row"), "left").withColumn("total", total).withColumn("weight", weight)
    told = work(told.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score")), "weights")
    laid = ranked(told.withColumn("__in", (F.col("n_words") >= least_words).cast("int")), [], [F.desc("__in"), F.desc("score"), F.asc_nulls_last("doc_id")], "__rank", "resampled")
    drawn = told.where(F.col("n_words") >= least_words).count() * percent // 100
    work.close()
    return laid.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("__rank") < drawn, F.col("__rank") + 1).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


OP12_SQL = """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark),
counted AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
dictionary AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, n AS s, 0 AS t FROM counted UNION ALL SELECT f, 0, 1 FROM b) GROUP BY f),
hashed AS (SELECT f, s, t, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM dictionary, tab),
held AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM held),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - (total % n_features + n_features) % n_features) // n_features ELSE 0 END AS weight,
('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS k FROM drawn)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= k THEN place END AS rank FROM placed"""
