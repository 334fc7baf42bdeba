"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

1. Texts with one shingle set are one class; its least doc_id stands for it.
2. The signature of a class is cut into bands; classes that agree in a band share a bucket.
   The least class of a bucket is its pivot.
3. Each pair (pivot, member) is compared on full sets, which gives its links and the
   difference D of the two sets.
4. Two other members x, y of a pivot are compared only where they can still be linked:
   |x ^ y| = |D_x| + |D_y| - 2 |D_x & D_y|, and D_x & D_y holds only what occurs in several
   differences of this pivot. Where that bound exceeds what the similarity allows, no link is
   possible, so a large group of copies isn't taken pair by pair and none of its links is lost.
5. Components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, having, lacking, per_slice, read, slices, stage
from .components import components
from .minhash import Words, bands, shingles, signature

#: Members of a pivot that meet each other in one piece of work; more are split.
MEMBERS = 512

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Size, two sums that stand for the shingle set, and bands of each document."""

    def make() -> Callable:
        known = Words()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n, h1, h2, found = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py().encode() if t.is_valid else b"", k, known)
                n.append(len(s))
                h1.append(s.sum(dtype=np.uint64).view(np.int64))
                h2.append((s * s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(17))).sum(dtype=np.uint64).view(np.int64))
                found.append(bands(signature(s)).view(np.int64) if len(s) else None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.int64)), pa.array(np.array(h2, np.int64)), pa.array(found, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "h1", "h2", "bands"])

        return step

    return per_slice(doc_texts(docs), make, SIGNED)


COMPARED = "a long, b long, n_a int, n_b int, shared int, linked boolean, apart binary"


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int, differences: bool) -> DataFrame:
    """Pairs (a, b) of doc_ids compared on the full sets of their texts.

    apart: the sorted 32-bit hashes of what only one of the two holds (different ones may meet,
    which makes a bound on it looser, never wrong).
    """
    needed = stage(pairs.select(F.col("a").alias("__id")).unionAll(pairs.select("b")).distinct(), "needed")
    texts = stage(having(doc_texts(docs).where("text is not null"), "doc_id", needed, "__id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    with_b = pairs.join(texts.withColumnsRenamed({"doc_id": "__b", "text": "text_b"}), F.col("b") == F.col("__b")).select("a", "b", "text_b")
    both = with_b.join(texts.withColumnsRenamed({"doc_id": "__a", "text": "text_a"}), F.col("a") == F.col("__a")).select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, own = Words(), None, None
        for batch in slices(batches, "text_b"):
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (a, ta):
                    last, own = (a, ta), shingles(ta.encode(), k, known)
                other = shingles(tb.encode(), k, known)
                apart = np.setxor1d(own, other, assume_unique=True)
                shared = (len(own) + len(other) - len(apart)) // 2
                linked = 100 * shared >= percent * (shared + len(apart))
                rows.append((a, b, len(own), len(other), shared, linked, (apart >> np.uint64(32)).astype(np.uint32).tobytes() if differences else None))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["a", "b", "n_a", "n_b", "shared", "linked", "apart"])

    return stage(both.mapInArrow(compare, COMPARED), "compared")


def remaining(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), each two members of a pivot in different components that may be linked still."""
    label = labels.select(F.col("node").alias("__n"), "label")
    here = star.join(label, star["b"] == label["__n"], "left").select("a", "b", "n_b", "n_a", "shared", "apart", F.coalesce("label", "b").alias("label"))
    # pivots whose members, itself included, are of several components
    own = here.groupBy("a").agg(F.min("label").alias("__low"), F.max("label").alias("__high"))
    open_ = own.where("__low < __high").select(F.col("a").alias("__p"))
    here = stage(here.join(open_, here["a"] == open_["__p"], "left_semi"), "members")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, apart in zip(*batch.columns, strict=True):
                e = np.frombuffer(apart.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), a.as_py(), np.int64)), pa.array(np.full(len(e), b.as_py(), np.int64)), pa.array(e)], ["a", "b", "e"])

    one = here.select("a", "b", "apart").mapInArrow(spread, "a long, b long, e long")
    # an element held by one member is of no use; for one held by several, all but the least member learn of it from the
    # sum, so only sums go on: how many of a member's elements are its alone
    alone = one.groupBy("a", "e").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("alone"))
    alone = alone.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "alone")
    size = F.col("n_b")
    differ = F.col("n_a") + F.col("n_b") - 2 * F.col("shared")
    # linked: |x ^ y| <= rate * (|x| + |y|)
    rate = (100 - percent) / (100 + percent)
    m = here.join(alone, (here["a"] == alone["__a"]) & (here["b"] == alone["__b"]), "left").select(
        "a", "b", "label", (differ - rate * size).alias("over"), (2 * (differ - F.coalesce("alone", F.lit(0))) - (differ - rate * size)).alias("may"))
    m = stage(m, "bounds")
    # over_x + over_y <= 2 c_x and <= 2 c_y, where c counts what isn't a member's alone
    # a member that no other member's bound reaches goes first
    most = m.groupBy("a").agg(F.max("may").alias("__may"), F.min("over").alias("__over"), F.count(F.lit(1)).alias("__n"))
    fit = m.join(most.withColumnRenamed("a", "__p"), F.col("a") == F.col("__p")).where("over <= __may + 1e-6 and __over <= may + 1e-6")
    # a pivot's members are dealt to parts of MEMBERS, and each two parts meet by themselves: no task gets all pairs of a large group
    parts = F.ceil(F.col("__n") / MEMBERS)
    fit = fit.withColumn("own", F.pmod(F.xxhash64("b"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__p", "__may", "__over", "__n")
    x, y = (fit.select(*(F.col(c).alias(f"{s}_{c}") for c in fit.columns)) for s in "xy")
    pairs = x.join(y, (F.col("x_a") == F.col("y_a")) & (F.col("x_own") == F.col("y_other")) & (F.col("x_other") == F.col("y_own")) & (F.col("x_b") < F.col("y_b")) & (F.col("x_label") != F.col("y_label"))
                   & (F.col("x_over") <= F.col("y_may") + 1e-6) & (F.col("y_over") <= F.col("x_may") + 1e-6))
    return pairs.select(F.col("x_b").alias("a"), F.col("y_b").alias("b")).distinct()


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row: documents are linked at `percent` similarity of k-word shingle sets.

    Null, empty and wordless texts: no shingles, linked with nothing. Long texts are compared by
    their whole sets. Rows that share a doc_id are one document of the graph; where their texts
    differ, the least text is compared. A null doc_id: no component_id (null), kept. Ties go to the
    least doc_id. Empty table: no rows. Columns besides doc_id and text, whatever their names, are ignored.
    """
    rows = stage(signed(docs, k), "signed")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    classes = stage(classes, "classes")
    members = classes.select("rep", F.posexplode("bands")).select("rep", F.xxhash64("pos", "col").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("__most")).where("a < __most").select(F.col("bucket").alias("__b"), "a")
    star = members.join(pivots, members["bucket"] == pivots["__b"]).where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    star = compared(stage(star, "candidates"), docs, k, percent, True)
    labels = components(star.where("linked").select("a", "b"))
    # the pivot is a member of its own group, without a difference
    itself = star.groupBy("a").agg(F.first("n_a").alias("n_a")).select("a", F.col("a").alias("b"), "n_a", F.col("n_a").alias("n_b"), F.col("n_a").alias("shared"), F.lit(True).alias("linked"), F.lit(b"").alias("apart"))
    rest = stage(remaining(star.unionByName(itself), labels, percent), "candidates")
    if rest.limit(1).count():
        more = compared(rest, docs, k, percent, False).where("linked")
        known = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        for side in "ab":
            more = more.join(known, more[side] == F.col("__n"), "left").withColumn(side, F.coalesce("__l", side)).drop("__n", "__l")
        joined = components(more.select("a", "b").where("a <> b"))
        ends = joined.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        labels = labels.join(ends, labels["label"] == ends["__n"], "left").select("node", F.coalesce("__l", "label").alias("label"))
        # a document that had no link before is a component of its own
        labels = labels.unionByName(joined.join(labels.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti"))
    reps = classes.join(labels, classes["rep"] == labels["node"], "left").select(F.col("h1").alias("__1"), F.col("h2").alias("__2"), F.coalesce("label", "rep").alias("__c"))
    reps = stage(reps, "components")
    out = named.join(reps, (named["h1"] == reps["__1"]) & (named["h2"] == reps["__2"]), "left").select("doc_id", "n_shingles", F.col("__c").alias("component_id"))
    out = out.unionAll(rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, all columns, whatever their names; of rows that share a doc_id all or none stay.

    Null, empty and wordless texts stay, as does a null doc_id; long texts are compared whole. Empty table: no rows.
    """
    gone = stage(link(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return lacking(docs, "doc_id", gone, "__gone")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), 4, 80)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + least(len(w), 4) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = x.doc_id) + (SELECT n FROM n WHERE doc_id = y.doc_id) - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
