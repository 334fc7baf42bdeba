"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are streamed
through it, keeping the longest run that ends at each word and occurs in an item; where
that run is as long as a window, the window's words are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_texts, per_slice, read, stage, unused

WINDOW = 10
#: Bytes of item text in one automaton; more items are taken in several passes over the documents.
PASS_BYTES = 2 << 20
_BREAK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SCANNED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_BREAK).split()


class Automaton:
    """Suffix automaton of many word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[list[str], bytes]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = []
        for names, text in items:
            if seq := [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]:
                seqs.append((names, seq))
                last = 0
                for t in seq:
                    last = self._extend(last, t)
        self.shortest = min((min(len(s), window) for _, s in seqs), default=0)
        #: of windows: state -> the items that hold it; of items shorter than a window: state -> (length, items)
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for names, seq in seqs:
            if len(seq) < window:
                at = 0
                for t in seq:
                    at = self.next[at][t]
                self.short.setdefault(at, (len(seq), set()))[1].update(names)
            else:
                for at, n in self.walk(seq):
                    if n >= window:
                        self.full.setdefault(self._of_length(at, window), set()).update(names)

    def _extend(self, last: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if t in nxt[last]:
            q = nxt[last][t]
            return q if length[q] == length[last] + 1 else self._clone(last, t, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and t not in nxt[p]:
            nxt[p][t] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][t]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, t, q)
        return cur

    def _clone(self, p: int, t: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = new
            p = self.link[p]
        return new

    def _of_length(self, at: int, n: int) -> int:
        """The state, at or above `at`, of the suffix of n words."""
        while self.length[self.link[at]] >= n:
            at = self.link[at]
        return at

    def walk(self, seq: Iterable[int]) -> list[tuple[int, int]]:
        """State and length of the longest matching run that ends at each word."""
        nxt, link, length, at, n, out = self.next, self.link, self.length, 0, 0, []
        for t in seq:
            to = nxt[at].get(t)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(t)
            if to is not None:
                at, n = to, n + 1
            out.append((at, n))
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the hit spans of words (sorted, disjoint), the items that have an occurring window."""
        words = words_of(text)
        if not self.shortest or len(words) < self.shortest:
            return len(words), [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        # a word of no item ends every run, so only stretches of known words, long enough for a window, are streamed
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        found, items = [], set()
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= self.shortest].tolist():
            for i, (at, n) in enumerate(self.walk(ids[a:b].tolist()), a + 1):
                if n < self.shortest:
                    continue
                if n >= self.window:
                    found.append((i - self.window, i))
                    items |= self.full[self._of_length(at, self.window)]
                while self.short and at > 0:
                    if (s := self.short.get(at)) and n >= s[0]:
                        found.append((i - s[0], i))
                        items |= s[1]
                    at = self.link[at]
        return len(words), merged(found), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")


def _texts(benchmark: DataFrame) -> DataFrame:
    """Each text of an item once, with the ids of its items."""
    return _items(benchmark).groupBy("text").agg(F.collect_set("item_id").alias("ids"))


def pass_count(benchmark: DataFrame) -> int:
    """How many passes PASS_BYTES of different items each make."""
    total = _texts(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // PASS_BYTES))


def automata(benchmark: DataFrame, passes: int, window: int = WINDOW) -> Iterable[Automaton]:
    """One automaton for each pass; only the items of one are on the driver or in a worker at once."""
    items = _texts(benchmark)
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
        yield Automaton([(r["ids"], bytes(r["text"])) for r in part.collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", into: str = "scanned", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, result: T.StructType | str | None = None) -> DataFrame:
    """docs with a struct `into`: n_words, spans (hit words, end exclusive), items (ids as strings, sorted).

    Null and empty texts have no words; long ones are streamed whole. Items without words match
    nothing; items without an id hit words but aren't listed; items that share an id count once,
    items that share a text (a tie) are all listed. All columns and repeated rows are kept, but a
    column named as `into` gives way. Empty documents: no rows; no items: nothing is hit.
    `then` makes rows of the schema `result` of the last pass's batches, in the same workers.
    """
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, SCANNED)])
    names = [f.name for f in schema.fields[:-1]]
    out, passes = docs, pass_count(benchmark)
    for k, built in enumerate(automata(benchmark, passes, window)):
        shared = docs.sparkSession.sparkContext.broadcast(built)

        last = then is not None and k == passes - 1

        def make(shared=shared, again=k > 0, last=last):
            own = shared.value

            def step(b: pa.RecordBatch) -> pa.RecordBatch:
                rows = []
                old = b.column(b.schema.get_field_index(into)).to_pylist() if again else repeat(None)
                for t, was in zip(b.column(b.schema.get_field_index(text)), old, strict=False):
                    n, spans, items = own.scan(t.as_py().encode() if t.is_valid else b"")
                    if was:
                        spans, items = merged([*spans, *((s["start"], s["end"]) for s in was["spans"])]), items | set(was["items"])
                    rows.append({"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)})
                spans_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                col = pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", spans_t), ("items", pa.list_(pa.string()))]))
                out = pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), col], [*names, into])
                return then(out) if last else out

            return step

        out = per_slice(stage(out, "decontamination") if k else out, make, result if last else schema, text)
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_cover: float = 0.5) -> DataFrame:
    """docs without hit spans; a document goes if more than max_cover of its words are hit.

    The columns, whatever their names, and all other rows stay as they are; null texts stay. Long texts are
    streamed whole, repeated rows treated alike; a document of exactly max_cover stays. Empty documents: no rows.
    """
    into, columns = unused("__scanned", docs), docs.columns

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        out, keep = [], []
        for t, s in zip(texts, b.column(b.schema.get_field_index(into)).to_pylist(), strict=True):
            spans = [(x["start"], x["end"]) for x in s["spans"]]
            hit = sum(e - a for a, e in spans)
            keep.append(hit <= max_cover * s["n_words"])
            out.append(without(t, spans) if hit and keep[-1] else t)
        cols = [pa.array(out, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in columns]
        return pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(keep, pa.bool_()))

    return scan(docs, benchmark, window, into=into, then=clean, result=docs.schema)


def digest(b: pa.RecordBatch) -> pa.RecordBatch:
    """The query's columns of a scanned batch."""
    s = b.column(b.schema.get_field_index("scanned")).to_pylist()
    hit = [sum(x["end"] - x["start"] for x in r["spans"]) for r in s]
    cols = [b.column(b.schema.get_field_index("doc_id")), pa.array([r["n_words"] for r in s], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(r["items"]) for r in s], pa.int64())]
    cols += [pa.array([hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in s], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return scan(doc_texts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), then=digest, result=schema)



OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
