"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters: words and word beginnings that mark toxic documents among the labelled rows to learn
   from, and patterns of how often and how densely they occur. Terms that mark them beyond
   chance, but are none of the VOTERS that tell most, vote together.
2. Label model: the label is hidden. Each vote is drawn by a rate that depends on the label and on
   the vote of its parent, the voter that it moves with most; expectation maximisation estimates
   the rates (accuracies) and the tree of parents (correlations) from votes alone. The labels enter
   as the weight of ANCHOR documents in each rate, which holds the hidden label to its meaning.
3. Classifier: logistic regression on counts, trained on the posterior labels, then put on the
   scale on which 0.7 divides the labelled rows to learn from; this step does use their labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_texts, per_slice, read, stage
from .minhash import Words, mixed, shingles

#: Labelled documents that are learned from at most, about, chosen by a hash of their id.
SAMPLE = 20_000
#: Documents that the labels weigh in each rate of the label model.
ANCHOR = 20.0
#: Votes that move together more than this, given the label, may be parent and child; the hidden label explains the rest.
TOGETHER = 0.35
#: Lexicon voters with a vote of their own at most; the label model compares each two of them.
VOTERS = 120
#: By chance, one term of all is taken for a mark of toxic documents this often at most.
CHANCE = 0.05
#: Letters of a word beginning that can be a voter.
BEGIN = (4, 5, 6, 7, 8)
PATTERNS = ("two different", "three different", "twice", "four times", "dense", "very dense", "another", "two others")
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """The words (with =) and word beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {w[:n] for w in words for n in BEGIN if len(w) > n}


class Voters:
    def __init__(self, lexicon: list[str], others: list[str] | tuple = ()) -> None:
        """others: terms that vote together; they are numbered behind the lexicon."""
        self.lexicon = lexicon
        self.terms = [*lexicon, *others]
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.heads = frozenset(t.lstrip("=")[: BEGIN[0]] for t in self.terms)

    def hits(self, text: str) -> tuple[dict[int, int], int, int]:
        """Occurrences by term, words that the lexicon knows, all words."""
        words = _WORD.findall(text.lower())
        if self.heads.isdisjoint({w[: BEGIN[0]] for w in words}):
            return {}, 0, len(words)
        got, known = {}, 0
        for w, n in Counter(words).items():
            if w[: BEGIN[0]] in self.heads:
                found = [i for t in (f"={w}", *(w[:k] for k in BEGIN if len(w) > k)) if (i := self.index.get(t)) is not None]
                known += n * any(i < len(self.lexicon) for i in found)
                for i in found:
                    got[i] = got.get(i, 0) + n
        return got, known, len(words)

    def row(self, got: dict[int, int], known: int, words: int) -> np.ndarray:
        """Votes, of the lexicon, then of the patterns; then two numbers: log of known words, their share."""
        x = np.zeros(len(self.lexicon) + len(PATTERNS) + 2)
        own = [i for i in got if i < len(self.lexicon)]
        x[own] = 1
        stems = {self.lexicon[i].lstrip("=")[: BEGIN[0]] for i in own}
        others = {self.terms[i].lstrip("=")[: BEGIN[0]] for i in got if i >= len(self.lexicon)}
        share = known / max(words, 1)
        x[len(self.lexicon) :] = (len(stems) > 1, len(stems) > 2, known > 1, known > 3, share > 0.002 and known > 1, share > 0.01 and known > 1, len(others) > 0, len(others) > 1, np.log1p(known), min(1.0, 10 * share))
        return x


class LabelModel:
    """Hidden label, and a tree of votes given it; fitted by expectation maximisation."""

    def __init__(self, votes: np.ndarray, first: np.ndarray, anchor: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 60) -> None:
        """first: a first belief for each row. anchor: rates of votes on toxic and on other documents, with the weight of ANCHOR of them."""
        self.parent = np.full(votes.shape[1], -1)
        self.anchor = anchor
        post = first
        for r in range(rounds):
            self._fit(votes, post, r % 10 == 0)
            post = self.posterior(votes)

    def _fit(self, votes: np.ndarray, post: np.ndarray, tree: bool) -> None:
        sides = (post, 1 - post)
        self.prior = np.clip((post.sum() + 1) / (len(post) + 2), 1e-4, 1 - 1e-4)
        k = ANCHOR if self.anchor else 0.0
        rates = []
        for side, p in enumerate(sides):
            known = self.anchor[side] if self.anchor else 0.5
            rates.append(np.clip((p @ votes + k * known + 0.1) / (p.sum() + k + 0.2), 1e-6, 1 - 1e-6))
        self.hit, self.miss = rates
        if tree:
            self._grow(votes, sides)
        # the rate of a vote given its parent's: [label][parent's vote][voter]; a rate of its own is what little evidence falls back on
        parents = np.where(self.parent >= 0, votes[:, self.parent], 0)
        self.rate = np.empty((2, 2, votes.shape[1]))
        for side, p in enumerate(sides):
            for given, here in enumerate((1 - parents, parents)):
                self.rate[side, given] = ((p @ (here * votes)) + rates[side]) / ((p @ here) + 1)
        self.rate = np.clip(self.rate, 1e-6, 1 - 1e-6)

    def _grow(self, votes: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> None:
        """The parents: a spanning forest of the greatest mutual information of two votes given the label."""
        n, told = len(votes), np.zeros((votes.shape[1],) * 2)
        self.correlation = np.zeros_like(told)
        for p, rate in zip(sides, (self.hit, self.miss), strict=True):
            total = p.sum() + 1e-9
            one = p @ votes / total
            both = (votes * p[:, None]).T @ votes / total
            sd = np.sqrt(np.maximum(one * (1 - one), 1e-9))
            self.correlation += 0.5 * np.clip((both - np.outer(one, one)) / np.outer(sd, sd), 0, 1)
            for x, a in ((both, np.outer(one, one)), (one[:, None] - both, np.outer(one, 1 - one)), (one - both, np.outer(1 - one, one)), (1 - one[:, None] - one + both, np.outer(1 - one, 1 - one))):
                told += total / n * np.where(x > 1e-12, x * np.log(np.maximum(x, 1e-12) / np.maximum(a, 1e-12)), 0)
        np.fill_diagonal(self.correlation, 0)
        np.fill_diagonal(told, 0)
        told[self.correlation <= TOGETHER] = 0
        least = 2 * np.log(max(n, 2)) / n  # below it, two rates more don't pay
        self.parent[:] = -1
        free = set(range(len(told)))
        while free:
            root = min(free)
            free.discard(root)
            best, frm = told[root].copy(), np.full(len(told), root)
            while free:
                j = max(free, key=lambda v: (best[v], -v))
                if best[j] < least:
                    break
                free.discard(j)
                self.parent[j] = frm[j]
                more = told[j] > best
                best[more], frm[more] = told[j][more], j

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of the label given all votes of a row."""
        parents = np.where(self.parent >= 0, votes[:, self.parent], 0)
        on, off = np.log(self.rate[0] / self.rate[1]), np.log((1 - self.rate[0]) / (1 - self.rate[1]))
        z = np.log(self.prior / (1 - self.prior))
        for given, here in enumerate((1 - parents, parents)):
            z = z + (here * votes) @ on[given] + (here * (1 - votes)) @ off[given]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, decay: float, rounds: int = 40) -> np.ndarray:
    """Weights, the intercept last, by Newton steps on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], decay)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """What scores a text. Nothing learned: 0 for every text."""

    def __init__(self, voters: Voters, weights: np.ndarray | None, label_model: LabelModel | None = None) -> None:
        self.voters, self.weights, self.label_model = voters, weights, label_model

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        x = self.voters.row(*self.voters.hits(text))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def choose(df: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """The VOTERS terms that tell most, of (term, toxic documents, clean documents), without those that say the same."""
    return parted(df, toxic, clean)[0]


def parted(df: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """The chosen voters, and all other terms but those that say the same as one of them."""
    scored, rest = [], []
    for t, a, b in df:
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        if a >= 3 + toxic / 150 and odds > 2 and a / (a + b) > 0.6:
            scored.append((odds * np.sqrt(a), t, a, b))
        else:
            rest.append((t, a, b))
    out, counts = [], {}

    def said(t: str, a: int, b: int) -> bool:
        stem = t.lstrip("=")
        kin = [o for o in out if o.lstrip("=").startswith(stem) or stem.startswith(o.lstrip("="))]
        return any(counts[o][0] >= 0.9 * a and counts[o][1] <= b + 1 for o in kin)

    for _, t, a, b in sorted(scored, reverse=True):
        if len(out) == VOTERS:
            rest.append((t, a, b))
        elif not said(t, a, b):
            out.append(t)
            counts[t] = (a, b)
    return out, sorted(t for t, a, b in rest if not said(t, a, b))


def apart(marked: DataFrame) -> DataFrame:
    """marked (n, text, toxic) without near copies of rows of the same label, so that what one text holds isn't counted many times.

    Rows are told to be alike by four minima of their hashed five-word shingles; four numbers of each row of the bounded sample come to the driver.
    """

    def minima(batches):
        known = Words()
        for b in batches:
            n, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py().encode(), 5, known)
                n.append(i)
                found.append([int(mixed(s + np.uint64(k)).min() >> np.uint64(1)) for k in range(4)] if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), b.column(2), pa.array(found, pa.list_(pa.int64()))], ["n", "toxic", "low"])

    seen, kept = set(), []
    for r in sorted(marked.select("n", "text", "toxic").mapInArrow(minima, "n long, toxic int, low array<long>").collect(), key=lambda r: r["n"]):
        own = {(r["toxic"] > 0, k, x) for k, x in enumerate(r["low"] or [])}
        if own and seen.isdisjoint(own):
            kept.append((r["n"],))
        seen |= own
    return marked.join(F.broadcast(marked.sparkSession.createDataFrame(kept, "n long")), "n", "left_semi").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and the labels of some of them; both only the rows to learn from.

    At most about `sample` labelled documents are taken, none else; their texts are staged once and
    their ids broadcast, so that no other text is moved. A null label counts as none; of several
    labels of a document the highest holds; rows that share a doc_id are documents each. Null texts
    teach nothing, long ones are read whole. No toxic or no other document: nothing is learned.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and __id is not null").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    docs = doc_texts(docs).where("text is not null")
    chosen = marks.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, marks.count()))))
    # about `sample` ids, whatever the number of labels
    marked = stage(docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).select(F.monotonically_increasing_id().alias("n"), "text", "toxic"), "marked")
    marked = stage(apart(marked), "marked")

    def frequencies(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for t, y in zip(b.column(0), b.column(1), strict=True):
                seen[y.as_py() > 0].update(terms(t.as_py()))
            for y, c in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "y", "n"])

    sizes = {r["y"]: r["count"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("y")).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(Voters([]), None)
    df = marked.mapInArrow(frequencies, "term string, y int, n long").groupBy("term").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("a"), F.sum(F.expr("if(y = 0, n, 0)")).alias("b"))
    df = stage(df, "terms")
    # at the rate of toxic documents among all, a term has as many or more of them with a probability of exp(-far) at most (Chernoff)
    p = toxic / (toxic + clean)
    far = F.expr(f"a * ln(a / ((a + b) * {p!r}D)) + if(b = 0, 0, b * ln(b / ((a + b) * {1 - p!r}D)))")
    often = F.expr(f"a >= {3 + toxic / 150!r}D and ln((a + 0.5) / {toxic + 1}) - ln((b + 0.5) / {clean + 1}) > 2")
    best = df.where("a > 0 and a > 1.5 * b").where(often | (F.col("a") / (F.col("a") + F.col("b")) > p) & (far > float(np.log(max(1, df.count()) / CHANCE)))).collect()
    voters = Voters(*parted([(r["term"], r["a"], r["b"]) for r in best], toxic, clean))
    if not voters.terms:
        return Model(voters, None)

    def votes(batches):
        for b in batches:
            x = np.array([voters.row(*voters.hits(t.as_py())) for t in b.column(0)], np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], ["x", "toxic"])

    # one small row for each document of the bounded sample
    rows = marked.mapInArrow(votes, "x binary, toxic int").collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float)
    y = np.array([r["toxic"] > 0 for r in rows])
    v = x[:, :-2]
    first = np.where(v[:, len(voters.lexicon)] > 0, 0.9, 0.05)  # two different marks
    model = LabelModel(v, first, tuple((side @ v + 0.1) / (side.sum() + 0.2) for side in (y, ~y)))
    w = logistic(x, model.posterior(v), decay=1.0)
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    # the scale: 0.7 stands midway in the widest place that parts the labelled rows with the fewest errors
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(ys))) + np.concatenate((np.cumsum(~ys[::-1])[::-1], [0]))
    cut = np.concatenate(([zs[0] - 2], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 2]))
    gap = np.concatenate(([0], np.diff(zs), [0]))
    at = min(np.flatnonzero(wrong == wrong.min()), key=lambda i: (-gap[i], i))
    # and a text like most clean ones scores 0.1 at most
    slope = max(1.0, (np.log(0.7 / 0.3) + np.log(9)) / max(cut[at] - np.median(z[~y]), 1e-3))
    w = w * slope
    w[-1] += np.log(0.7 / 0.3) - slope * cut[at]
    return Model(voters, w, model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted, which take the place of columns of these names.

    Null and empty texts get the score of a text without hits. Long texts are read whole. Equal
    texts get equal scores, repeated rows each; a score of exactly 0.7 is predicted. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("score", "predicted")), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make() -> Callable:
        own = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([own.score(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            cols = [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
            return pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.float64()), pa.array((got >= 0.7).astype(np.int32))], schema.names)

        return step

    return per_slice(docs, make, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = doc_texts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(part != 1), labels.where(part != 1))
    return score(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")
