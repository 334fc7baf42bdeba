"""Byte-pair encoding by the last token of every prefix, and decoding.

A suffix automaton of the vocabulary follows a piece of text and tells, after each symbol, which
tokens end there. Of these exactly one is the last token of the prefix's encoding: the one that no
merge would join across its border with the last token of the prefix before it. The last tokens
of all prefixes are stored; the ids are read off them from the end. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, give_back, per_slice, read, small_batches
from .decontamination import Automaton
from .tokens import _PLAIN, Encoder, byte_letters, vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Pieces of text, and verdicts on pairs of tokens, that a worker remembers at most; bytes of text cut at a time.
MEMORY, PAIRS, SLICE = 200_000, 1_000_000, 2 << 20

ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string"


class Ends(Automaton):
    """Suffix automaton of token strings (sequences of symbols), with the tokens that end in each state."""

    def __init__(self, tokens: Iterable[tuple[int, list[int]]]) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]
        self.sizes: dict[int, int] = {}
        strings = []
        for token, seq in tokens:
            last = 0
            for symbol in seq:
                last = self._extend(last, symbol)
            strings.append((token, seq))
            self.sizes[token] = len(seq)
        #: state -> its tokens, the longest first; a state's strings may be longer than its tokens
        self.own: dict[int, list[int]] = {}
        for token, seq in strings:
            at = 0
            for symbol in seq:
                at = self.next[at][symbol]
            self.own.setdefault(at, []).append(token)
        for held in self.own.values():
            held.sort(key=lambda t: -self.sizes[t])

    def ending(self, state: int, n: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end a match of n symbols in state, the longest first."""
        out = []
        while state > 0:
            out += [(t, self.sizes[t]) for t in self.own.get(state, ()) if self.sizes[t] <= n]
            state = self.link[state]
        return tuple(out)


class Prefixes:
    """The encoder of one vocabulary: symbols 0 to 255 are its byte letters, 256 to 511 the same at a word's end; merges follow in order."""

    SYMBOLS = 512

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        #: symbol of a byte; of a byte at a word's end
        self.inner, self.final = [vocab[c] for c in letters], [vocab[f"{c}</w>"] for c in letters]
        self.of_letter = {c: b for b, c in enumerate(letters)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        for a, b in merges:
            made, a, b = vocab[a + b], vocab[a], vocab[b]
            if made <= max(a, b, self.SYMBOLS - 1) or made in self.parts:
                raise ValueError("ids must follow the order of merges, each of which makes a token of its own")
            self.parts[made] = a, b
            self.merged[a << 16 | b] = made
        spelled = {s: [s] for s in (*self.inner, *self.final)}
        sound = set(spelled)
        for made, (a, b) in sorted(self.parts.items()):
            spelled[made] = spelled[a] + spelled[b]
            # a token that its own string doesn't give is never part of an encoding
            if a in sound and b in sound and self.border(a, b, made):
                sound.add(made)
        self.ends = Ends((t, spelled[t]) for t in sorted(sound))
        self.fits: dict[int, bool] = {}
        self.found: dict[int, tuple[tuple[int, int], ...]] = {}

    def border(self, left: int, right: int, before: int = 1 << 16) -> bool:
        """Does the border between two tokens stay, as far as merges before `before` go?

        Seen backwards in time: at each moment one part of the left token and one of the right touch.
        They are joined if their merge comes before the merge that takes the left part away, and not
        after the one that takes the right part away, as of equal merges the left one goes first.
        """
        left_until = right_until = before
        while True:
            made = self.merged.get(left << 16 | right)
            if made is not None and made < before and made < left_until and made <= right_until:
                return False
            if left < self.SYMBOLS and right < self.SYMBOLS:
                return True
            newest = max(left, right)
            if left == newest:
                left_until, left = left, self.parts[left][1]
            if right == newest:
                right_until, right = right, self.parts[right][0]

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word, none of an empty one."""
        if not word:
            return []
        nxt, link, length, found, fits = self.ends.next, self.ends.link, self.ends.length, self.found, self.fits
        last, state, n, inner, at = array("H"), 0, 0, self.inner, 0
        final = len(word) - 1
        for at, byte in enumerate(word):
            symbol = inner[byte] if at < final else self.final[byte]
            to = nxt[state].get(symbol)
            while to is None:  # ends at the root, which knows every symbol
                state = link[state]
                n = length[state]
                to = nxt[state].get(symbol)
            state, n = to, n + 1
            ending = found.get(state << 8 | n)
            if ending is None:
                ending = found[state << 8 | n] = self.ends.ending(state, n)
            for token, size in ending:
                if size > at:
                    break
                pair = last[at - size] << 16 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    ok = fits[pair] = self.border(pair >> 16, token)
                if ok:
                    break
            else:
                raise ValueError("no token ends this prefix")
            last.append(token)
        ids, at = [], len(word)
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= self.ends.sizes[token]
        ids.reverse()
        return ids


class PrefixEncoder(Encoder):
    """Ids of whole texts, pieces that aren't remembered by their prefixes. With `special`, strings of special tokens in a text are their ids, as the library takes them unless told otherwise."""

    def __init__(self, path: str, special: bool = True, memory: int | None = MEMORY) -> None:
        super().__init__(path, False, memory)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or held["decoder"] is not None:
            raise ValueError("not a vocabulary of words with ends")
        self.prefixes = Prefixes(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]} if special else {}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: s for s, i in (model["vocab"] | {t["content"]: t["id"] for t in held["added_tokens"]}).items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def _learn(self, pieces: list[str]) -> None:
        encode, of = self.prefixes.encode, self.prefixes.of_letter
        normal, words = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        got = [encode(p.encode()) if _PLAIN.fullmatch(p) else [t for w, _ in words(normal(p)) for t in encode(bytes([of[c] for c in w]))] for p in pieces]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.young.add(pieces, np.fromiter((t for ids in got for t in ids), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.marks or not len(texts):
            return super().encode(texts)
        marked = np.flatnonzero(np.any([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special], axis=0))
        if not len(marked):
            return super().encode(texts)
        # the text between special tokens is text of its own
        lists = {i: texts[i].as_py() for i in marked.tolist()}
        between = [(i, p) for i, t in lists.items() for p in self.marks.split(t)]
        plain = super().encode(pc.if_else(pa.array(np.isin(np.arange(len(texts)), marked)), "", texts))
        parts: dict[int, list[np.ndarray]] = {i: [] for i in lists}
        for (i, _), ids in zip(between, super().encode([p for _, p in between]), strict=True):
            parts[i].append(ids)
        for i, t in lists.items():
            held = [parts[i][0]]
            for mark, ids in zip(self.marks.findall(t), parts[i][1:], strict=True):
                held += (np.array([self.special[mark]], np.uint32), ids)
            plain[i] = np.concatenate(held)
        return plain

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids: the strings of its tokens with a space between; unknown ids are left out, as the library does."""
        flat, offsets = ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names)))
        strings = self.names.take(pc.if_else(pc.fill_null(known, False), flat, None))
        live = np.concatenate(([0], np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False))))[offsets]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(live, pa.int32()), strings.drop_null()), " ")


_OWN: dict[tuple[str, bool], PrefixEncoder] = {}


def prefix_encoder(path: str, special: bool = True) -> PrefixEncoder:
    """The encoder of this process, kept from task to task; one at a time."""
    if (path, special) not in _OWN:
        _OWN.clear()
        _OWN[path, special] = PrefixEncoder(path, special)
    return _OWN[path, special]


def encode(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian unsigned 32-bit integers).

    A null or empty text has no ids. Long texts are encoded whole; what is held besides are two bytes for each
    byte of the longest word. Repeated rows give equal rows; there are no ties. An empty table gives none.
    Columns besides doc_id and text, whatever their names, are ignored. No shuffle.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        held = prefix_encoder(path or vocabulary(VOCABULARY), special)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = held.encode(b.column(1))
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists, pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids", "ids_sha256"])

        return step

    return per_slice(doc_texts(docs), make, ENCODED, size=SLICE)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (ids) with text: what the vocabulary gives back, the strings of tokens with a space between.

    Null ids, or none, are an empty text; a column `text` is replaced, all others stay. Repeated rows
    give equal rows, an empty table none.
    """
    small_batches(rows.sparkSession)

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = prefix_encoder(path or vocabulary(VOCABULARY))
        for ids in batches:
            yield held.decode(ids)
        give_back()

    text = joined(F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")))
    return rows.select(*(c for c in rows.columns if c != "text"), text.alias("text"))


def op11_prefixbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
