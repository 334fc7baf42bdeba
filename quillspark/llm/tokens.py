"""Token ids of whole texts by public tokenizers, with a bounded memory of the pieces between spaces."""

from __future__ import annotations

import os
import re
from itertools import chain, islice, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered in a worker at most, unless an encoder is given its own bound; in two generations: when the young one is full it becomes the old one.
MEMORY = 800_000
#: White space, a little more than the tokenizers take for it.
_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that can't be cut at every space and line end.
_ODD = rf"\x00|^{_W}|{_W}{_W}|{_W}\z"
#: The other texts are cut where a space or line end stands alone.
_LONE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A letter that is one in lower case too, then a mark that belongs to another pre-token; an apostrophe may not.
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: The same by bytes: 1 a space or line end, 2 a mark, 3 an ASCII letter, 4 the first byte of the other letters, 5 their second.
_KINDS = bytes(
    1 if b in (10, 32) else 3 if chr(b).isalpha() and b < 128 else 4 if b == 0xC3 else 5 if 0x80 <= b < 0xC0 and b not in (0x97, 0xB7) else 2 if re.match(r"[!-&(-/:-@\[-`{-~]", chr(b)) else 0 for b in range(256)
)
_ID = attrgetter("id")
#: Letters that stay as they are when a text is brought to its normal form.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def cut_texts(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Texts, none of them empty, cut before each space and line end and between a letter and a mark: pieces, which share the texts' bytes, and the offsets of each text's."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first = int(ends[0])
    kind = np.frombuffer(np.frombuffer(data, np.uint8)[first : ends[-1]].tobytes().translate(_KINDS), np.uint8)
    letter = kind == 3
    letter[1:] |= (kind[1:] == 5) & (kind[:-1] == 4)
    cut = kind == 1
    cut[1:] |= (kind[1:] == 2) & letter[:-1]
    cut[ends[:-1] - first] = True
    at = np.append(np.flatnonzero(cut).astype(np.int32) + np.int32(first), ends[-1:])
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data), np.searchsorted(at, ends)


class Ids:
    """Ids of pieces: the row of a piece gives where its ids start in `flat`, and how many there are."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.row)
        end = int(self.start[n])
        while len(self.flat) < end + len(ids):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.start) <= n + len(pieces):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[end : end + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(pieces)] = end + np.cumsum(sizes)
        self.row.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after the other, and the number of each row's."""
        start = self.start[rows]
        sizes = self.start[rows + 1] - start
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Encoder:
    """Ids of whole texts.

    A text is cut where no pre-token can reach across, so that its ids are those of its pieces:
    with `spaces` (byte-level, a space belongs to the word after it) before a space or line end that
    stands alone, else (white space is dropped, letters are lower-cased) at any ASCII white space;
    and between a letter and a mark. Pieces are cut, and told apart, in Arrow; only pieces that
    aren't remembered reach the tokenizer, those of letters alone (one pre-token) its model.
    """

    def __init__(self, path: str, spaces: bool, memory: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # pieces are remembered here, not in the model too
        getattr(self.model, "_resize_cache", lambda n: None)(0)
        self.spaces, self.memory = spaces, memory
        self.young, self.old = Ids(), Ids()
        self.letters = np.array([ord(c) for c in byte_letters()], "<u2")  # of each byte
        self.line = self._each(["\n"])[0] if spaces else []

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        plain, lined, rest = [], [], []
        for i, p in enumerate(pieces):
            if self.spaces:
                (rest if p[0] not in " \n" or not p[1:].isalpha() else lined if p[0] == "\n" else plain).append(i)
            else:
                (rest if _PLAIN.fullmatch(p) is None else plain).append(i)
        words = "\n".join(chain((pieces[i] for i in plain), (pieces[i][1:] for i in lined))).encode()
        words = self.letters[np.frombuffer(words, np.uint8)].tobytes().decode("utf-16-le").split(chr(self.letters[10]))
        # one flat list: a list for each piece would keep the garbage collector busy
        ids, sizes, found = [], [], map(self.model.tokenize, words)
        for x in islice(found, len(plain)):
            ids.extend(map(_ID, x))
            sizes.append(len(x))
        for x in islice(found, len(lined)):
            ids += self.line
            ids.extend(map(_ID, x))
            sizes.append(len(self.line) + len(x))
        for more in self._each([pieces[i] for i in rest]):
            ids += more
            sizes.append(len(more))
        self.young.add([pieces[i] for i in plain + lined + rest], np.array(ids, np.uint32), np.array(sizes, np.int64))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """The rows of distinct pieces in the young generation."""
        rows = np.fromiter(map(self.young.row.get, pieces, repeat(-1)), np.int64, len(pieces))
        lost = np.flatnonzero(rows < 0)
        if len(self.young.row) + len(lost) > (self.memory or MEMORY) // 2:
            self.young, self.old = Ids(), self.young
            lost = np.arange(len(pieces))
        if len(lost):
            missed = [pieces[i] for i in lost.tolist()]
            was = np.fromiter(map(self.old.row.get, missed, repeat(-1)), np.int64, len(missed))
            known = np.flatnonzero(was >= 0)
            if len(known):
                self.young.add([missed[i] for i in known.tolist()], *self.old.of(was[known]))
            self._learn([missed[i] for i in np.flatnonzero(was < 0).tolist()])
            rows[lost] = np.fromiter(map(self.young.row.get, missed), np.int64, len(missed))
        return rows

    def _of_pieces(self, pieces: pa.Array, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of texts whose pieces lie between offsets."""
        told = pieces.dictionary_encode()
        rows = self._rows(told.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = self.young.of(rows[told.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        if not self.spaces:
            cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _MARK, r"\1 \2"))
            pieces, offsets = pc.list_flatten(cut), cut.offsets.to_numpy() - cut.offsets[0].as_py()
            full = pc.not_equal(pieces, "")
            return self._of_pieces(pieces.filter(full), np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[offsets])
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _ODD)).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        even = np.flatnonzero(~odd)
        if len(even):
            for i, ids in zip(even.tolist(), self._of_pieces(*cut_texts(texts if len(even) == len(texts) else texts.take(pa.array(even)))), strict=True):
                out[i] = ids
        rest = [(i, _LONE.split(texts[i].as_py())) for i in np.flatnonzero(odd).tolist()]
        rest = [(i, p) for i, p in rest if p != [""]]
        offsets = np.cumsum([0, *(len(p) for _, p in rest)])
        for (i, _), ids in zip(rest, self._of_pieces(pa.array([x for _, p in rest for x in p], pa.string()), offsets), strict=True):
            out[i] = ids
        return out


_OWN: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(path: str, spaces: bool, memory: int | None = None) -> Encoder:
    """The encoder of this process: a worker keeps what it remembers from task to task. It holds one at a time."""
    if (path, spaces, memory) not in _OWN:
        _OWN.clear()
        _OWN[path, spaces, memory] = Encoder(path, spaces, memory)
    return _OWN[path, spaces, memory]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
