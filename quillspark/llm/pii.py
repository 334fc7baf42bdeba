"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels every word of the whole text; a word
without a digit or @ has a hard factor for "no personal data", so the chain falls apart
exactly into runs of other words, which are decoded in numpy batches by Viterbi. Such words
lend no features either: what stands beside a run ("phone", "mail") isn't looked at.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import doc_texts, per_slice, read

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits: it would have started at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
_EDGE = "\"'<>[]{}.,;:!?*#%&$|=`~^_/\\"

#: The labelled table: [kind:value], the rest is no personal data. All values are made up.
TABLE = """\
write to [email:ana@host] or [email:b.cole@office] today
mail [email:sales@intranet] about room 12
post@ is not complete and neither is @handle or @user99
costs 5@3 each, 12@4 in all
reach us at [email:jo@mail.example.org] or [email:k+x@a-b.example.net], ext 4
ask [email:root@server1] for the key
phone [phone:(212) 555-0143] after 9
phone [phone:(905) 555-0178], or [phone:(416) 555-0166].
call [phone:212-555-0199] or [phone:646-555-0123]
call [phone:303 555-0111] before 5
dial [phone:+1 (523) 555-0155] now
dial [phone:+44 20 7946 0958] now
fax [phone:(+49) 30 5550 1234] or [phone:+33-1-55501234]
tel. [phone:555-0142-7788] or [phone:020-7946-0991]
the host is [ip:10.0.0.7] and [ip:192.168.1.254]
from [ip:8.8.4.4], port 53
gateway [ip:172.16.0.1] answers
version 1.2.3 and 4.10.0 of 2021
version 1.2.3.4.5 or 300.1.2.3 or 999.999.1.1
card [card:4111 1111 1111 1111] expires 12/26
card [card:5500-0055-5555-5559] is closed
card [card:4012888888881881] ends
card [card:378282246310005] as well
order 4111111111111112 was sent
item 1234567890123456 of 7777777777777777
number 1111 2222 3333 4444 of 5
in 1999 and 2004-05-17 or 17.05.2004
at 12:30 or 08:15:59 on 3/4
pages 12-19, 100-200 and 555-1234-9
about 3,000,000 or 2.5 or 10% or $99.95
rooms 101 102 103 104 105
values 12 34 56 78 90 12 34
id 0042 and a1b2c3 and x-77
hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff
isbn 978-3-16-148410-0 and 0-306-40615-2
the 1st 2nd 3rd and 4th of 12
see section 4.1.2 (3) and (12)
key 83204-11 and 20240131-7
win 3-2 or 21-19 21-17
scores 2004 12 13 14 and 1998 3 4 5 6 7 then 2012 10 11 12 13
years 1990 1995 2000 and 2010 2015 2020 2025
rows 10 20 30 40 50 60 of 1200 1300 1400
grid 512 256 128 64 and 1024 768 600 480
since 2001 14 were sold, 2002 15 16 17
zip 90210-1234 and 10115
"""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that the patterns find, by kind, then start: leftmost, not overlapping in a kind, no retries."""
    out, end, before = [], 0, -1
    at = text.find("@")
    while at >= 0:
        low = max(end, before + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        before, at = at, text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def marked_words(text: str) -> list[tuple[int, int]]:
    """The words that hold a digit or @."""
    out, end = [], 0
    for m in _MARKED.finditer(text):
        a = m.start()
        while a > end and text[a - 1] not in _SPACE:
            a -= 1
        out.append((a, m.end()))
        end = m.end()
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Marked words with nothing but white space between them."""
    out: list[list[tuple[int, int]]] = []
    for a, b in marked_words(text):
        if out and not text[out[-1][-1][1] : a].strip("\x20\x09\x0a\x0b\x0c\x0d"):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def shape(word: str) -> str:
    """Runs of one class: digits with their number (5 for 5 to 8, 9 for more), letters as a, others as they are."""
    w = word.strip(_EDGE)

    def digits(m: re.Match) -> str:
        n = len(m[0])
        return f"d{n if n < 5 else 5 if n < 9 else 9}"

    if not w:
        return "-"
    return re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub(r"[0-9]+", digits, re.sub(r"[^\x00-\x7f]|[A-Za-z]+", "a", w)))


def features(words: list[str]) -> list[list[str]]:
    """For each word of a run: its shape, that of its neighbours, and what is countable about it."""
    shapes = [shape(w) for w in words]
    joined = re.sub(r"[^0-9]", "", "".join(words))
    whole = f"n={min(len(joined), 20)}"
    sound = f"luhn={13 <= len(joined) <= 19 and luhn(joined)}"
    out = []
    for i, (w, s) in enumerate(zip(words, shapes, strict=True)):
        core = w.strip(_EDGE)
        n = sum(c.isdigit() and c.isascii() for c in core)
        dots = core.split(".")
        ip = len(dots) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in dots)
        out.append([
            f"s={s}", f"p={shapes[i - 1] if i else '^'}", f"f={shapes[i + 1] if i + 1 < len(words) else '$'}", f"{whole}|{sound}", f"k={min(n, 20)}", f"ip={ip}",
            f"at={'@' in core[1:-1]}{core[-1:].isalnum()}{core[:1].isalnum()}{core.find('@') >= 0 and core.partition('@')[2][:1].isalpha()}",
            f"plus={core[:1] == '+'}", f"par={core[:1] == '('}{'-' in core}", "bias",
        ])
    return out


class Field:
    """Linear-chain conditional random field: weights of (feature, label), of label pairs, of first and last labels."""

    def __init__(self, table: str = TABLE, rounds: int = 150, rate: float = 0.1, decay: float = 0.01) -> None:
        seqs, tags = [], []
        for line in table.splitlines():
            text, spans = "", []
            for part in re.split(r"(\[(?:email|ip|card|phone):[^\]]*\])", line):
                if part.startswith("["):
                    kind, _, value = part[1:-1].partition(":")
                    spans.append((len(text), len(text) + len(value), LABELS.index(kind)))
                    text += value
                else:
                    text += part
            for run in runs(text):
                seqs.append(features([text[a:b] for a, b in run]))
                tags.append([next((k for s, e, k in spans if a < e and s < b), 0) for a, b in run])
        self.index = {f: i for i, f in enumerate(dict.fromkeys(f for s in seqs for w in s for f in w))}
        k = len(LABELS)
        self.emit = np.zeros((len(self.index) + 1, k))
        self.step = np.zeros((k + 1, k + 1))  # the last row is before the first word, the last column behind the last
        if seqs:
            self._train(seqs, tags, rounds, rate, decay)

    def ids(self, seq: list[list[str]]) -> np.ndarray:
        return np.array([[self.index.get(f, len(self.index)) for f in w] for w in seq], np.int32)

    def _train(self, seqs, tags, rounds, rate, decay) -> None:
        """Penalised maximum likelihood; the gradient is observed less expected counts, by forward and backward sums."""
        n, most, k = len(seqs), max(map(len, seqs)), len(LABELS)
        x = np.full((n, most, len(seqs[0][0])), len(self.index), np.int32)
        y, live = np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, (s, t) in enumerate(zip(seqs, tags, strict=True)):
            x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = self.ids(s), t, True
        last = live.sum(1) - 1
        rows = np.arange(n)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        moment = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.emit, self.step)]
        for r in range(1, rounds + 1):
            e = self.emit[x].sum(2)
            a = np.zeros((n, most, k))
            b = np.zeros((n, most, k))
            a[:, 0] = self.step[k, :k] + e[:, 0]
            for t in range(1, most):
                a[:, t] = np.where(live[:, t, None], lse(a[:, t - 1, :, None] + self.step[None, :k, :k], 1) + e[:, t], a[:, t - 1])
            for t in range(most - 1, -1, -1):
                here = np.broadcast_to(self.step[:k, k], (n, k))
                if t + 1 < most:
                    more = lse(self.step[None, :k, :k] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                    here = np.where((last > t)[:, None], more, here)
                b[:, t] = here
            z = lse(a[rows, last] + self.step[:k, k], 1)
            p = np.exp(a + b - z[:, None, None]) * live[..., None]
            g_emit, g_step = np.zeros_like(self.emit), np.zeros_like(self.step)
            diff = np.eye(k)[y] * live[..., None] - p
            np.add.at(g_emit, x, diff[:, :, None, :])
            g_emit[-1] = 0
            g_step[k, :k] += diff[:, 0].sum(0)
            g_step[:k, k] += diff[rows, last].sum(0)
            for t in range(1, most):
                on = live[:, t]
                pair = np.exp(a[on, t - 1, :, None] + self.step[None, :k, :k] + (e[on, t] + b[on, t])[:, None, :] - z[on, None, None])
                g_step[:k, :k] -= pair.sum(0)
                np.add.at(g_step, (y[on, t - 1], y[on, t]), 1)
            for w, g, m in ((self.emit, g_emit, moment[0]), (self.step, g_step, moment[1])):
                g = g - decay * w
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                w += rate * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)

    def decode(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each sequence of feature ids; sequences of like length go together."""
        out: list[np.ndarray] = [None] * len(seqs)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        k, i = len(LABELS), 0
        while i < len(order):
            size = len(seqs[order[i]])
            group = []
            while i < len(order) and len(seqs[order[i]]) == size and (len(group) + 1) * size <= max(size, 200_000):
                group.append(order[i])
                i += 1
            e = self.emit[np.stack([seqs[j] for j in group])].sum(2)
            back = np.zeros((size, len(group), k), np.int8)
            best = self.step[k, :k] + e[:, 0]
            for t in range(1, size):
                way = best[:, :, None] + self.step[None, :k, :k]
                back[t] = way.argmax(1)
                best = way.max(1) + e[:, t]
            at = (best + self.step[:k, k]).argmax(1)
            labels = np.zeros((len(group), size), np.int8)
            for t in range(size - 1, -1, -1):
                labels[:, t] = at
                at = back[t][np.arange(len(group)), at]
            for j, row in zip(group, labels, strict=True):
                out[j] = row
        return out


class Finder:
    def __init__(self, field: Field) -> None:
        self.field = field

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans, and all spans: what the field adds overlaps no base span."""
        base = [base_spans(t) for t in texts]
        where, seqs = [], []
        for i, t in enumerate(texts):
            for run in runs(t):
                where.append((i, run))
                seqs.append(self.field.ids(features([t[a:b] for a, b in run])))
        added: dict[int, list] = {}
        for (i, run), labels in zip(where, self.field.decode(seqs), strict=True):
            t, j = texts[i], 0
            while j < len(run):
                k = j + 1
                while k < len(run) and labels[k] == labels[j]:
                    k += 1
                if labels[j]:
                    a, b = run[j][0], run[k - 1][1]
                    inner = t[a:b].strip(_EDGE)
                    a = t.index(inner, a) if inner else a
                    kind = LABELS[labels[j]]
                    if inner and self._sound(kind, inner) and all(b2 <= a or a + len(inner) <= a2 for _, a2, b2 in base[i]):
                        added.setdefault(i, []).append((kind, a, a + len(inner)))
                j = k
        rank = {k: n for n, k in enumerate(KINDS)}
        return [(b, sorted(b + added.get(i, []), key=lambda s: (rank[s[0]], s[1]))) for i, b in enumerate(base)]

    @staticmethod
    def _sound(kind: str, text: str) -> bool:
        """The exact check of what the field adds."""
        if kind == "email":
            return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z][A-Za-z0-9.-]*", text))
        if not re.fullmatch(r"[0-9+().\x20-]+", text):
            return False
        digits = re.sub(r"[^0-9]", "", text)
        if kind == "ip":
            parts = text.split(".")
            return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """For each row: the numbers of base spans, their digest, and all spans.

    Null and empty texts: no spans. Long texts, words and runs are read whole. Rows without spans
    are kept, with zeros; repeated rows are judged each by itself. Where the field likes two labels
    equally (a tie) the first in LABELS holds. Empty table: no rows. Columns besides doc_id and text,
    whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or Field())

    def make() -> Callable:
        finder = Finder(shared.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = finder.find([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            cols = [b.column(b.schema.get_field_index("doc_id"))]
            cols += [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            cols += [pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in got]), pa.array([_written(spans) for _, spans in got])]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return step

    return per_slice(doc_texts(docs), make, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data in `text` replaced by its kind; all rows and columns stay, null and empty texts as they are. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(field or Field())

    def make() -> Callable:
        finder = Finder(shared.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            got = finder.find([t or "" for t in texts])
            new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, got, strict=True)]
            return b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

        return step

    return per_slice(docs, make, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
