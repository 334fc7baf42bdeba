"""A file format for token ids: an adaptive context-mixing range coder over independent blocks.

A segment holds whole documents: their ids in blocks of BLOCK ids (the last may be shorter).
Each block is coded from a fresh model into words of its own and carries a CRC-32 of what is
written and of its ids (the last words have bits that no id depends on), so any block can be read
without the others, and one damaged byte never goes unseen; the head has its own CRC-32. As blocks don't depend on
each other, all blocks of a segment are coded, and decoded, one id each at a time in numpy; what can be
told beforehand when ids are known, all but weights and intervals, is found for whole blocks before they are coded.

Model of a block, all of it reset where the block starts:

* order 2: the id that last followed the two ids before, with a confidence from 0 to 7,
* order 1: the id that last followed the one before, likewise,
* order 0: how often each id has come in this block; the interval is laid out anew at RENEW,
* what is left goes to the frequencies in the segment's head, so that an id which is new to the
  block can be coded too.

For each pair of confidences the weights of order 2, 1 and 0 adapt with each id to how often they
come true; the four parts are mixed into one interval of 2**(WEIGHT + FREQ) parts.
"""

from __future__ import annotations

import struct
import zlib
from itertools import pairwise

import numpy as np

BLOCK = 2048
MAGIC = b"QTI4"
#: Bits of the total of the head's frequencies, of order 0's, of the weights.
FREQ, SEEN, WEIGHT = 17, 12, 14
#: Different ids that the head's frequencies hold; rarer ones of a segment are written as they are.
KINDS = 60_000
#: Slots of the order-0, order-1 and order-2 predictions of a block, and its ids at most, as powers of two.
ZERO, ONE, TWO, IDS = 11, 10, 11, 11
#: Before these ids of a block the order-0 interval is laid out anew.
RENEW = (32, 96, 256, 512, 1024, 1536)
#: Blocks whose slots are sorted, or laid out, at a time; blocks whose guesses are gone through at a time.
LANES, SPAN = 128, 1024


def _fixed(*values: int, kind: type = np.uint64) -> list[np.ndarray]:
    """Numbers as arrays without dimensions: numpy would turn them into such in every step."""
    return [np.array(v, kind) for v in values]


_PAGE, _LOW, _32, _16, _4, _1 = _fixed(1 << 32, (1 << 32) - 1, 32, 16, 4, 1)
_ALL, _FREQ = _fixed(FREQ + WEIGHT, FREQ)
#: Weights of order 2, 1 and 0 lie in 16 bits each of one number, from the right; the 16 bits above them mean nothing.
_FIELD, _SUMS, _DECAY = _fixed(0xFFFF, 0x0001_0001_0001_0001, 0x0FFF_0FFF_0FFF)
#: What each weight gains, and what that of the order which hit gains besides.
_MISS, _HIT = _fixed(0x0001_0001_0001, 999)
_TOP, _WHOLE = _fixed(0xFFFF << 48, 1 << WEIGHT + 48)
_EACH, _ABOVE, _MOST, _15, _3 = _fixed(0x0001_0001_0001, 0x8000_8000_8000, 0x7FFE, 15, 3)
#: A place in an interval: its start << 18 | its length.
_PLACE = (1 << 18) - 1
_START, _LENGTH = _fixed(18, _PLACE)
_GUESS = 1 << FREQ
#: A step of a block: where its weights are, 3 - its order, its place, in this many bits from the right.
_ORDER, _AT = 36, 38
_WHERE, _BITS, _SHIFT = _fixed((1 << _ORDER) - 1, _ORDER - 4, 3 << 4)
#: An order-0 slot: symbol + 1, count, place, in this many bits from the right.
_COUNT, _SYMBOL = 35, 46
_LAID = (1 << _COUNT) - 1
#: Numbers of the steps, for symbols and confidences, for places and orders, for hashes.
_N0, _N1, _N2, _N3, _N7, _N8 = _fixed(0, 1, 2, 3, 7, 8, kind=np.int32)
_L1, _LS, _LL, _LA, _LP, _LT, _LZ, _LN = _fixed(1, _SYMBOL, _LAID, _AT, FREQ - SEEN, (1 << SEEN) - 1, ZERO, SEEN, kind=np.int64)
_B2, _B3 = _fixed(2, 3, kind=np.int8)
_H0, _H1, _H2, _H3, _H7, _HA, _HB, _HI, _HR, _HT = _fixed(32 - ZERO, 32 - ONE, 32 - TWO, 3, 7, 0x9E3779B1, 0x2C1B3C6D, IDS, IDS + ZERO, (1 << IDS) - 1, kind=np.uint32)


class Weights:
    """Weights of n blocks side by side, slot by slot: those that are used most lie together and stay in the cache."""

    def __init__(self, n: int) -> None:
        sure = np.array([30, 1000, 2240, 3520, 4480, 5240, 6000, 6760], np.uint64)
        a2, a1 = np.repeat(sure, 8), np.tile(sure * np.uint64(3) >> np.uint64(3), 8)
        a0 = (np.uint64(1 << WEIGHT) - a2 - a1) >> np.uint64(2)
        self.all = np.repeat(a2 | a1 << np.uint64(16) | a0 << _32, n)

    def take(self, at: np.ndarray) -> None:
        """Goes to these weights, one of each block."""
        self.at, self.w = at, self.all.take(at)
        self.sums = self.w * _SUMS  # of the weights up to each, from the right

    def part(self, shift: np.ndarray) -> None:
        """Start and length of a part: shift is 0 for order 2, 16 for 1, 32 for 0, 48 for what is left."""
        self.shift = shift
        # what is left stands above the weights; the topmost sum is that of all weights
        self.length = (self.w + (_WHOLE - (self.sums & _TOP))) >> shift & _FIELD
        self.start = ((self.sums << _16) >> shift & _FIELD) << _FREQ

    def interval(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of a place in that part."""
        return self.start + self.length * (place >> _START), self.length * (place & _LENGTH)

    def learn(self) -> None:
        """What came was in that part."""
        self.all[self.at] = self.w - (self.w >> _4 & _DECAY) + _MISS + (_HIT << self.shift)


class Guesses:
    """Order 2 and 1 of n blocks side by side, step by step. A guess is symbol << 3 | confidence. They lie as weights do."""

    def __init__(self, n: int) -> None:
        # those of order 2 lie before those of order 1
        self.all, lane = np.zeros((n << ONE) + (n << TWO), np.int32), np.arange(n, dtype=np.uint32)
        self.wide, self.base = np.array(n, np.uint32), np.stack((lane, lane + np.uint32(n << TWO)))
        self.at, self.before = self.base.astype(np.int64), np.zeros(n, np.uint32)

    def narrow(self, m: int) -> None:
        """Only the first m blocks go on."""
        self.base, self.at, self.before = (x[..., :m].copy() for x in (self.base, self.at, self.before))

    def take(self) -> np.ndarray:
        """The guesses of both orders, a row each; c are their confidences."""
        self.p = self.all.take(self.at)
        self.c = self.p & _N7
        return self.p

    def learn(self, s8: np.ndarray) -> None:
        """The symbol s8 >> 3 came."""
        now = np.empty_like(self.p)
        now[:] = s8 | _N1
        hits = (self.p ^ s8) < _N8
        keep = (hits | (self.c > _N1)).ravel().nonzero()[0]
        now.put(keep, _next(self.p.take(keep), hits.take(keep)))
        self.all[self.at.ravel()] = now.ravel()
        mixed = _mixed(s8)
        self.at[1] = (mixed >> _H1) * self.wide + self.base[1]
        self.at[0] = (_pairs(mixed, self.before) >> _H2) * self.wide + self.base[0]
        self.before = _left(mixed)


#: By hit or miss and confidence. Right: more confidence; wrong: half of it. What has none any more is lost.
_CHANGE = np.array([*(-(c + 1 >> 1) for c in range(8)), *(int(c < 7) for c in range(8))], np.int32)


def _next(p: np.ndarray, hits: np.ndarray) -> np.ndarray:
    return p + _CHANGE.take((p & _N7) + (hits.view(np.int8) << _B3))


def _mixed(s8: np.ndarray) -> np.ndarray:
    return s8.view(np.uint32) * _HA


def _left(mixed: np.ndarray) -> np.ndarray:
    """What a symbol leaves for the slot after the next."""
    return mixed * _HB ^ mixed >> _H7


def _pairs(mixed: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed * _H3 + before


def _visits(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some blocks, a row each, in the order of their slots, there as they came: where they are, and where each slot begins."""
    n, ids = slot.shape
    row, t = np.arange(n, dtype=np.uint32)[:, None] << _HR, np.arange(ids, dtype=np.uint32)
    key = np.sort(slot << _HI | row | t, axis=1).ravel()
    of = key >> _HI
    first = np.ones(len(key), bool)
    np.not_equal(of[1:], of[:-1], out=first[1:])
    return ((key >> _HR) * np.uint32(ids) + (key & _HT)).astype(np.int64), first.nonzero()[0]


def _guesses(s8: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The guesses before each of the symbols of some blocks, a row each, from their slots: what Guesses does step by step."""
    visits = [_visits(slot[i : i + LANES]) for i in range(0, len(slot), LANES)]
    sizes = np.cumsum([0, *(len(at) for at, _ in visits)]).tolist()
    first = np.concatenate([f + k for (_, f), k in zip(visits, sizes, strict=False)])
    came = np.concatenate([s8[i * LANES : (i + 1) * LANES].ravel().take(at) for i, (at, _) in enumerate(visits)])
    p = np.empty_like(came)
    np.bitwise_or(came[:-1], _N1, out=p[1:])
    p[first] = 0
    # each takes the place of that before, unless a symbol came twice running: from there on a slot is gone through until its guess has lost all confidence
    twice = ((p ^ came) < _N8).nonzero()[0]
    ends = np.append(first[1:], len(came))
    x = np.append(twice, len(came))  # and what comes after all
    of = np.searchsorted(first, twice, "right")
    end = ends.take(of - 1)
    begin = np.concatenate(([True], of[1:] != of[:-1])).nonzero()[0] if len(of) else of
    to, end = twice[begin], end[begin]
    now = p.take(to) + _N1
    while len(to):
        to += _L1
        if not (on := to < end).all():
            to, now, end = to[on], now[on], end[on]
        p[to] = now
        now = _next(now, (now ^ came.take(to)) < _N8)
        lost = (now & _N7 == _N0).nonzero()[0]
        if len(lost):
            to[lost] = again = x.take(np.searchsorted(twice, to.take(lost), "right"))
            now[lost] = came.take(again, mode="clip") + _N2
    out = np.empty_like(p)
    for (at, _), begin, stop in zip(visits, sizes, sizes[1:], strict=False):
        out[begin:stop][at] = p[begin:stop]
    return out.reshape(s8.shape)


def _slots(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols + 1 of some blocks, a row each, and their order-0 slots."""
    return s.astype(np.int64) + _L1, (_mixed(s << _N3) >> _H0) + (np.arange(len(s)) << ZERO)[:, None]


def _count(zero: np.ndarray, own: np.ndarray, slot: np.ndarray) -> None:
    new = (zero.take(slot) == 0).nonzero()[0][::-1]  # a slot is the first's that comes to it, which is written last
    zero[slot[new]] = own[new] << _SYMBOL
    np.add.at(zero, slot[zero.take(slot) >> _SYMBOL == own], 1 << _COUNT)


def _lay_out(zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lays out order 0 by the counts so far: taken slots, their parts, where each block's end among them, and what is left over there."""
    at = (zero != 0).nonzero()[0]  # most slots are empty
    e, kinds = zero.take(at), np.bincount(at >> ZERO, minlength=len(zero) >> ZERO)
    ends = np.cumsum(kinds)
    count = e >> _COUNT & (1 << ZERO) - 1
    up_to = np.concatenate(([0], np.cumsum(count)))
    # one part for each that was seen, the rest by counts; the factor is a little less than fits
    total = np.maximum(up_to[ends] - up_to[ends - kinds], 1)
    rate = ((1 << SEEN) - kinds).astype(np.float32) / total.astype(np.float32) * np.float32(0.99999)
    part = (count * np.repeat(rate, kinds).astype(float)).astype(np.int64) + 1
    up_to = np.concatenate(([0], np.cumsum(part)))
    before = up_to[ends - kinds]
    start = up_to[:-1] - np.repeat(before, kinds)
    zero[at] = e & ~_LAID | start << FREQ - SEEN + 18 | part << FREQ - SEEN
    return at, part, ends, (1 << SEEN) - (up_to[ends] - before)


def _laid(s: np.ndarray) -> np.ndarray:
    """The places that order 0 has for the symbols of some blocks, a row each; 0 if none."""
    zero, (own, slot), out = np.zeros(len(s) << ZERO, np.int64), _slots(s), np.empty(s.shape, np.int64)
    stops = [0, *(t for t in RENEW if t < s.shape[1]), s.shape[1]]
    for begin, end in pairwise(stops):
        ids, to = own[:, begin:end].ravel(), slot[:, begin:end].ravel()
        e = zero.take(to)
        out[:, begin:end] = ((e & _LL) * (e >> _LS == ids)).reshape(len(s), -1)
        if end < s.shape[1]:
            _count(zero, ids, to)
            _lay_out(zero)
    return out


class Zero:
    """Order 0 of n blocks side by side, as it was laid out last."""

    def __init__(self, n: int) -> None:
        # what is known of each slot; which stands at each part of a block's interval
        self.n, self.all, self.slot_of = n, np.zeros(n << ZERO, np.int64), np.zeros(n << SEEN, np.int16)

    def renew(self, s: np.ndarray) -> None:
        """Counts the symbols s, a row for each step since the last time, and lays out anew."""
        for i in range(0, self.n, LANES):
            zero = self.all[i << ZERO : i + LANES << ZERO]
            own, slot = _slots(np.ascontiguousarray(s[:, i : i + LANES].T))
            _count(zero, own.ravel(), slot.ravel())
            at, part, ends, rest = _lay_out(zero)
            # behind the parts of a block, what is left of its interval
            self.slot_of[i << SEEN : i + LANES << SEEN] = np.repeat(np.insert((at & (1 << ZERO) - 1).astype(np.int16), ends, 0), np.insert(part, ends, rest))

    def at(self, blocks: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that stand at these parts, and their places."""
        e = self.all.take((blocks << _LZ) + self.slot_of.take((blocks << _LN) + part))
        return np.maximum(e >> _LS, _L1) - _L1, e & _LL


def _guessed(s8: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The guesses of order 2 and of order 1 before each of the symbols of some blocks, a row each."""
    mixed = _mixed(s8)
    one, two = np.zeros_like(mixed), np.zeros_like(mixed)
    one[:, 1:] = mixed[:, :-1] >> _H1
    two[:, 1:] = mixed[:, :-1] * _H3
    two[:, 2:] += _left(mixed[:, :-2])
    return _guesses(s8, two >> _H2), _guesses(s8, one)


def _steps(s: np.ndarray, p2: np.ndarray, p1: np.ndarray, places: np.ndarray, lane: np.ndarray, n: int) -> np.ndarray:
    """The steps of some blocks, a row each, which are `lane` of all n, by their guesses."""
    s8, place = s << _N3, _laid(s)
    of2, of1 = (p2 ^ s8) < _N8, (p1 ^ s8) < _N8
    order = np.maximum(np.maximum(of2.view(np.int8) * _B3, of1.view(np.int8) * _B2), (place > 0).view(np.int8))
    place = np.where(order > 1, _GUESS, np.where(order == 1, place, places.take(s)))
    at = ((p2 & _N7) << _N3 | p1 & _N7) * np.int64(n) + lane[:, None]
    return place | (_B3 - order).astype(np.int64) << _ORDER | at << _AT


def _turned(a: np.ndarray, out: np.ndarray) -> None:
    """The transpose, some columns at a time: they stay in the cache."""
    for i in range(0, a.shape[0], 64):
        for j in range(0, a.shape[1], 64):
            out[j : j + 64, i : i + 64] = a[i : i + 64, j : j + 64].T


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2**FREQ, one at least each."""
    total = 1 << FREQ
    f = np.maximum(1, counts * total // max(1, int(counts.sum())))
    short = total - int(f.sum())
    while short:
        # what is missing goes to the most frequent; what is too much is taken from them in turn
        order = np.argsort(-f, kind="stable")
        if short > 0:
            f[order[0]] += short
            break
        take = np.minimum(f[order] - 1, np.maximum(1, f[order] * -short // total + 1))
        take = np.minimum(take, np.maximum(0, -short - (np.cumsum(take) - take)))
        f[order] -= take
        short = total - int(f.sum())
    return f


def _places(counts: np.ndarray) -> np.ndarray:
    f = frequencies(counts)
    return (np.cumsum(f) - f << 18 | f).astype(np.int64)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], block: int = BLOCK) -> bytes:
    """A segment: ids of documents one after the other, with their numbers of ids."""
    if not 0 < block <= 1 << IDS:
        raise ValueError(f"a block has 1 to {1 << IDS} ids")
    if len(ids) and int(ids.max()) < 1 << 24:
        tally = np.bincount(ids)
        seen, place = np.flatnonzero(tally), np.zeros(len(tally), np.int32)
        place[seen] = np.arange(len(seen))
        sym, counts = place[ids], tally[seen]
    else:
        seen, sym, counts = np.unique(ids, return_inverse=True, return_counts=True)
    if rare := len(seen) > KINDS:
        # symbol 0 stands for all ids that the head lacks
        most = np.sort(np.argsort(-counts, kind="stable")[: KINDS - 1])
        to = np.zeros(len(seen), np.int64)
        to[most] = np.arange(1, KINDS)
        sym = to[sym]
        seen, counts = seen[most], np.concatenate(([len(ids) - counts[most].sum()], counts[most]))
    n = -(-len(ids) // block)
    words, sizes = _encode(sym.astype(np.int32, copy=False), counts, n, block)
    ids = ids.astype("<u4")
    bodies, checks, ends = [], [], np.cumsum(sizes)
    for i in range(n):
        part = ids[i * block : (i + 1) * block]
        bodies.append(words[ends[i] - sizes[i] : ends[i]].tobytes())
        if rare:
            bodies[-1] += part[sym[i * block : (i + 1) * block] == 0].tobytes()
        checks.append(zlib.crc32(part.tobytes(), zlib.crc32(bodies[-1])))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = b"".join([
        np.diff(seen.astype(np.int64), prepend=0).astype("<u4").tobytes(), counts.astype("<u4").tobytes(), np.array([len(b) for b in bodies], "<u4").tobytes(), np.array(checks, "<u4").tobytes(),
        known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
    ])
    head = zlib.compress(head, 1)
    head = struct.pack("<IIIIII", len(ids), block, len(seen), rare, len(doc_ids), len(head)) + head
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(head)), head, *bodies])


def _encode(sym: np.ndarray, counts: np.ndarray, n: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, one block after the other, and their numbers."""
    if not n:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    last = len(sym) - (n - 1) * block
    lanes = np.zeros((n, block), np.int32)
    lanes.ravel()[: len(sym)] = sym
    places, steps, lane = _places(counts), np.empty((block, n), np.int64), np.arange(n)
    for i in range(0, n, SPAN):
        p2, p1 = _guessed(lanes[i : i + SPAN] << _N3)
        for j in range(i, min(n, i + SPAN), LANES):
            part = np.s_[j : j + LANES]
            _turned(_steps(lanes[part], p2[j - i : j - i + LANES], p1[j - i : j - i + LANES], places, lane[part], n), steps[:, part])
    weights, m = Weights(n), n
    room = block + 8
    out, used = np.zeros(n * room, np.uint32), np.arange(n, dtype=np.int64) * room
    low, rng = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    for t in range(block):
        m = n if t < last else n - 1
        if not m:
            break
        step = steps[t, :m]
        weights.take(step >> _LA)
        step = step.view(np.uint64)
        weights.part(step >> _BITS & _SHIFT)
        c, f = weights.interval(step & _WHERE)
        lo, r = low[:m], rng[:m]
        r >>= _ALL
        lo += r * c
        r *= f
        due = (r < _PAGE).nonzero()[0]
        lo, r, to = low[due], rng[due], used[due]
        # where the interval reaches across a word's end it is cut there, so no word changes once written
        r = np.where((lo ^ lo + r - _1) < _PAGE, r, ~lo + _1 & _LOW)
        out[to] = (lo >> _32).astype(np.uint32)
        used[due] = to + 1
        low[due], rng[due] = lo << _32, r << _32
        weights.learn()
    for by in (32, 0):
        out[used] = (low >> np.uint64(by) & _LOW).astype(np.uint32)
        used += 1
    sizes = used - np.arange(n) * room
    keep = np.arange(room)[None, :] < sizes[:, None]
    return out.reshape(n, room)[keep].astype("<u4"), sizes


class Segment:
    """A segment's head, and its blocks as they are asked for. ValueError if what is read is damaged."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC or len(data) < 32:
            raise ValueError("not a segment")
        total, self.block, kinds, rare, docs, size = struct.unpack_from("<IIIIII", data, 8)
        if zlib.crc32(data[8 : 32 + size]) != struct.unpack_from("<I", data, 4)[0]:
            raise ValueError("the head is damaged")
        head = zlib.decompress(data[32 : 32 + size])
        self.total, self.blocks, at, parts = total, -(-total // self.block), 0, []
        for kind, k in (("<u4", kinds), ("<u4", kinds + rare), ("<u4", self.blocks), ("<u4", self.blocks), ("<u1", docs), ("<i8", docs), ("<u4", docs)):
            parts.append(np.frombuffer(head, kind, k, at))
            at += parts[-1].nbytes
        steps, self.counts, sizes, self.checks, known, doc_ids, self.lengths = parts
        self.seen = np.cumsum(steps.astype(np.int64))
        self.rare = bool(rare)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        ends = 32 + size + np.cumsum(sizes.astype(np.int64))
        self.bodies = [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def read(self, blocks: list[int]) -> list[np.ndarray | None]:
        """The ids of some blocks; None for one that is damaged."""
        if not blocks:
            return []
        # a shorter block comes last, as it does in a segment
        order = sorted(range(len(blocks)), key=lambda i: blocks[i])
        bodies = [self.bodies[blocks[i]] for i in order]
        last = self.total - (self.blocks - 1) * self.block if blocks[order[-1]] == self.blocks - 1 else self.block
        sym, used = _decode(bodies, self.counts.astype(np.int64), last, self.block)
        out: list[np.ndarray | None] = [None] * len(blocks)
        for lane, i in enumerate(order):
            s = sym[lane, : last if lane == len(order) - 1 else self.block]
            if self.rare:
                ids = self.seen[np.maximum(s - 1, 0)].astype("<u4")
                there = np.flatnonzero(s == 0)
                literal = np.frombuffer(bodies[lane][4 * int(used[lane]) :], "<u4")
                if len(literal) != len(there):
                    continue
                ids[there] = literal
            else:
                ids = self.seen[s].astype("<u4")
            if zlib.crc32(ids.tobytes(), zlib.crc32(bodies[lane])) == self.checks[blocks[i]]:
                out[i] = ids
        return out


def decode(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, doc_ids and lengths of a segment; ValueError if anything in it is damaged."""
    segment = Segment(data)
    got = segment.read(list(range(segment.blocks)))
    if bad := [i for i, x in enumerate(got) if x is None]:
        raise ValueError(f"blocks {bad} are damaged")
    return np.concatenate([*got, np.zeros(0, "<u4")]), segment.doc_ids, segment.lengths


def _decode(bodies: list[bytes], counts: np.ndarray, last: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of blocks, a row each, the last of `last` ids; and how many words each took."""
    n = len(bodies)
    places = _places(counts)
    symbol = np.repeat(np.arange(len(counts), dtype=np.int32), places & _PLACE)
    # a damaged block may ask for more words than it has: it gets some others, and fails its check
    words = np.frombuffer(b"".join([b[: len(b) // 4 * 4] for b in bodies] + [bytes(4 * block + 64)]), "<u4")
    start = np.cumsum([0, *(len(b) // 4 for b in bodies)])[:-1]
    at = start.copy()
    code = words[at].astype(np.uint64) << _32 | words[at + 1].astype(np.uint64)
    at += 2
    weights, guesses, zero = Weights(n), Guesses(n), Zero(n)
    lanes, m, laid = np.zeros((block, n), np.int32), n, 0
    low, rng, lane, wide = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64), np.arange(n, dtype=np.int32), np.array(n, np.int32)
    for t in range(block):
        if t == last:
            m = n - 1
            guesses.narrow(m)
            lane = lane[:m]
        if not m:
            break
        if t in RENEW:
            zero.renew(lanes[laid:t])
            laid = t
        p = guesses.take()
        weights.take(((guesses.c[0] << _N3 | guesses.c[1]) * wide + lane).astype(np.int64))
        lo, r = low[:m], rng[:m]
        r >>= _ALL
        v = (code[:m] - lo) // r
        # a bit above each sum is left where the sum is more; a damaged block may ask for more than there is
        more = (weights.sums | _ABOVE) - (np.minimum(v >> _FREQ, _MOST) * _EACH + _EACH)
        order = ((more >> _15 & _EACH) * _EACH >> _32 & _3).astype(np.int8)
        weights.part((_B3 - order).astype(np.uint64) << _4)
        # a quotient of such numbers that isn't whole is further from a whole one than a double's error
        within = ((v - weights.start).astype(float) / weights.length.astype(float)).astype(np.int64)
        s, place = np.zeros(m, np.int32), np.full(m, _GUESS)
        none = (order == 0).nonzero()[0]
        s[none] = of = symbol.take(within.take(none), mode="clip")
        place[none] = places.take(of)
        one = (order == 1).nonzero()[0]
        if len(one):
            s[one], place[one] = zero.at(one, np.minimum(within.take(one) >> _LP, _LT))
        guessed = (order > 1).nonzero()[0]
        if len(guessed):
            s[guessed] = p.take(guessed + m * (order.take(guessed) == 2)) >> _N3
        lanes[t, :m] = s
        c, f = weights.interval(place.view(np.uint64))
        lo += r * c
        r *= f
        due = (r < _PAGE).nonzero()[0]
        lo, r, to = low[due], rng[due], at[due]
        r = np.where((lo ^ lo + r - _1) < _PAGE, r, ~lo + _1 & _LOW)
        code[due] = code[due] << _32 | words.take(to, mode="clip").astype(np.uint64)
        at[due] = to + 1
        # a damaged block may come to a length of 0: it goes on and fails its check
        low[due], rng[due] = lo << _32, np.maximum(r << _32, _PAGE)
        weights.learn()
        guesses.learn(s << _N3)
    out = np.empty((n, block), np.int32)
    _turned(lanes, out)
    return out, at - start
