"""Adaptive context-mixing range coder for token ids, many blocks in step.

Every block starts from the same opening model and ends with its own checksum, so any block can be read alone with the
segment's head (decode_block). Three models predict each id, and all three adapt in the block as it is read:

* order 2 and order 1: the id that last followed the same two ids, or the same id; its confidence is how often in a row
  it has been right;
* order 0: probabilities of 16 frequency classes of ids, which move towards each class that is seen; inside a class the
  ids' frequencies in the segment, which stand in its head.

The range of each id is mixed from the three: order 2 has the weight w2, order 1 has w1, order 0 the rest, and an id lies in
the part of the highest order that names it. The weights are hit rates by confidence, adaptive in each block too.
All blocks of a segment take the same step together in numpy, which is what makes a model for each id affordable.

Segment: magic, ids, blocks, bits inside a class, block size, head length, head (deflated), then for each block (ids,
payload words or -1 for raw, CRC-32 of ids and payload), then payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR4"
HEAD = "<IIBII"
BITS1, BITS2 = 7, 8  # contexts kept of each order
CLASSES, RATE = 16, 5
GATE, ROOM = np.uint64(8), np.uint64(256)
FULL, HALF, MASK = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(32), np.uint64(0xFFFFFFFF)
K1, K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
ONE, THREE, SIX, SEVEN = np.uint32(1), np.uint32(3), np.uint32(6), np.uint32(7)
LEAST, SPAN = np.int32(256), np.int32(250 * 256 - 256)
EIGHT, WHOLE = np.int32(8), np.int32(256)
#: Opening hit rates by confidence, in 65,536ths.
OPENING = np.array([256, 15000, 24000, 31000, 37000, 42000, 48000, 55000], np.int32)


class Order0:
    """Places by falling frequency, their classes of about equal weight, and their parts of 2**bits inside the class."""

    def __init__(self, known: np.ndarray, count: np.ndarray):
        if len(known) > 1 << 18:
            raise ValueError("more than 2**18 different ids in a segment")
        order = np.argsort(-count, kind="stable")
        self.known, c = known[order].astype(np.uint32), count[order]
        n, upto = len(c), np.append(0, np.cumsum(c))
        most = 1 << max(12, (-(-n // CLASSES) - 1).bit_length())  # ids that a class may hold
        first = [0]
        for left in range(CLASSES, 0, -1):
            a = first[-1]
            b = int(np.searchsorted(upto, upto[a] + -(-(upto[n] - upto[a]) // left)))
            first.append(min(n, a + most, max(b, a + 1, n - most * (left - 1))))
        size = np.diff(first)
        # Gate, class and inner bits make 32 at most: no part of the least range is empty.
        self.bits = max(10, (int(size.max(initial=1)) - 1).bit_length() + 1)
        self.class_bits = min(11, 24 - self.bits)
        self.cls = np.repeat(np.arange(CLASSES), size)
        first = np.array(first[:-1])[size > 0]
        if n:
            room, own = 1 << self.bits, np.add.reduceat(c, first)
            freq = 1 + c * (room - size[self.cls]) // np.repeat(own, size[size > 0])
            freq[first] += room - np.add.reduceat(freq, first)
        else:
            freq = np.zeros(0, np.int64)
        low = np.cumsum(freq) - freq
        self.owner = np.repeat(np.arange(n, dtype=np.uint32), freq)  # class << bits | part of it -> place
        self.low = (low - (self.cls << self.bits)).astype(np.uint64)
        self.freq = freq.astype(np.uint64)


class Model:
    """State of each block: contexts of orders 1 and 2, hit rates by confidence, class bounds."""

    def __init__(self, lanes: int, class_bits: int):
        lane, i, top = np.arange(lanes), np.arange(CLASSES), 1 << class_bits
        self.base1, self.base2 = lane << BITS1, lane << BITS2
        self.t1, self.t2 = np.zeros(lanes << BITS1, np.uint32), np.zeros(lanes << BITS2, np.uint32)
        self.rate1, self.rate2 = np.tile(OPENING, lanes), np.tile(OPENING, lanes)
        self.lane = lane << 3
        # Lower bounds of the classes, a row a block; the first is always 0, so what follows a row's last is 0 too.
        self.flat = np.append(np.tile((i * (top // CLASSES)).astype(np.int16), lanes), np.int16(0))
        self.bounds = self.flat[:-1].reshape(lanes, CLASSES)
        # Where class bounds move when a class is seen: those above it up, the others down, no class below one part.
        self.towards = np.where(i[None, :] <= i[:, None], i, top - CLASSES + i).astype(np.int16)
        self.mask = np.int16(top - 1)
        self.row = lane * CLASSES
        self.prev1, self.prev2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def look(self, n: int) -> None:
        """Predictions g1, g2 and weights w1, w2 (parts of 256, order 0 has the rest) of the first n blocks."""
        one = self.prev1[:n]
        self.s1 = self.base1[:n] + (one >> np.uint32(32 - BITS1))
        self.s2 = self.base2[:n] + ((one + self.prev2[:n]) >> np.uint32(32 - BITS2))
        x1, x2 = self.t1.take(self.s1, mode="clip"), self.t2.take(self.s2, mode="clip")
        self.g1, self.g2 = x1 >> THREE, x2 >> THREE
        self.c1, self.c2 = x1 & SEVEN, x2 & SEVEN
        self.i1, self.i2 = self.lane[:n] + self.c1, self.lane[:n] + self.c2
        self.r1, self.r2 = self.rate1.take(self.i1, mode="clip"), self.rate2.take(self.i2, mode="clip")
        self.apart = self.g1 != self.g2
        self.w2 = self.r2 >> EIGHT
        self.w1 = ((WHOLE - self.w2) * (self.r1 >> EIGHT) >> EIGHT) * self.apart

    def learn(self, place: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, cls: np.ndarray, odd: int) -> None:
        """Move what was looked up towards the ids that came: contexts always, hit rates and classes in turn. Order 1 counts
        where it differs from an order 2 that fails."""
        n = len(place)
        fresh = place << THREE | ONE
        self.t1[self.s1] = fresh + np.minimum(self.c1, SIX) * hit1
        self.t2[self.s2] = fresh + np.minimum(self.c2, SIX) * hit2
        if odd:
            self.rate2[self.i2] = self.r2 + ((hit2 * SPAN + LEAST - self.r2) >> RATE)
            self.rate1[self.i1] = self.r1 + ((hit1 * SPAN + LEAST - self.r1) >> RATE) * (self.apart > hit2)
        else:
            b = self.bounds[:n]
            step = self.towards.take(cls, 0)
            step -= b
            step >>= RATE
            b += step
        self.prev2[:n] = self.prev1[:n] * (K1 ^ K2)
        self.prev1[:n] = (place + ONE) * K1

    def class_at(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound and width of a class in each block."""
        at = self.row[: len(cls)] + cls
        lo = self.flat.take(at)
        return lo.astype(np.uint64), ((self.flat.take(at + 1) - lo) & self.mask).astype(np.uint64)


def shift(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Carry-free widths: those whose ends differ above 32 bits are cut at the next border."""
    return np.where((a ^ (a + w)) >> HALF != 0, (~a + np.uint64(1)) & MASK, w)


def encode(ids: np.ndarray, block: int | None = None) -> bytes:
    """One segment. block: ids in a block, by default so that a segment has many blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    block = block or int(np.clip(len(ids) // 2048, 256, 4096))
    lanes = -(-len(ids) // block)
    sizes = np.full(lanes, block)
    if lanes:
        sizes[-1] = len(ids) - block * (lanes - 1)
    high = int(ids.max()) + 1 if lanes else 0
    if high > 1 << 24:
        raise ValueError("ids must be below 2**24")
    count = np.bincount(ids, minlength=high)
    known = np.flatnonzero(count)
    zero = Order0(known, count[known])
    place_of = np.zeros(high, np.uint32)
    place_of[zero.known] = np.arange(len(known), dtype=np.uint32)

    grid = np.zeros(lanes * block, np.uint32)
    grid[: len(ids)] = place_of[ids]
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    inner, total = np.uint64(zero.bits), np.uint64(zero.bits + zero.class_bits)
    cap = block + 8
    out, at = np.zeros((lanes, cap), "<u4"), np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    m = Model(lanes, zero.class_bits)
    for t in range(block if lanes else 0):
        n = lanes if t < sizes[-1] else lanes - 1
        if not n:
            break
        want = grid[t, :n]
        m.look(n)
        hit1, hit2 = m.g1 == want, m.g2 == want
        cls = zero.cls.take(want)
        rest = ~(hit1 & (m.w1 > 0) | hit2)
        both = m.w2 + m.w1
        r = rng[:n] >> GATE
        a = low[:n] + r * (both * rest + m.w2 * ~(rest | hit2)).astype(np.uint64)  # higher orders that don't name it lie below
        w = r * np.where(rest, WHOLE - both, np.where(hit2, m.w2, m.w1)).astype(np.uint64)
        lo, wide = m.class_at(cls)
        r = (w >> total) * rest
        a += r * ((lo << inner) + wide * zero.low.take(want))
        w = np.where(rest, r * (wide * zero.freq.take(want)), w)
        small = np.flatnonzero(w <= MASK)
        if len(small):
            x, y = a.take(small), w.take(small)
            y = shift(x, y)
            out[small, np.minimum(at.take(small), cap - 3)] = x >> HALF
            at[small] += 1
            a[small], w[small] = x << HALF, y << HALF
        low[:n], rng[:n] = a, w
        m.learn(want, hit1, hit2, cls, t & 1)
    info = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes() + count[known].astype("<u4").tobytes(), 1)
    head, body = [], []
    for k in range(lanes):
        own = ids[k * block : k * block + sizes[k]].astype("<u4")
        raw = at[k] + 2 > min(cap - 3, len(own))
        if not raw:
            out[k, at[k]], out[k, at[k] + 1] = low[k] >> HALF, low[k] & MASK
        body.append(own.tobytes() if raw else out[k, : at[k] + 2].tobytes())
        head.append(struct.pack("<IiI", len(own), -1 if raw else int(at[k] + 2), zlib.crc32(body[-1], zlib.crc32(own))))
    return b"".join([MAGIC, struct.pack(HEAD, len(ids), lanes, zero.bits, block, len(info)), info, *head, *body])


class Segment:
    """The head of a segment and where its blocks lie."""

    def __init__(self, seg: bytes):
        if seg[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.seg = seg
        try:
            self.total, self.lanes, bits, self.block, size = struct.unpack_from(HEAD, seg, 4)
            at = 4 + struct.calcsize(HEAD)
            info = zlib.decompress(seg[at : at + size])
        except (zlib.error, struct.error) as e:
            raise ValueError("damaged head") from e
        d = len(info) // 8
        self.zero = Order0(np.cumsum(np.frombuffer(info, "<u4", d)), np.frombuffer(info, "<u4", d, 4 * d).astype(np.int64))
        at += size
        self.heads = [struct.unpack_from("<IiI", seg, at + 12 * k) for k in range(self.lanes)]
        size = np.array([4 * (n if w < 0 else w) for n, w, _ in self.heads], np.int64)
        self.at = at + 12 * self.lanes + np.cumsum(size) - size

    def read(self, blocks: list[int]) -> list[np.ndarray]:
        """The ids of the given blocks (in falling size); ValueError if a checksum differs."""
        seg, zero = self.seg, self.zero
        coded = [k for k in blocks if self.heads[k][1] >= 0]
        got = {k: np.frombuffer(seg, "<u4", self.heads[k][0], self.at[k]) for k in blocks if self.heads[k][1] < 0}
        if coded:
            words = [np.frombuffer(seg, "<u4", self.heads[k][1], self.at[k]) for k in coded]
            for x, k in enumerate(coded):
                got[k] = x
            ids = self._run(words, np.array([self.heads[k][0] for k in coded]))
            for k in coded:
                got[k] = ids[: self.heads[k][0], got[k]]
        for k in blocks:
            n, w, crc = self.heads[k]
            if zlib.crc32(seg[self.at[k] : self.at[k] + 4 * (n if w < 0 else w)], zlib.crc32(np.ascontiguousarray(got[k], "<u4"))) != crc:
                raise ValueError(f"checksum of block {k} differs")
        return [got[k] for k in blocks]

    def _run(self, words: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        zero = self.zero
        inner, total = np.uint64(zero.bits), np.uint64(zero.bits + zero.class_bits)
        most = np.uint64((1 << zero.bits + zero.class_bits) - 1)
        base = np.cumsum([0, *[len(w) for w in words[:-1]]]).astype(np.int64)
        flat = np.concatenate([*words, np.zeros(8, "<u4")]).astype(np.uint64)
        lanes, nxt = len(words), base + 2
        low, rng, code = np.zeros(lanes, np.uint64), np.full(lanes, FULL), flat[base] << HALF | flat[base + 1]
        got = np.zeros((int(sizes.max()), lanes), np.uint32)
        m = Model(lanes, zero.class_bits)
        last = int(zero.cls[-1]) if len(zero.cls) else 0
        live = lanes - np.cumsum(np.bincount(sizes, minlength=int(sizes.max()) + 1))  # they come in falling size
        for t in range(int(sizes.max())):
            n = int(live[t])
            m.look(n)
            r = rng[:n] >> GATE
            v, w2 = code[:n] - low[:n], m.w2.astype(np.uint64)
            both = w2 + m.w1.astype(np.uint64)
            r2, rb = r * w2, r * both
            is2, rest = v < r2, v >= rb
            a = low[:n] + np.where(rest, rb, r2 * ~is2)
            w = np.where(rest, r * (ROOM - both), np.where(is2, r2, rb - r2))
            r = w >> total
            u = np.minimum((code[:n] - a) // r, most)
            c = np.bitwise_count((m.bounds[:n] <= (u >> inner).astype(np.int16)[:, None]).view(np.uint64))
            c = np.minimum((c[:, 0] + c[:, 1]).astype(np.int64) - 1, last)
            lo, wide = m.class_at(c)
            lo <<= inner
            inside = np.minimum(((u - lo).view(np.int64) / wide.view(np.int64)).astype(np.int64), (1 << zero.bits) - 1)
            place = zero.owner.take((c << zero.bits) + inside, mode="clip")
            a += r * (lo + wide * zero.low.take(place)) * rest
            w = np.where(rest, r * (wide * zero.freq.take(place)), w)
            place = np.where(rest, place, np.where(is2, m.g2, m.g1))
            small = np.flatnonzero(w <= MASK)
            if len(small):
                x, y = a.take(small), w.take(small)
                y = shift(x, y)
                z = nxt.take(small)
                code[small] = code.take(small) << HALF | flat.take(z, mode="clip")
                nxt[small] = z + 1
                a[small], w[small] = x << HALF, np.maximum(y, np.uint64(1)) << HALF
            low[:n], rng[:n] = a, w
            m.learn(place, m.g1 == place, m.g2 == place, zero.cls.take(place, mode="clip"), t & 1)
            got[t, :n] = place
        return zero.known.take(got, mode="clip") if len(zero.known) else got


def decode(seg: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if a block's checksum differs or the head can't be read."""
    s = Segment(seg)
    return np.concatenate([*s.read(list(range(s.lanes))), np.zeros(0, np.uint32)]).astype(np.uint32)


def decode_block(seg: bytes, k: int) -> np.ndarray:
    """The ids of one block, read alone."""
    return Segment(seg).read([k])[0]
