"""Adaptive context-mixing range coder over token ids, many blocks in lockstep.

A block is coded on its own: its model starts afresh and its checksums are its own. For each id the order-2
context (two ids before) and the order-1 context each predict the id they last saw, with a confidence from
their recent hits; order 0 is the distribution of the ids of the whole frame (`Table`, kept in its head). A
decision is coded first: order 2 is right, order 1 is right, or neither, and the id then goes by order 0. The
decision's probabilities mix two adaptive tables by adding their counts: one by the confidences and agreement
of the predictions, one by the last two decisions. Ids are any unsigned 32-bit numbers.

Of the coder's state a block keeps 48 bits; words of 16 bits leave it from above, and a carry is added to
the words that left before. All numpy arrays run over the blocks of a frame ("lanes"): step t codes the
t-th id of every block.
"""

from __future__ import annotations

import zlib

import numpy as np

from sluice.llm import textcore as tc

BLOCK = 2048
_BITS = 10  # of a context table
#: What a decision adds to its counts, and the most that a row may come to in a block: two rows together stay within 16 bits.
_STEP, _ROOM = 24, 32_000
U = np.uint64
_STATE, _TOP, _MASK, _W16, _W32, _W48 = U(1 << 48), U(1 << 32), U((1 << 48) - 1), U(16), U(32), U(48)
_ONES, _FIELD = U(0x0001000100010001), U(0xFFFF)


class Table:
    """The order-0 distribution: distinct ids in ascending order, their frequencies out of 2**bits, each 1 at least, and the sums before them."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int):
        self.ids, self.freq, self.bits = ids, freq.astype(U), bits
        self.before = np.cumsum(self.freq) - self.freq
        self.at = np.repeat(np.arange(len(ids), dtype=np.int32), freq)  # the number of the id that holds a place

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple["Table", np.ndarray]:
        """The distribution of ids, and their numbers in it."""
        top = int(ids.max()) + 1 if len(ids) else 0
        if top <= 4 * len(ids) + (1 << 20):
            counts = np.bincount(ids, minlength=top)
            distinct = np.flatnonzero(counts)
            counts, number = counts[distinct], np.empty(top, np.int32)
            number[distinct] = np.arange(len(distinct))
            numbers = number[ids]
        else:
            distinct, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        bits = max(16, (2 * len(distinct)).bit_length())
        freq = 1 + counts * ((1 << bits) - len(distinct)) // max(1, len(ids))
        if len(freq):
            freq[np.argmax(freq)] += (1 << bits) - freq.sum()
        return cls(distinct.astype(np.uint32), freq.astype(np.int64), bits), numbers.astype(np.int32)

    def dump(self) -> bytes:
        steps = np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4")
        return bytes([self.bits]) + zlib.compress(steps.tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def load(cls, data: bytes) -> "Table":
        raw = np.frombuffer(zlib.decompress(data[1:]), "<u4")
        n = len(raw) // 2
        return cls(np.cumsum(raw[:n].astype(np.int64)).astype(np.uint32), raw[n:].astype(np.int64), data[0])


class Model:
    """A row of counts is one 64-bit number of 16-bit fields, one for each decision; a context's id and confidence are one number, too."""

    def __init__(self, lanes: int, steps: int):
        if steps > _ROOM:
            raise ValueError(f"a block holds {_ROOM} ids at most")
        lane = np.arange(lanes)
        self.add = U(max(1, min(_STEP, _ROOM // max(1, steps))))
        self.high, self.row_a0, self.row_b0 = lane << _BITS, lane << 5, lane << 4
        self.seen1, self.seen2 = np.zeros(lanes << _BITS, np.int32), np.zeros(lanes << _BITS, np.int32)
        self.by_state, self.by_past = np.full(lanes * 32, 2 * _ONES), np.full(lanes * 16, 2 * _ONES)
        for table in (self.by_state, self.by_past):
            table &= U((1 << 48) - 1)  # three decisions
        self.past = np.zeros(lanes, np.int64)
        self.x1, self.x2 = np.full(lanes, 65535, np.int64), np.full(lanes, 65535, np.int64)

    def predict(self, m: int):
        """For the first m lanes what the contexts predict, and the frequencies of the decisions, alone and summed up."""
        mask, high = (1 << _BITS) - 1, self.high[:m]
        k = self.x1[:m] * 40503
        self.at1, self.at2 = high + (k >> 5 & mask), high + (k + self.x2[:m] * 30011 >> 4 & mask)
        s1, s2 = self.seen1.take(self.at1), self.seen2.take(self.at2)
        self.p1, self.p2, self.c1, self.c2 = s1 >> 5, s2 >> 5, s1 & 6, s2 & 24
        self.row_a = self.row_a0[:m] + ((self.c2 | self.c1) + (self.p1 == self.p2))
        self.row_b = self.row_b0[:m] + self.past[:m]
        self.of_a, self.of_b = self.by_state.take(self.row_a), self.by_past.take(self.row_b)
        self.freq = self.of_a + self.of_b
        self.sums = self.freq * _ONES  # field k: the sum of fields up to k
        self.total = self.sums >> _W48

    def span(self, decision: np.ndarray):
        """Start and frequency of the decisions, and the shift to their field."""
        shift = decision.astype(U) << U(4)
        freq = self.freq >> shift & _FIELD
        return (self.sums >> shift & _FIELD) - freq, freq, shift

    def update(self, m: int, x: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, decision: np.ndarray, shift: np.ndarray):
        step = self.add << shift
        self.by_state[self.row_a] = self.of_a + step
        self.by_past[self.row_b] = self.of_b + step
        x = x << 5
        # a hit adds one to the confidence, up to 3; else it is 1 again. Two bits each: from bit 1 on and from bit 3 on
        self.seen1[self.at1] = x + 2 + hit1 * np.minimum(self.c1, 4)
        self.seen2[self.at2] = x + 8 + hit2 * np.minimum(self.c2, 16)
        self.past[:m] = (self.past[:m] << 2 | decision) & 15
        self.x2[:m], self.x1[:m] = self.x1[:m], x >> 5


def encode(numbers: np.ndarray, table: Table, block: int = BLOCK) -> list[tuple[int, bytes]]:
    """Blocks of ids, given by their numbers in the table: for each the number of ids and its words."""
    n = len(numbers)
    lanes = -(-n // block)
    if not lanes:
        return []
    last = n - (lanes - 1) * block
    x = np.zeros(lanes * block, np.int32)
    x[:n] = numbers
    x = np.ascontiguousarray(x.reshape(lanes, block).T)  # a step's ids lie together
    model, bits = Model(lanes, block), U(table.bits)
    low, span = np.zeros(lanes, U), np.full(lanes, _STATE)
    width = 2 * block + 8
    out, to = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width

    def moved(lo, sp, m):
        """Takes carries over and moves words out until every span is large enough."""
        over = lo >= _STATE
        if over.any():
            out[to[:m][over] - 1] += 1
            lo &= _MASK
        small = sp < _TOP
        while small.any():
            out[to[:m]] = lo >> _W32  # where none leaves, the next word comes here
            to[:m] += small
            shift = small.astype(U) << U(4)
            lo = (lo << shift) & _MASK
            sp = sp << shift
            small = sp < _TOP
        return lo, sp

    for t in range(block if lanes > 1 else last):
        m = lanes if t < last else lanes - 1
        model.predict(m)
        now = x[t, :m]
        hit1, hit2 = model.p1 == now, model.p2 == now
        right1, right2 = hit1 & (model.c1 > 0), hit2 & (model.c2 > 0)
        decision = np.where(right2, 0, 2 - right1)
        start, freq, shift = model.span(decision)
        r = span[:m] // model.total
        lo, sp = low[:m] + start * r, freq * r
        if table.bits > 16:
            lo, sp = moved(lo, sp, m)
        r = sp >> bits
        missed = decision == 2
        lo = lo + np.where(missed, r * table.before.take(now), 0)
        sp = np.where(missed, r * table.freq.take(now), sp)
        low[:m], span[:m] = moved(lo, sp, m)
        model.update(m, now, hit1, hit2, decision, shift)
    # one more word names a number within the span
    end = (low + (_TOP - U(1))) >> _W32
    over = np.flatnonzero(end >> _W16)
    out[to[over] - 1] += 1
    out[to] = end & _FIELD
    to += 1
    words = out.reshape(lanes, width)
    used = to - np.arange(lanes) * width
    for j in range(int(used.max()) - 1, 0, -1):  # carries run on
        words[:, j - 1] += words[:, j] >> 16
    words &= 0xFFFF
    words = words.astype("<u2")
    return [(block if i < lanes - 1 else last, words[i, :k].tobytes()) for i, k in enumerate(used.tolist())]


def decode(blocks: list[tuple[int, bytes]], table: Table, block: int = BLOCK) -> list[np.ndarray]:
    """The ids of each block, in the order given; block is that of encode."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    sizes = np.asarray([blocks[i][0] for i in order])
    lanes, steps = len(order), int(sizes[0]) if len(order) else 0
    if not steps:
        return [np.empty(0, np.uint32) for _ in blocks]
    width = max(len(b) // 2 for _, b in blocks) + 8  # beyond the last word there are zeros
    words = np.zeros((lanes, width), np.uint16)
    for k, i in enumerate(order):
        w = np.frombuffer(blocks[i][1], "<u2")
        words[k, : len(w)] = w
    flat, at, end = words.ravel(), np.arange(lanes) * width + 3, (np.arange(lanes) + 1) * width - 1
    x = np.zeros((steps, lanes), np.int32)
    model, bits, whole = Model(lanes, block), U(table.bits), U((1 << table.bits) - 1)
    span = np.full(lanes, _STATE)
    held = words[:, 0].astype(U) << _W32 | words[:, 1].astype(U) << _W16 | words[:, 2]  # less the lower end

    def moved(he, sp, m):
        small = sp < _TOP
        while small.any():
            shift = small.astype(U) << U(4)
            he = (he << shift) | (flat.take(at[:m]) * small)
            sp = sp << shift
            at[:m] = np.minimum(at[:m] + small, end[:m])
            small = sp < _TOP
        return he, sp

    for t in range(steps):
        m = int(np.searchsorted(-sizes, -t, "left"))  # lanes with more than t ids
        model.predict(m)
        r = span[:m] // model.total
        v = held[:m] // r
        decision = (v >= model.sums & _FIELD).astype(np.int64) + (v >= model.sums >> _W16 & _FIELD)
        start, freq, shift = model.span(decision)
        he, sp = held[:m] - start * r, freq * r
        if table.bits > 16:
            he, sp = moved(he, sp, m)
        now = np.where(decision == 0, model.p2, model.p1)
        k = np.flatnonzero(decision == 2)
        if len(k):
            r, rest = sp[k] >> bits, he[k]
            found = table.at.take(np.minimum(rest // r, whole).astype(np.int64))
            now[k] = found
            he[k], sp[k] = rest - r * table.before.take(found), r * table.freq.take(found)
        held[:m], span[:m] = moved(he, sp, m)
        x[t, :m] = now
        model.update(m, now, model.p1 == now, model.p2 == now, decision, shift)
    ids = table.ids
    out: list = [None] * lanes
    rows = np.ascontiguousarray(x.T)
    for k, i in enumerate(order):
        out[i] = ids.take(rows[k, : sizes[k]])
    return out


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


tc.by_value(__name__)
