"""Adaptive context-mixing range coder for ids below 65,536.

A run of ids is cut into blocks of equal length. Every block starts from the same empty model, has its own code and its own
checksum, so one can be read without the others. All blocks of a run are coded in step, one numpy lane each.

The model predicts ids in three orders. Order 2 and order 1 remember the id that last followed the two ids before, or the
one before; a small confidence counter selects how often such a prediction came true so far. Order 0 remembers the last id
of each of 256 slots. The chances are mixed so that each lower order shares what the higher ones leave, and predictions
that agree add up. A range coder codes which of them holds; an id that none predicts follows as a literal.
"""
from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block, and the sizes of the memories of order 1 and 2 within it.
BLOCK, SLOTS1, SLOTS2, SLOTS0 = 2048, 1024, 2048, 256
SCALE = 20  # chances are parts of 2 ** SCALE
SEEN, UNSEEN = 3200, 8  # bounds of an adaptive chance, of 4,096
_ORDER0_LEAST = 384
_LOW = np.uint64((1 << 48) - 1)
_NARROW = np.uint64(1 << 32)
_16, _32, _48, _S = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(SCALE)


class _Model:
    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.at1, self.at2, self.at0, self.at8 = lane * SLOTS1, lane * SLOTS2, lane * SLOTS0, lane * 8
        self.id1, self.id2 = np.zeros(lanes * SLOTS1, np.uint16), np.zeros(lanes * SLOTS2, np.uint16)
        self.sure1, self.sure2 = np.zeros(lanes * SLOTS1, np.uint8), np.zeros(lanes * SLOTS2, np.uint8)
        self.id0 = np.zeros(lanes * SLOTS0, np.uint16)
        self.rate1 = np.tile(np.linspace(200, 2400, 8).astype(np.int32), lanes)
        self.rate2 = np.tile(np.linspace(400, 2800, 8).astype(np.int32), lanes)
        self.rate0 = np.full(lanes, 1600, np.int32)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self) -> None:
        self.i1 = self.at1 + ((self.last * 40503 >> 6) & (SLOTS1 - 1))
        self.i2 = self.at2 + ((self.last * 40503 + self.before * 30011 >> 7) & (SLOTS2 - 1))
        self.p1, self.p2 = self.id1.take(self.i1), self.id2.take(self.i2)
        self.s1, self.s2 = self.sure1.take(self.i1), self.sure2.take(self.i2)
        self.r1, self.r2 = self.at8 + self.s1, self.at8 + self.s2
        self.chance1, self.chance2 = self.rate1.take(self.r1), self.rate2.take(self.r2)
        high = self.chance2 << (SCALE - 12)
        rest = (1 << SCALE) - high
        middle = rest * self.chance1.astype(np.int64) >> 12
        rest = rest - middle
        agree = self.p1 == self.p2
        self.width2 = np.where(agree, high + middle, high)
        self.width1 = np.where(agree, 0, middle)
        self.begin0 = self.width2 + self.width1
        self.width0 = rest * np.maximum(self.rate0, _ORDER0_LEAST) >> 20  # of each slot
        self.begin_literal = self.begin0 + (self.width0 << 8)

    def learn(self, x: np.ndarray, slot: np.ndarray, known0: np.ndarray) -> None:
        hit1, hit2 = self.p1 == x, self.p2 == x
        for hit, ids, sures, rates, i, r, sure, chance, id_ in ((hit1, self.id1, self.sure1, self.rate1, self.i1, self.r1, self.s1, self.chance1, self.p1),
                                                                (hit2, self.id2, self.sure2, self.rate2, self.i2, self.r2, self.s2, self.chance2, self.p2)):
            rates[r] = chance + (np.where(hit, SEEN, UNSEEN) - chance >> 4)
            ids[i] = np.where(sure == 0, x, id_)
            sures[i] = np.where(hit, np.minimum(sure + 1, 7), sure >> 1)
        self.rate0 += np.where(known0, SEEN, UNSEEN) - self.rate0 >> 5
        self.id0[self.at0 + slot] = x
        self.before, self.last = self.last, x.astype(np.int64)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> 8)).astype(np.int64) & (SLOTS0 - 1)


def encode(ids: np.ndarray) -> bytes:
    """A header (ids, blocks, block length), a row for each block (its checksum and sizes), then the codes and the literals."""
    n = len(ids)
    lanes = max(1, -(-n // BLOCK))
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps, np.uint16)
    padded[:n] = ids
    rows = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    lane, model = np.arange(lanes, dtype=np.int64), _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, int(_LOW), np.uint64)
    place = lanes + lane  # row 0 takes no digit
    digits = np.zeros((steps + 4) * lanes, np.uint32)
    literal = np.zeros((steps, lanes), bool)
    for t in range(steps):
        x = rows[t]
        model.predict()
        slot = _slot(x)
        hit2, hit1, hit0 = model.p2 == x, model.p1 == x, model.id0.take(model.at0 + slot) == x
        start = np.where(hit2, 0, np.where(hit1, model.width2, np.where(hit0, model.begin0 + slot * model.width0, model.begin_literal)))
        width = np.where(hit2, model.width2, np.where(hit1, model.width1, np.where(hit0, model.width0, (1 << SCALE) - model.begin_literal)))
        literal[t] = ~(hit2 | hit1 | hit0)
        part = span >> _S
        low += part * start.astype(np.uint64)
        span = part * width.astype(np.uint64)
        digits[place - lanes] += (low >> _48).astype(np.uint32)  # a carry goes to the digit before
        low &= _LOW
        full = span < _NARROW
        digits[place] = np.where(full, low >> _32, 0)
        place += full * lanes
        low = np.where(full, low << _16 & _LOW, low)
        span = np.where(full, span << _16, span)
        model.learn(x, slot, hit0)
    for shift in (_32, _16, np.uint64(0)):
        digits[place] = low >> shift & np.uint64(0xFFFF)
        place += lanes
    digits = digits.reshape(-1, lanes)
    for t in range(len(digits) - 1, 0, -1):
        digits[t - 1] += digits[t] >> 16
        digits[t] &= 0xFFFF
    counts = place // lanes - 1
    code = digits[1:].T.astype("<u2")
    used = np.arange(code.shape[1]) < counts[:, None]
    literals = literal.sum(axis=0)
    wide = padded.astype("<u4").reshape(lanes, steps)
    sums = [zlib.crc32(wide[k]) for k in range(lanes)]
    head = np.array([n, lanes, steps], "<u4")
    table = np.stack([np.array(sums, np.int64), counts, literals]).astype("<u4")
    return head.tobytes() + table.tobytes() + code[used].tobytes() + padded.reshape(lanes, steps)[literal.T].astype("<u2").tobytes()


def decode(packed: bytes) -> np.ndarray:
    """The ids of encode(); a block that doesn't match its checksum raises an error."""
    n, lanes, steps = (int(v) for v in np.frombuffer(packed, "<u4", 3))
    sums, counts, literals = np.frombuffer(packed, "<u4", 3 * lanes, 12).reshape(3, lanes).astype(np.int64)
    at = 12 + 12 * lanes
    code = np.frombuffer(packed, "<u2", int(counts.sum()), at)
    rest = np.append(np.frombuffer(packed, "<u2", int(literals.sum()), at + 2 * len(code)), np.uint16(0))
    high = int(counts.max()) + 1
    digits = np.zeros((lanes, high), np.uint64)
    digits[np.arange(high) < counts[:, None]] = code
    digits = np.ascontiguousarray(digits.T).ravel()
    lane, model = np.arange(lanes, dtype=np.int64), _Model(lanes)
    window = digits[lane] << _32 | digits[lane + lanes] << _16 | digits[lane + 2 * lanes]
    span, place, last = np.full(lanes, int(_LOW), np.uint64), lane + 3 * lanes, (high - 1) * lanes + lane
    next_literal = np.concatenate([[0], np.cumsum(literals)[:-1]])
    rows = np.empty((steps, lanes), np.uint16)
    for t in range(steps):
        model.predict()
        part = span >> _S
        v = np.minimum((window.astype(np.float64) / part.astype(np.float64)).astype(np.int64), (1 << SCALE) - 1)
        in2, in1, in0 = v < model.width2, v < model.begin0, v < model.begin_literal
        slot = np.minimum(np.maximum(v - model.begin0, 0) // model.width0, SLOTS0 - 1)
        in_slot = model.id0.take(model.at0 + slot)
        fresh = rest.take(np.minimum(next_literal, len(rest) - 1))
        x = np.where(in2, model.p2, np.where(in1, model.p1, np.where(in0, in_slot, fresh)))
        next_literal += ~in0
        start = np.where(in2, 0, np.where(in1, model.width2, np.where(in0, model.begin0 + slot * model.width0, model.begin_literal)))
        width = np.where(in2, model.width2, np.where(in1, model.width1, np.where(in0, model.width0, (1 << SCALE) - model.begin_literal)))
        window = window - part * start.astype(np.uint64)
        span = part * width.astype(np.uint64)
        full = span < _NARROW
        window = np.where(full, window << _16 | digits.take(np.minimum(place, last)), window)
        span = np.where(full, span << _16, span)
        place += full * lanes
        rows[t] = x
        slot = _slot(x)
        model.learn(x, slot, model.id0.take(model.at0 + slot) == x)
    wide = np.ascontiguousarray(rows.T).astype("<u4")
    for k in range(lanes):
        if zlib.crc32(wide[k]) != sums[k]:
            raise ValueError(f"block {k} of {lanes} is damaged")
    return wide.ravel()[:n].astype(np.uint16)
