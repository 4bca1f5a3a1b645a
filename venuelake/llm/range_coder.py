"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed on their own.

Ids are mixed from three predictions: the id that last followed the two ids before (order 2), the id that last followed the
one before (order 1), and the ids' frequencies (order 0). Counts kept for each pair of confidences weigh the three anew with
every id; a range coder codes which of them is right, and an id that both guesses miss by its frequency. The frequencies are
those of the whole segment and stand in its header; all else starts afresh with each block, which needs no other block.

All blocks of a segment advance together, one id a step, so each step is a few array operations over the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block. A block starts with fresh counts and is decoded without any other.
BLOCK = 512
MAGIC = b"VLTK"
VERSION = 1
_HEAD = struct.Struct("<4sBxHQIII")  # magic, version, -, ids of a block, ids, blocks, bytes of the frequencies, their checksum
_ENTRY = np.dtype([("words", "<u4"), ("crc", "<u4")])
_BITS1, _BITS2, _SURE = 8, 9, 3
_ZERO_BITS = 18  # frequencies add up to this power of two
_MIX_STEP, _MIX_LIMIT = 24, 1 << 12
_TOP, _LOW32 = np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
_S16, _S32 = np.uint64(16), np.uint64(32)


class _Model:
    """State of all blocks: tables are flat and indexed by block first. A guess holds an id and, in its two low bits, how
    sure it is."""

    def __init__(self, lanes: int):
        self.guess1, self.guess2 = np.zeros(lanes << _BITS1, np.int32), np.zeros(lanes << _BITS2, np.int32)
        start = np.ones((3, 2, _SURE + 1, _SURE + 1), np.int32)
        for s2 in range(_SURE + 1):
            for s1 in range(_SURE + 1):
                start[:, :, s2, s1] = np.array([[1 + 40 * s2], [1 + 20 * s1], [60]])
        start[1, 1] = 1  # both guess the same id
        self.states = lanes * start[0].size
        self.mix = np.concatenate([np.tile(part.ravel(), lanes) for part in start])
        self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.at1, self.at2 = np.arange(lanes) << _BITS1, np.arange(lanes) << _BITS2
        self.at_mix = np.arange(lanes) * start[0].size

    def predict(self, n: int) -> tuple:
        """The guesses of the first n blocks and the counts of order 2, 1 and 0 being right."""
        a, b = self.prev1[:n], self.prev2[:n]
        mixed = a * 40503
        slot1 = self.at1[:n] + ((mixed >> 6) & ((1 << _BITS1) - 1))
        slot2 = self.at2[:n] + ((mixed + b * 60493 >> 5) & ((1 << _BITS2) - 1))
        held1, held2 = self.guess1.take(slot1), self.guess2.take(slot2)
        g1, g2 = held1 >> 2, held2 >> 2
        state = self.at_mix[:n] + ((((g1 == g2) << 4) | ((held2 & 3) << 2)) | (held1 & 3))
        counts = [self.mix.take(state + k * self.states) for k in range(3)]
        return slot1, slot2, held1, held2, g1, g2, state, counts

    def learn(self, n: int, ids: np.ndarray, which: np.ndarray, seen: tuple) -> None:
        slot1, slot2, held1, held2, g1, g2, state, counts = seen
        for slot, held, g, table in ((slot1, held1, g1, self.guess1), (slot2, held2, g2, self.guess2)):
            sure = held & 3
            missed = np.where(sure > 0, held - sure + (sure >> 1), ids << 2)
            table[slot] = np.where(g == ids, held + (sure < _SURE), missed)
        self.mix[which * self.states + state] += _MIX_STEP
        full = state[counts[0] + counts[1] + counts[2] > _MIX_LIMIT]
        if len(full):
            for k in range(3):
                self.mix[full + k * self.states] = (self.mix[full + k * self.states] + 1) >> 1
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their frequencies, at least 1 and together 2**18)."""
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    share = np.maximum(1, counts[known] * ((1 << _ZERO_BITS) - len(known)) // len(ids))
    share[counts[known].argmax()] += (1 << _ZERO_BITS) - share.sum()
    return known, share


def _pack(known: np.ndarray, share: np.ndarray) -> bytes:
    return zlib.compress(np.diff(known, prepend=0).astype("<u2").tobytes() + share.astype("<u4").tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = zlib.decompress(data)
    n = len(plain) // 6
    return np.cumsum(np.frombuffer(plain, "<u2", n).astype(np.int64)), np.frombuffer(plain, "<u4", n, 2 * n).astype(np.int64)


def _unit(width: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    return width >> np.uint64(_ZERO_BITS) if isinstance(total, int) else width // total.astype(np.uint64)


class _Writer:
    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
        self.words, self.used = np.zeros((ids + 16, lanes), np.uint32), np.zeros(lanes, np.int64)
        self.most = 0  # words that any block may have

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.ndarray | int) -> None:
        unit = _unit(self.range[lanes], total)
        low, width = self.low[lanes] + unit * start.astype(np.uint64), unit * size.astype(np.uint64)
        small = np.flatnonzero(width < _TOP)
        if len(small):
            self.most += 1
            if self.most + 4 >= len(self.words):
                self.most = int(self.used.max()) + 1
                if self.most + 4 >= len(self.words):
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            out = small if isinstance(lanes, slice) else lanes[small]
            used, carried = self.used[out], low[small]
            # a carry stays in the 17th bit of its word until the end
            self.words[used, out] = carried >> _S32
            self.used[out] = used + 1
            low[small] = (carried & _LOW32) << _S16
            width[small] <<= _S16
        self.low[lanes], self.range[lanes] = low, width

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(3):
            self.words[self.used, every] = self.low >> _S32
            self.used += 1
            self.low = (self.low & _LOW32) << _S16
        for k in range(int(self.used.max()) - 1, 0, -1):
            self.words[k - 1] += self.words[k] >> 16
        plain = np.ascontiguousarray(self.words.T.astype("<u2"))
        return [plain[i, : self.used[i]].tobytes() for i in every]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        sizes = [len(p) // 2 for p in payloads]
        words = np.zeros((len(payloads), max(sizes) + 1), np.uint16)
        for i, p in enumerate(payloads):
            words[i, : sizes[i]] = np.frombuffer(p, "<u2")
        self.words, self.used = np.ascontiguousarray(words.T), np.full(len(payloads), 3)
        self.ends = len(self.words) - 1
        self.range = np.full(len(payloads), (1 << 48) - 1, np.uint64)
        first = self.words[:3].astype(np.uint64)
        self.code = (first[0] << _S32) | (first[1] << _S16) | first[2]

    def peek(self, lanes: np.ndarray | slice, total: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(self.range[lanes], total)
        return unit, np.minimum((self.code[lanes] // unit).astype(np.int64), total - 1)

    def take(self, lanes: np.ndarray | slice, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code, width = self.code[lanes] - unit * start.astype(np.uint64), unit * size.astype(np.uint64)
        small = np.flatnonzero(width < _TOP)
        if len(small):
            out = small if isinstance(lanes, slice) else lanes[small]
            used = self.used[out]
            code[small] = (code[small] << _S16) | self.words[np.minimum(used, self.ends), out]
            width[small] <<= _S16
            self.used[out] = used + 1
        self.code[lanes], self.range[lanes] = code, width


def _lengths(n: int, block: int) -> np.ndarray:
    """Ids of each block: full ones, then the rest."""
    return np.minimum(block, n - np.arange(0, n, block))


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: header, a size and checksum for each block, and the blocks. Ids must be under 65,536."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("ids must lie between 0 and 65535")
    sizes = _lengths(len(ids), block)
    if not len(sizes):
        return _HEAD.pack(MAGIC, VERSION, block, 0, 0, 0, 0)
    known, share = _frequencies(ids)
    packed = _pack(known, share)
    before, place = np.cumsum(share) - share, np.zeros(1 << 16, np.int64)
    place[known] = np.arange(len(known))
    head = _HEAD.pack(MAGIC, VERSION, block, len(ids), len(sizes), len(packed), zlib.crc32(packed)) + packed
    lanes, table = len(sizes), np.zeros((len(sizes), sizes[0]), np.int32)
    table.ravel()[: len(ids)] = ids  # only the last block may be short
    columns = np.ascontiguousarray(table.T)
    model, out = _Model(lanes), _Writer(lanes, int(sizes[0]))
    for step in range(int(sizes[0])):
        n = lanes - int(step >= sizes[-1])
        now = columns[step, :n]
        seen = model.predict(n)
        g1, g2, (c2, c1, c0) = seen[4], seen[5], seen[7]
        second = now == g2
        which = np.where(second, 0, 2 - (now == g1))
        start = np.where(second, 0, np.where(which == 1, c2, c2 + c1))
        out.put(slice(0, n), start, np.where(second, c2, np.where(which == 1, c1, c0)), c2 + c1 + c0)
        miss = np.flatnonzero(which == 2)
        if len(miss):
            k = place[now[miss]]
            out.put(miss, before[k], share[k], 1 << _ZERO_BITS)
        model.learn(n, now, which, seen)
    payloads = out.close()
    entries = np.zeros(lanes, _ENTRY)
    entries["words"] = [len(p) // 2 for p in payloads]
    entries["crc"] = [zlib.crc32(table[i, : sizes[i]].astype("<u4").tobytes()) for i in range(lanes)]
    return b"".join([head, entries.tobytes(), *payloads])


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; a ValueError if its header or the checksum of any block does not hold."""
    if len(segment) < _HEAD.size:
        raise ValueError("truncated segment")
    magic, version, block, total, lanes, n_packed, packed_crc = _HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment of this version")
    sizes = _lengths(total, block) if total else np.zeros(0, np.int64)
    packed, at = segment[_HEAD.size : _HEAD.size + n_packed], _HEAD.size + n_packed
    if len(sizes) != lanes or zlib.crc32(packed) != packed_crc or len(segment) < at + lanes * _ENTRY.itemsize:
        raise ValueError("damaged header")
    if not lanes:
        return np.zeros(0, np.int64)
    known, share = _unpack(packed)
    before, at_slot = np.cumsum(share) - share, np.repeat(np.arange(len(known)), share)
    entries = np.frombuffer(segment, _ENTRY, lanes, at)
    ends = at + lanes * _ENTRY.itemsize + 2 * np.cumsum(entries["words"].astype(np.int64))
    if ends[-1] != len(segment):
        raise ValueError("truncated segment")
    starts = ends - 2 * entries["words"].astype(np.int64)
    model, source = _Model(lanes), _Reader([segment[a:b] for a, b in zip(starts, ends, strict=True)])
    columns = np.zeros((int(sizes[0]), lanes), np.int32)
    for step in range(int(sizes[0])):
        n = lanes - int(step >= sizes[-1])
        seen = model.predict(n)
        g1, g2, (c2, c1, c0) = seen[4], seen[5], seen[7]
        both = c2 + c1
        unit, value = source.peek(slice(0, n), both + c0)
        second = value < c2
        which = np.where(second, 0, 1 + (value >= both))
        start = np.where(second, 0, np.where(which == 1, c2, both))
        source.take(slice(0, n), unit, start, np.where(second, c2, np.where(which == 1, c1, c0)))
        now = np.where(second, g2, g1)
        miss = np.flatnonzero(which == 2)
        if len(miss):
            unit, value = source.peek(miss, 1 << _ZERO_BITS)
            k = at_slot[value]
            source.take(miss, unit, before[k], share[k])
            now[miss] = known[k]
        columns[step, :n] = now
        model.learn(n, now, which, seen)
    ids = np.ascontiguousarray(columns.T)
    for i in range(lanes):
        if zlib.crc32(ids[i, : sizes[i]].astype("<u4").tobytes()) != entries["crc"][i]:
            raise ValueError(f"block {i} is damaged")
    return ids.ravel()[:total].astype(np.int64)
