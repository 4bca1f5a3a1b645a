"""Repeated substrings of small collections by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _by(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys in ascending order, equal ones in order of place; for each but the first whether it equals the one
    before). Keys of `bits` bits carry their place below them where that fits in 64: values are sorted several times as fast
    as places are by their values."""
    low = len(key).bit_length()
    if bits + low <= 64:
        key = key << np.uint64(low)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << low) - 1)).view(np.int64)
        key >>= np.uint64(low)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, key[1:] == key[:-1]


def _ties(same: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each the slot of the first that equals it, whether another does)."""
    edge = np.zeros(1, bool)
    head = ~np.concatenate([edge, same])
    tied = np.concatenate([edge, same])
    tied[:-1] |= same
    return np.maximum.accumulate(np.where(head, slots, 0)), tied


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of each suffix. Symbol 0 ends a text, the last one too; each such end is a symbol of its own, in order of place.

    Prefix doubling over the suffixes that are still tied; a tie never reaches beyond an end, so rounds stop with the
    longest repeat of the collection.
    """
    n = len(symbols)
    bits = n.bit_length()
    present = np.bincount(symbols) > 0
    codes = (np.cumsum(present) - present[0]).astype(np.uint64)  # as few bits a symbol as tell those in use apart
    width = int(codes[-1]).bit_length() or 1
    reach = (64 - bits) // width
    coded = np.concatenate([codes[symbols], np.zeros(reach, np.uint64)])
    key = coded[:n].copy()
    for i in range(1, reach):
        key <<= np.uint64(width)
        key |= coded[i : i + n]
    ends = np.flatnonzero(symbols == 0)
    ahead = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    beyond = (np.maximum(reach - ahead, 0) * width).astype(np.uint64)
    key >>= beyond
    key <<= beyond
    order, same = _by(key, reach * width)
    same &= (ahead >= reach)[order[1:]]
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    first, tied = _ties(same, at)
    rank[order] = first
    left, at, first = order[tied], at[tied], first[tied]
    while len(left):
        key = first.astype(np.uint64)
        key <<= np.uint64(bits)
        key |= rank[left + reach].view(np.uint32)
        order, same = _by(key, 2 * bits)
        left = left[order]
        first, tied = _ties(same, at)
        rank[left] = first
        left, at, first = left[tied], at[tied], first[tied]
        reach *= 2
    return rank


def short_prefixes(symbols: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes by rank, for each the common prefix with the one before: its length if under `least`, else -1).

    Breadth-first backward extension: the intervals of all strings of one length are extended by each preceding symbol at
    once; where the end of a new interval has no value yet, the common prefix there is the present length, and only then
    is the interval carried on. Lengths rise by one a level, and the search stops at `least`. An interval is extended by
    the runs of the transform in it, not by its rows: a run's rows stay side by side, so texts that repeat cost little.
    """
    n = len(symbols)
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    back = rank[suffixes - 1]  # the suffix that is longer by its preceding symbol
    first = symbols[suffixes].astype(np.int32)
    first = np.where(first == 0, -1 - np.arange(n, dtype=np.int32), first)  # ends differ from one another
    before = first[back]  # the transform itself
    starts = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1, [n]])  # of its runs
    run_of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    found = np.full(n + 1, -1, np.int32)
    found[0] = found[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for length in range(least):
        if not len(low):
            break
        low_run, high_run = run_of[low], run_of[high]
        plain = low_run == high_run
        new_low, new_high = [back[low[plain]]], [back[high[plain]]]
        wide = np.flatnonzero(~plain)
        if len(wide):
            sizes = high_run[wide] - low_run[wide] + 1
            owner = np.repeat(wide, sizes)
            run = np.arange(len(owner)) + np.repeat(low_run[wide] - (np.cumsum(sizes) - sizes), sizes)
            to = back[np.maximum(starts[run], low[owner])]
            if len(to) * 16 > n:
                placed = np.full(n, -1, np.int32)
                placed[to] = np.arange(len(to), dtype=np.int32)
                to = np.flatnonzero(placed >= 0)
                by = placed[to]
            else:
                by, _ = _by(to.astype(np.uint64), n.bit_length())
                to = to[by]
            owner, symbol = owner[by], first[to]
            cut = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) + 1
            end = np.concatenate([cut - 1, [len(to) - 1]])
            new_low.append(to[np.concatenate([[0], cut])])
            new_high.append(back[np.minimum(starts[run[by[end]] + 1] - 1, high[owner[end]])])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        new = found[high + 1] < 0
        low, high = low[new], high[new]
        found[high + 1] = length
    return suffixes, found


def repeated_starts(texts: list[bytes], *least: int, rooms: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each length in `least`, and for each text, whether the string of that many bytes at each place starts anywhere
    else, in any text. Places are those where one fits, of the first `room` only where `rooms` are given, and strings that
    start beyond are no partners either."""
    symbols = np.zeros(sum(map(len, texts)) + len(texts), np.int16)
    open_places = np.zeros(len(symbols), bool)
    starts, at = [], 0
    for k, text in enumerate(texts):
        symbols[at : at + len(text)] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
        open_places[at : at + (len(text) if rooms is None else min(rooms[k], len(text)))] = True
        starts.append(at)
        at += len(text) + 1
    if not at:
        return [[] for _ in least]
    rank = suffix_ranks(symbols)
    suffixes, found = short_prefixes(symbols, rank, max(least))
    out = []
    for length in least:
        # suffixes whose neighbours share `length` bytes form a run; two open ones of a run repeat each other
        run = np.cumsum((found[:-1] >= 0) & (found[:-1] < length))
        mine = open_places[suffixes]
        repeated = np.zeros(at, bool)
        repeated[suffixes] = mine & (np.bincount(run, mine)[run] > 1)
        out.append([repeated[s : s + max(len(t) - length + 1, 0)] for s, t in zip(starts, texts, strict=True)])
    return out
