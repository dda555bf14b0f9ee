"""Suffix arrays by induced sorting for many short shards at once.

Every shard is an independent text. Numpy walks all shards in step: step t handles the t-th entry of each shard's
array, so the linear scans of induced sorting run over thousands of shards per operation instead of one symbol at a time.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def ragged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, in a row."""
    size = end - begin
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def agreeing(symbols: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of ``size`` (one at least) symbols from p and from q agree before the first that doesn't, by comparing them."""
    if not len(p):
        return np.zeros(0, np.int64)
    differ = symbols[ragged(p, p + size)] != symbols[ragged(q, q + size)]
    begins = np.append(0, np.cumsum(size)[:-1])
    place = np.where(differ, np.arange(len(differ)), len(differ))
    return np.minimum(np.minimum.reduceat(place, begins) - begins, size)


class PrefixHash:
    """Hashes of any stretches of one array of symbols, from running sums."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(symbols))[:-1], dtype=np.uint64))
        self.shift = _powers(_BASE_INVERSE, len(symbols))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.shift[begin]


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix arrays of all shards of ``text``, one after the other, as positions in ``text``.

    Shard k is text[starts[k]:starts[k + 1]]; it ends in a 0 that occurs nowhere else in it. Shards must come longest first."""
    n, sizes = len(text), np.diff(starts)
    shard = np.repeat(np.arange(len(sizes)), sizes)
    # 1. classify: a suffix is smaller (S) or larger (L) than the one after it
    turn = np.ones(n, np.int8)
    turn[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    turn[starts[1:] - 1] = 1
    follows = np.where(turn != 0, np.arange(n), n - 1)
    small = turn[np.minimum.accumulate(follows[::-1])[::-1]] > 0
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    leftmost[starts[:-1]] = sizes == 1  # a shard of one symbol still has its own reduced text
    sigma = np.maximum.reduceat(text, starts[:-1]).astype(np.int64) + 1
    base = np.append(0, np.cumsum(sigma))
    key = base[shard] + text
    ends = np.cumsum(np.bincount(key, minlength=base[-1]))
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # shards that still have a t-th entry

    def induce(order: np.ndarray) -> np.ndarray:
        """Sort all suffixes, given the leftmost smaller ones in some order."""
        out = np.full(n, -1, np.int64)
        k = key[order]
        by = np.argsort(k, kind="stable")
        k = k[by]
        group_end = np.searchsorted(k, k, side="right")
        out[ends[k] - (group_end - np.arange(len(k)))] = order[by]
        heads = np.append(0, ends[:-1])
        for t in range(sizes[0]):
            p = out[starts[: active[t]] + t]
            p = p[p > starts[: active[t]]] - 1
            p = p[~small[p]]
            k = key[p]
            at = heads[k]
            out[at] = p
            heads[k] = at + 1
        tails = ends.copy()
        for t in range(sizes[0]):
            p = out[starts[1 : active[t] + 1] - 1 - t]
            p = p[p > starts[: active[t]]] - 1
            p = p[small[p]]
            k = key[p]
            at = tails[k] - 1
            out[at] = p
            tails[k] = at
        return out

    places = np.flatnonzero(leftmost)
    # 2. sort and name the leftmost smaller substrings; equal names: sort the reduced texts the same way
    first = induce(places)
    first = first[leftmost[first]]
    until = np.append(places[1:], n - 1)
    until = np.minimum(until, starts[shard[places] + 1] - 1)
    stops = np.zeros(n, np.int64)
    stops[places] = until + 1
    size = stops[first] - first
    same = (size[1:] == size[:-1]) & (shard[first][1:] == shard[first][:-1])
    maybe = np.flatnonzero(same)
    same[maybe] = agreeing(text, first[maybe], first[maybe + 1], size[maybe]) == size[maybe]
    if not same.any():
        return induce(first)
    names = np.cumsum(np.append(0, ~same))
    counts = np.bincount(shard[places], minlength=len(sizes))
    begins = np.append(0, np.cumsum(counts))
    name_at = np.zeros(n, np.int64)
    name_at[first] = names - names[begins[shard[first]]]
    longest = np.argsort(-counts, kind="stable")
    moved = np.concatenate([np.arange(begins[s], begins[s + 1]) for s in longest]) if len(longest) > 1 else np.arange(len(places))
    lower = suffix_arrays(name_at[places][moved], np.append(0, np.cumsum(counts[longest])))
    back = np.argsort(np.repeat(longest, counts[longest]), kind="stable")  # each shard's part to where the shard stands
    return induce(places[moved[lower[back]]])


def common_prefixes(text: np.ndarray, starts: np.ndarray, array: np.ndarray, least: int, most: int) -> np.ndarray:
    """Permuted common prefixes: at each position, how much its suffix shares with the better of its two neighbours in the array, up to ``most``.

    In text order the common prefix with the suffix before falls by one from place to place, unless the letters to the
    left differ; only at those places it is worked out: by bisection on hashes, and where ``least`` or more is found by comparing the symbols."""
    n = len(text)
    hashes = PrefixHash(text)
    first = np.zeros(n, bool)
    first[starts[:-1]] = True
    end = np.repeat(starts[1:], np.diff(starts))
    before = np.full(n, -1, np.int64)  # the suffix before each in its shard's array
    before[array[1:]] = array[:-1]
    before[array[starts[:-1]]] = -1
    p = np.arange(n)
    has = before >= 0
    led = has & (p > 0)
    led[led] = (text[p[led] - 1] == text[np.maximum(before[led], 1) - 1]) & ~first[p[led]] & ~first[before[led]]
    p = np.flatnonzero(has & ~led)
    q = before[p]
    low, high = np.zeros(len(p), np.int64), np.minimum(end[p] - p, end[q] - q)
    full = int(high.max(initial=0))
    for _ in range(full.bit_length()):
        mid = (low + high + 1) // 2
        same = hashes.of(p, p + mid) == hashes.of(q, q + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    long = np.flatnonzero(low >= least)  # what decides is compared, whatever the hashes say
    low[long] = agreeing(text, p[long], q[long], low[long])
    known = np.zeros(n, np.int64)
    known[p] = low
    source = np.maximum.accumulate(np.where(led, 0, np.arange(n)))
    known = np.where(led, known[source] - (np.arange(n) - source), known)
    best = known.copy()
    follows = np.flatnonzero(has)
    best[before[follows]] = np.maximum(best[before[follows]], known[follows])  # each is before one other at most
    return np.minimum(best, most)

