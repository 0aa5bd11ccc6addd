"""A compressed FM-index over word numbers: a wavelet matrix of the Burrows-Wheeler transform, in packed bits."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1
        key = rank * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        h *= 2
        if h >= min(depth, len(text)) or rank[order[-1]] == len(text) - 1:
            return order


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts of patterns in a text whose suffixes differ within `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        last = text[suffix_array(text, depth) - 1]
        symbols = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels, self.zeros = [], []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (last >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.base = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after one more symbol to the left of each match."""
        both = self.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift


def repeated(segments: list[np.ndarray], least: int) -> list[list[tuple[int, int]]]:
    """Per segment, the stretches whose every run of `least` symbols occurs at two places of the segments or more.

    Each segment is searched backward from its end. Where the match [start, end) cannot be extended, what is in it
    is reported if it is long enough; a run that begins further left must end by start + least - 1.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    words, codes = np.unique(np.concatenate(segments), return_inverse=True)
    m = len(segments)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.empty(int(sizes.sum()) + m, np.int64)
    ends = starts + sizes
    text[ends] = np.arange(m)  # a separator of its own ends each segment
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes + m
    index = FMIndex(text, int(sizes.max()) + 2)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    who = np.flatnonzero(sizes >= least)
    end = sizes[who]
    at, low, high = end.copy(), np.zeros(len(who), np.int64), np.full(len(who), index.n)
    while len(who):
        new_low, new_high = index.extend(text[starts[who] + at - 1], low, high)
        more = new_high - new_low >= 2
        at = at - more
        low, high = np.where(more, new_low, low), np.where(more, new_high, high)
        stop = ~more | (at == 0)
        for i in np.flatnonzero(stop & (end - at >= least)).tolist():
            out[who[i]].append((int(at[i]), int(end[i])))
        end = np.where(stop, np.where(at == 0, 0, np.minimum(end - 1, at + least - 1)), end)
        at = np.where(stop, end, at)
        low, high = np.where(stop, 0, low), np.where(stop, index.n, high)
        go = end >= least
        who, end, at, low, high = who[go], end[go], at[go], low[go], high[go]
    return out
