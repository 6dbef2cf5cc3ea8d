"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

# Words behind a mismatch that a probe takes along.
PROBE = 8


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols, by prefix doubling."""
    rank, length = codes.astype(np.int64), 1
    while True:
        follow = np.zeros(len(rank), dtype=np.int64)
        follow[: len(rank) - length] = rank[length:] + 1
        key = rank * (len(rank) + int(codes.max(initial=0)) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate(([False], np.diff(key[order]) != 0)))
        rank, length = new, 2 * length
        if length >= depth or rank.max(initial=0) == len(rank) - 1:
            return order


class WaveletMatrix:
    """Symbols below 2**levels as bit planes, 64 bits to a word, with running counts of ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        symbols = symbols.astype(np.int64)
        for level in reversed(range(levels)):
            bits = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros(-(-(len(bits) + 1) // 64) * 8, dtype=np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.int32)
            self.planes.append((words, before, int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position after all planes; the difference of two is a count of `symbol`."""
        for level, (words, before, zeros) in zip(reversed(range(len(self.planes))), self.planes):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            below = words[block] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = before[block] + np.bitwise_count(below)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Index of texts of word codes (from 1 on); every text counts `weight` times."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        # A separator, code 0, follows every text; no query contains it.
        self.codes = np.zeros(len(texts) + len(lengths), dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths + np.arange(len(lengths))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        self.codes[np.arange(len(texts)) + owner] = texts
        self.lengths = lengths
        order = suffix_order(self.codes, int(lengths.max(initial=1)) + 1)
        self.size = len(self.codes)
        each = np.repeat(weights, lengths + 1)
        self.weight = np.concatenate(([0], np.cumsum(each[order])))
        sigma = int(self.codes.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.codes, minlength=sigma))))[:sigma]
        self.bwt = WaveletMatrix(self.codes[order - 1], max(1, int(sigma - 1).bit_length()))
        symbols = np.arange(sigma)
        self.base = self.first - self.bwt.descend(symbols, np.zeros(sigma, dtype=np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Interval of suffixes that begin with `symbol` and go on as [low, high) do."""
        base = self.base[symbol]
        return base + self.bwt.descend(symbol, low), base + self.bwt.descend(symbol, high)

    def repeats(self, least: int) -> list[tuple[int, int, int]]:
        """Matching statistics of every indexed text: (text, from, to) of stretches of `least`
        words or more whose total weight in the index is above one; together they cover
        every repeated window of `least` words.

        Each text is streamed from its end: the match grows to the left by backward search. Where
        it ends before a word, windows without that word are done; a probe of that word
        and the `PROBE` words behind it often shows that no window with all of them can
        repeat, else the next window back is tried. All texts advance together.
        """
        found = []
        live = np.flatnonzero(self.lengths >= least)
        end = self.lengths[live].copy()
        at = end.copy()
        # Where a probe runs, `back` is the end to go on from when it finds a repeat, else -1.
        back = np.full(len(live), -1, dtype=np.int64)
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.size, dtype=np.int64)
        stop = np.zeros(len(live), dtype=np.int64)  # a probe ends here, a search at 0
        while len(live):
            new_low, new_high = self.extend(self.codes[self.starts[live] + at - 1], low, high)
            grows = self.weight[new_high] - self.weight[new_low] > 1
            at = np.where(grows, at - 1, at)
            low, high = np.where(grows, new_low, low), np.where(grows, new_high, high)
            probing = back >= 0
            done = grows & (at == stop)
            whole = done & ~probing
            report = (whole | (~grows & ~probing)) & (end - at >= least)
            found += zip(live[report].tolist(), at[report].tolist(), end[report].tolist())
            # A search that failed goes on with a probe, if that is shorter than the next search.
            following = np.minimum(end - 1, at + least - 1)
            short = at + PROBE
            probe = ~grows & ~probing & (short < following)
            plain = ~grows & ~probing & ~probe
            missed = ~grows & probing
            repeated = done & probing
            new_end = np.select([probe, plain, missed, repeated], [short, following, end - 1, back], end)
            restart = probe | plain | missed | repeated
            stop = np.where(probe, at - 1, np.where(restart, 0, stop))
            back = np.where(probe, following, np.where(restart, -1, back))
            end = new_end
            at = np.where(restart, end, at)
            low, high = np.where(restart, 0, low), np.where(restart, self.size, high)
            stay = ~whole & ((end >= least) | (back >= least))
            live, end, at, low, high = live[stay], end[stay], at[stay], low[stay], high[stay]
            stop, back = stop[stay], back[stay]
        return found
