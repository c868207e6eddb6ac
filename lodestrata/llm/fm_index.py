"""An FM-index over the words of a shard of documents: suffix order, wavelet matrix, sampled suffix positions.

Words are symbols; each document ends with a separator, symbol 0. Separators differ from each other in the suffix order
(earlier ones are smaller), so no comparison goes beyond a document, and copies cost no more than their own length.
"""

from __future__ import annotations

import numpy as np

#: Every document's first word and each RATE-th after it have their position stored.
RATE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of text (0 is a separator, and its last symbol) by suffix, by prefix doubling of those still tied."""
    n, ends = len(text), np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + (len(ends) - 1)
    rank[ends] = np.arange(len(ends))
    width, h, key = int(rank.max(initial=0)) + 1, 1, rank
    padded = np.r_[rank, np.zeros(4, np.int64)]
    while h < 4 and width ** (h + 1) < 2**63:
        key = key * width + padded[h : h + n]
        h += 1
    order = np.argsort(key)
    slots, moved, key = np.arange(n), order, key[order]
    while True:
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        rank[moved] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))] if len(key) else slots
        tied = ~(fresh & np.r_[fresh[1:], True]) if len(key) else fresh
        slots, moved = slots[tied], moved[tied]
        if not len(slots):
            return order
        key = rank[moved] * n + rank[moved + h]
        again = np.argsort(key)
        moved, key = moved[again], key[again]
        order[slots] = moved
        h *= 2


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits in 64-bit words, with an empty word behind them."""
    out = np.zeros(len(bits) // 64 + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


class Bits:
    """A bit string with the number of ones before each position."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.cumsum(np.r_[0, np.bitwise_count(words[:-1])], dtype=np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class FMIndex:
    """Search and locate over a shard. ``fields`` are the arrays that a stored index consists of."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, sizes: np.ndarray, levels: np.ndarray, marks: np.ndarray, samples: np.ndarray):
        self.fields = {"vocabulary": vocabulary, "counts": counts, "sizes": sizes, "levels": levels, "marks": marks, "samples": samples}
        self.vocabulary, self.samples, self.marks = vocabulary, samples, Bits(marks)
        self.first = np.cumsum(np.r_[0, counts], dtype=np.int64)  # rows before each symbol's
        self.n = int(self.first[-1])
        self.starts = np.cumsum(np.r_[0, sizes + 1], dtype=np.int64)  # of documents in the text
        depth = max(1, int(len(counts) - 1).bit_length())
        self.levels = [Bits(x) for x in levels.reshape(depth, -1)]
        self.zeros = [self.n - int(x.ones(np.array([self.n]))[0]) for x in self.levels]
        symbols, turned = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for k in range(depth):
            turned |= (symbols >> k & 1) << (depth - 1 - k)
        order = np.argsort(turned)  # the matrix's last row has its symbols by reversed bits
        self.base = np.empty(len(counts), np.int64)
        self.base[order] = np.cumsum(counts[order]) - counts[order]

    @classmethod
    def build(cls, words: np.ndarray, sizes: np.ndarray) -> FMIndex:
        """words: a 64-bit number for each word of all documents; sizes: how many words each document has."""
        vocabulary, symbols = np.unique(words, return_inverse=True)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        offset = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)  # places of words in the text
        text = np.zeros(len(words) + len(sizes), np.int64)
        text[offset] = symbols + 1
        order = suffix_order(text)
        row = text[order - 1]
        counts = np.bincount(text, minlength=len(vocabulary) + 1)
        levels = []
        for k in reversed(range(max(1, len(vocabulary).bit_length()))):
            bit = (row >> k & 1).astype(bool)
            levels.append(_packed(bit))
            row = np.concatenate([row[~bit], row[bit]])
        sampled = np.zeros(len(text), bool)
        sampled[offset] = (offset - np.repeat(starts, sizes)) % RATE == 0
        marks = sampled[order]
        return cls(vocabulary, counts, sizes, np.concatenate(levels), _packed(marks), order[marks].astype(np.int32))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i of the transform."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = np.where(symbol >> (len(self.levels) - 1 - k) & 1, zeros + ones, i - ones)
        return i - self.base[symbol]

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        i, symbol = row, np.zeros(len(row), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = bits.at(i), bits.ones(i)
            i, symbol = np.where(bit, zeros + ones, i - ones), symbol << 1 | bit
        return self.first[symbol] + i - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: (phrase, from row, to row) of those that occur. phrases holds word
        numbers, each row from the left."""
        if not len(self.vocabulary) or not len(phrases):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        here = self.vocabulary[at] == phrases
        here |= np.arange(phrases.shape[1]) >= lengths[:, None]
        p = np.flatnonzero(here.all(1))
        symbols, left = at[p] + 1, lengths[p] - 1
        last = symbols[np.arange(len(p)), left]
        lo, hi, done = self.first[last], self.first[last + 1], []
        while len(p):
            whole = left == 0
            done.append((p[whole], lo[whole], hi[whole]))
            p, symbols, left, lo, hi = (x[~whole] for x in (p, symbols, left - 1, lo, hi))
            c = symbols[np.arange(len(p)), left]
            ends = self.first[np.r_[c, c]] + self.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = ends[: len(p)], ends[len(p) :]
            alive = lo < hi
            p, symbols, left, lo, hi = (x[alive] for x in (p, symbols, left, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 3

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of rows whose suffixes begin with a word: back to the nearest sampled one."""
        out, open_, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(open_):
            known = self.marks.at(row)
            out[open_[known]] = self.samples[self.marks.ones(row[known])] + steps
            open_, row, steps = open_[~known], self.before(row[~known]), steps + 1
        return out
