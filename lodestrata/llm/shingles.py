"""Word shingles as 64-bit numbers, vectorised over many documents.

Words are runs of bytes other than white space (space and the codes 9 to 13) in UTF-8, with A-Z in lower case. Two
different shingles get the same number with a probability of about 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 24
_random = np.random.default_rng(5_120_903)
TABLE = _random.integers(0, 2**64, (LONG + 1) * 256, np.uint64)
FACTORS = _random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(documents: list[bytes], blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all documents, and the number of words of each document. blank says of each byte, in
    lower case, whether it stands between words; the space has to."""
    raw = np.frombuffer(b" ".join([b"", *documents, b""]), np.uint8)
    ends_at = np.cumsum(np.fromiter(map(len, documents), np.int64, len(documents)) + 1)
    raw = FOLD[raw]
    blank = blank[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(documents), np.int64)
    lo, hi = starts[0], ends[-1]
    at = np.arange(lo, hi, dtype=np.int64)
    at -= np.repeat(starts, np.append(starts[1:], hi) - starts)
    np.minimum(at, LONG, out=at)
    at <<= 8
    at += raw[lo:hi]
    values = TABLE[at]
    values[blank[lo:hi]] = 0
    out = np.add.reduceat(values, starts - lo)
    for k in np.flatnonzero(ends - starts > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(out), np.bincount(np.searchsorted(ends_at, starts), minlength=len(documents))


def shingle_sets(documents: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in ascending order, one document after the other, and the size of each set.

    A document with fewer words than ``width`` has its whole sequence as its one shingle; one without words has none.
    """
    words, count = word_numbers(documents)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(documents), np.int64)
    padded = np.append(words, np.zeros(width, np.uint64))
    sums = np.zeros(len(words), np.uint64)
    first = np.cumsum(count) - count
    left = np.repeat(first + count, count) - np.arange(len(words))  # words from here to the document's end
    for k in range(width):
        part = padded[k : k + len(words)] * FACTORS[k]
        part[left <= k] = FACTORS[32 + k]
        sums += part
    whole = np.repeat(count, count) < width
    keep = (left >= width) | whole & (left == np.repeat(count, count))
    sums, owner = mix(sums[keep]), np.repeat(np.arange(len(documents)), count)[keep]
    sizes = np.bincount(owner, minlength=len(documents))
    parts, at = [], np.cumsum(np.r_[0, sizes])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.sort(sums[a:b])
        parts.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def set_numbers(shingles: np.ndarray, sizes: np.ndarray, factor: int = 60) -> np.ndarray:
    """A signed 64-bit number for each set: equal sets have equal numbers, and n different sets meet with a probability
    of about n * n / 2**65. Numbers of different factors (60 to 63) are independent. Empty sets are 0."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(shingles ^ FACTORS[factor]), at) + sizes[full].astype(np.uint64))
    return out.view(np.int64)
