"""BPE encoding and decoding in numpy, for the byte-level and the word-end vocabularies of tokenizer JSON files.

Two layers, both vectorised over many documents at once:

* ``split_words`` cuts one flat array of characters into the tokenizer's pre-tokens and hashes each of them;
* ``MergeTable`` merges the symbols of many words in one flat array, round by round: in each round every word's
  lowest-rank pair is found by binary search over sorted pair keys, and all its occurrences are merged.

``Encoder`` joins them with a bounded cache of known words. A text outside Latin-1 is cut by the tokenizers library's
own pre-tokenizer, so that its words are exact whatever the script; everything after that is the same.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, SEP = range(5)
#: Longer words are hashed by blake2b instead of by the table of random numbers.
LONG_WORD = 32
NO_RANK = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


def latin_classes() -> np.ndarray:
    """Class of each Latin-1 code, as the splitting patterns see it."""
    out = np.full(256, OTHER, np.uint8)
    for code in range(256):
        kind = unicodedata.category(chr(code))[0]
        if code in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            out[code] = SPACE
        elif kind in "LN":
            out[code] = LETTER if kind == "L" else NUMBER
    return out


CLASSES = latin_classes()
LOWER = np.array([ord(c) if len(c := chr(b).lower()) == 1 and ord(c) < 256 else b for b in range(256)], np.uint8)
HASHES = np.random.default_rng(20240229).integers(0, 2**64, (LONG_WORD + 1) * 256, np.uint64)


class MergeTable:
    """The merges of one vocabulary; ``encode`` takes words as bytes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        by_rank = np.empty(len(order), np.int64)
        by_rank[self.ranks] = self.made
        self.by_rank = by_rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each word. Words are not empty."""
        n = len(words)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.inner[raw], np.cumsum(lengths) - 1
        sym[last] = self.final[raw[last]]
        word = np.repeat(np.arange(n), lengths)
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[last] = NO_RANK
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            live = best < NO_RANK
            if not live.all():
                keep = np.repeat(live, count)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, best, count = sym[keep], word[keep], rank[keep], best[live], count[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, count)
            at = np.flatnonzero(hit)
            touching = np.flatnonzero(np.diff(at) == 1)
            if len(touching):  # a run such as "aaa": every second pair of it
                run = np.cumsum(np.r_[True, np.diff(at) != 1])
                start = np.flatnonzero(np.r_[True, np.diff(run) != 0])
                at = at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]
            sym[at] = self.by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            ends = (at + 2 >= len(word)) | (word[np.minimum(at + 2, len(word) - 1)] != word[at])
            place = np.cumsum(keep) - 1
            sym, word, rank, at = sym[keep], word[keep], rank[keep], place[at]
            rank[at] = NO_RANK
            more = at[~ends]
            rank[more] = self.rank(sym[more], sym[more + 1])
            before = at[at > 0]
            before = before[word[before - 1] == word[before]]
            rank[before - 1] = self.rank(sym[before - 1], sym[before])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=n)


def split_words(codes: np.ndarray, seps: np.ndarray, by_byte: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in codes. seps: where documents end; a separator is in codes there."""
    cls = CLASSES[codes]
    cls[seps] = SEP
    fresh = np.empty(len(cls), bool)
    fresh[0] = True
    np.not_equal(cls[1:], cls[:-1], out=fresh[1:])
    fresh[seps] = True
    if not by_byte:
        fresh |= cls == NUMBER
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(cls))
    kinds = cls[starts]
    quote = np.flatnonzero((kinds[:-1] == OTHER) & (codes[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (kinds[1:] == LETTER))
    if by_byte:
        before = np.maximum(starts[quote] - 1, 0)
        quote = quote[(starts[quote] == 0) | (codes[before] != 32) | (cls[before] == SEP)]
    if len(quote):
        after = ends[quote]
        one, two = codes[after], codes[np.minimum(after + 1, len(codes) - 1)]
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair & (ends[quote + 1] - starts[quote + 1] > 1), 2, 0))
        ends[quote] += taken
        starts[quote + 1] += taken
    if not by_byte:
        keep = (kinds != SPACE) & (kinds != SEP) & (starts < ends)
        return starts[keep], ends[keep]
    solid = (kinds == LETTER) | (kinds == NUMBER) | (kinds == OTHER)
    joins = np.flatnonzero(solid[1:] & (kinds[:-1] == SPACE) & (codes[starts[1:] - 1] == 32)) + 1
    starts[joins] -= 1
    ends[joins - 1] -= 1
    halves = np.flatnonzero((kinds[:-1] == SPACE) & solid[1:])
    halves = halves[(ends[halves] == starts[halves + 1]) & (ends[halves] - starts[halves] > 1)]
    halves = halves[~np.isin(halves + 1, joins)]
    extra = ends[halves] - 1
    ends[halves] -= 1
    keep = (kinds != SEP) & (starts < ends)
    starts, ends = np.append(starts[keep], extra), np.append(ends[keep], extra + 1)
    order = np.argsort(starts, kind="stable") if len(extra) else slice(None)
    return starts[order], ends[order]


def hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lo, hi = starts[0], ends[-1]
    following = np.append(starts[1:], hi)
    at = np.arange(lo, hi, dtype=np.int64)
    at -= np.repeat(starts, following - starts)
    gap = at >= np.repeat(ends - starts, following - starts)
    np.minimum(at, LONG_WORD, out=at)
    at <<= 8
    at += codes[lo:hi]
    values = HASHES[at]
    values[gap] = 0
    out = np.add.reduceat(values, starts - lo)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(codes[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Encoder:
    """Encodes whole texts as the tokenizers library does with ``add_special_tokens=False``, with a cache of words.

    Strings of special tokens inside texts become their ids, which is the library's default. max_words bounds the
    cache; when it is full it starts anew.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.by_byte = self.spec["normalizer"] is None
        self.table = MergeTable(self.spec)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"] if t["special"]}
        # the leftmost one, the longest of those that begin there
        self.special_in = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.max_words = max_words
        self.bytes_of = self._bytes_of() if self.by_byte else None
        self.forget()

    def forget(self) -> None:
        self.hash = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.offset = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        back = {c: b for b, c in enumerate(byte_chars())}
        parts = [b""] * (max(self.table.size, *self.special.values()) + 1 if self.special else self.table.size)
        for token, i in self.spec["model"]["vocab"].items():
            parts[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            parts[i] = token.encode()
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds unknown words; hashes are distinct and sorted."""
        ids, counts = self.table.encode(words)
        slots = len(self.count) + np.arange(len(words))
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.slot = np.insert(self.hash, at, hashes), np.insert(self.slot, at, slots)
        self.count = np.append(self.count, counts)
        self.offset = np.append(self.offset, self.offset[-1] + np.cumsum(counts))
        self.ids = np.append(self.ids, ids)

    def _slots(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place in the cache of each word, after learning those that are new."""
        known, first, inverse = np.unique(hash_words(codes, starts, ends), return_index=True, return_inverse=True)
        raw = codes.tobytes()

        def words(new: np.ndarray) -> list[bytes]:
            cut = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            return [w if w.isascii() else w.decode("latin-1").encode() for w in cut]

        return self._look_up(known, words)[inverse]

    def _look_up(self, hashes: np.ndarray, words) -> np.ndarray:
        if len(self.hash) > self.max_words:
            self.forget()
        at = np.searchsorted(self.hash, hashes)
        at[at == len(self.hash)] = 0
        new = np.flatnonzero(self.hash[at] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            self._learn(hashes[new], words(new))
            at = np.searchsorted(self.hash, hashes)
        return self.slot[at]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words of Latin-1 texts without special strings, and the number of words of each text."""
        if not texts:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        raw = "\0".join([*texts, ""]).encode("latin-1")
        codes = np.frombuffer(raw, np.uint8)
        seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        if not self.by_byte:
            codes = LOWER[codes]
        starts, ends = split_words(codes, seps, self.by_byte)
        if not len(starts):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        return self._slots(codes, starts, ends), np.bincount(np.searchsorted(seps, starts), minlength=len(texts))

    def _other(self, text: str) -> np.ndarray:
        """Slots of the words of any text without special strings."""
        if not self.by_byte:
            text = self.library.normalizer.normalize_str(text)
        back = _chars_to_bytes()
        words = [w.translate(back).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if not words:
            return np.empty(0, np.int64)
        # another hash than that of Latin-1 codes: these words are in UTF-8
        hashes = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8, person=b"utf8").digest(), "little") for w in words], np.uint64)
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return self._look_up(known, lambda new: [words[k] for k in first[new]])[inverse]

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        counts = self.count[slots]
        total = np.cumsum(counts)
        if not len(total):
            return np.empty(0, np.uint32)
        at = np.arange(total[-1]) + np.repeat(self.offset[slots] - (total - counts), counts)
        return self.ids[at]

    def is_plain(self, text: str) -> bool:
        """All Latin-1 (which for a str is how it is stored) and without "<|", in which special strings start."""
        return "<|" not in text and (text.isascii() or _latin(text))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        plain = [k for k, t in enumerate(texts) if self.is_plain(t)]
        slots, words = self._plain([texts[k] for k in plain]) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
        per_word = self.count[slots]
        ids = self._gather(slots)
        ends = np.cumsum(np.r_[0, per_word])[np.cumsum(np.r_[0, words])]
        if len(plain) == len(texts):
            return ids, np.diff(ends)
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for k, a, b in zip(plain, ends, ends[1:], strict=False):
            parts[k] = ids[a:b]
        for k in set(range(len(texts))) - set(plain):
            parts[k] = self._odd(texts[k])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _odd(self, text: str) -> np.ndarray:
        found = list(self.special_in.finditer(text)) if self.special_in else []
        cuts = [0, *(x for m in found for x in m.span()), len(text)]
        heads = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        plain = [head.isascii() or _latin(head) for head in heads]
        slots, words = self._plain([head for head, own in zip(heads, plain, strict=True) if own])  # all at once, there may be very many
        ends = np.cumsum(np.r_[0, self.count[slots]])[np.cumsum(np.r_[0, words])].tolist()
        ids, spans = self._gather(slots), iter(zip(ends, ends[1:], strict=False))
        out = []
        for k, (head, own) in enumerate(zip(heads, plain, strict=True)):
            if own:
                a, b = next(spans)
                out.append(ids[a:b])
            else:
                out.append(self._gather(self._other(head)))
            if k < len(found):
                out.append(np.array([self.special[found[k][0]]], np.uint32))
        return np.concatenate(out)

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return self.encode_batch(texts)[1]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the number of bytes of each id; special tokens as their text."""
        flat, offset = self.bytes_of
        lengths = offset[ids.astype(np.int64) + 1] - offset[ids]
        total = np.cumsum(lengths)
        if not len(total):
            return np.empty(0, np.uint8), lengths
        return flat[np.arange(total[-1]) + np.repeat(offset[ids] - (total - lengths), lengths)], lengths


@lru_cache(1)
def _chars_to_bytes() -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(byte_chars())}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its cache of words serves all tasks there."""
    return Encoder(path)
