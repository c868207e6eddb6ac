"""Phrase collocations from position bitmaps: words that stand together more often than their parts explain.

Texts, with A-Z in lower case, fall into pieces at punctuation and line ends, and pieces into words; everything is counted
for each language. Each task packs its texts into shards of some two million positions, with a hole between pieces. In a
shard a word's bitmap is the list of its non-empty blocks of 32 positions. Shifting a phrase's bitmap by one position and
ANDing it with the words' bitmaps gives the bitmaps of all phrases one word longer; their popcounts, summed over shards,
are the frequencies. Holes are in no bitmap, so phrases end at them.

What is frequent is known only over all shards, so shards meet over their words and then over their pairs: each deals
them out to buckets in packed form, and the buckets answer each shard with those of its own that are frequent. With the
frequent pairs a shard goes depth-first to phrases of five words, whose counts meet in buckets again. No list of words or phrases goes through the
driver or to all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stored, ship_package, stored
from .batches import pieces
from .shingles import mix

LEAST, LONGEST, TOP = 100, 5, 2000
#: Positions after which a task begins another shard, and block meetings that one step of a search looks at.
SHARD, STEP = 2_000_000, 4_000_000
#: Bytes of the documents table for each bucket of words and pairs, where there are not more shuffle partitions.
BUCKET_BYTES = 32 << 20
BLOCK = 32
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
ENDS = tuple(bytes([c]) for c in b".,;:!?\n\x0b\x0c\r")

SHARDS = "shard bigint, bucket int, langs array<string>, sizes binary, words binary, places binary, counts binary, tokens binary"


# ---- shards ----


class _Shard:
    """Positions of many texts: a number for each word of each language, 0 between pieces."""

    def __init__(self):
        self.parts, self.size, self.next, self.words = [], 0, count(1), {}

    def add(self, lang: str, text: bytes) -> None:
        words = self.words.get(lang)
        if words is None:
            words = self.words[lang] = defaultdict(self.next.__next__)
            words.update(dict.fromkeys(ENDS, 0))
        found = TOKEN.findall(text.lower())  # bytes: A-Z alone
        self.parts += [np.fromiter(map(words.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
        self.size += len(found) + 1

    def rows(self, shard: int, buckets: int) -> pa.RecordBatch:
        """The shard's words with their local numbers and counts, packed for each bucket of words, and its tokens. Words
        are joined by spaces, which none of them holds."""
        tokens = np.concatenate(self.parts)
        counts = np.bincount(tokens, minlength=next(self.next))
        out: list[dict] = [{"shard": shard, "tokens": _packed(tokens)}]
        held: dict[int, list[tuple[str, list[bytes], np.ndarray]]] = {}
        for lang, words in self.words.items():
            names, places = zip(*words.items(), strict=True)
            names, places, seed = np.array(names, object), np.array(places), zlib.crc32(lang.encode())
            names, places = names[places > 0], places[places > 0]
            bucket = np.fromiter((zlib.crc32(w, seed) % buckets for w in names), np.int64, len(names))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                held.setdefault(k, []).append((lang, names[own].tolist(), places[own]))
        for k, parts in held.items():
            places = np.concatenate([p for *_, p in parts])
            out.append({
                "shard": shard, "bucket": k, "langs": [lang for lang, *_ in parts], "sizes": _packed(np.array([len(p) for *_, p in parts])), "words": zstandard.compress(b" ".join(w for _, own, _ in parts for w in own), 1),
                "places": _packed(places), "counts": _packed(counts[places]),
            })
        binary = [pa.field(c, pa.binary()) for c in ("sizes", "words", "places", "counts", "tokens")]
        return pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("langs", pa.list_(pa.string())), *binary]))


def _shards(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, made = TaskContext.get().partitionId() << 32, _Shard(), 0
        for b in pieces(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                shard.add(lang, text)
                if shard.size >= size:
                    yield shard.rows(first + made, buckets)
                    shard, made = _Shard(), made + 1
        if shard.size:
            yield shard.rows(first + made, buckets)

    return run


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


NAMED = "shard bigint, places binary, ids binary, lang string, n bigint, words array<string>, f array<bigint>, numbers array<bigint>"


def _named(least: int, buckets: int):
    """Sums the counts of a bucket's words over all shards. Frequent ones get numbers that no other bucket gives; each
    shard is told those that it holds. For each language: how many words there are, and the frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        bucket, index, messages = table.column("bucket")[0].as_py(), {}, []
        for row in table.to_pylist():
            words, at, where = zstandard.decompress(row["words"]).split(b" "), 0, []
            for lang, n in zip(row["langs"], _unpacked(row["sizes"], np.int64).tolist(), strict=True):
                own = index.setdefault(lang, {})
                where.append(np.fromiter((own.setdefault(w, (len(own), lang))[0] for w in words[at : at + n]), np.int64, n))
                at += n
            messages.append((row["shard"], row["langs"], where, _unpacked(row["places"], np.int64), _unpacked(row["counts"], np.int64)))
        sums = {lang: np.zeros(len(own), np.int64) for lang, own in index.items()}
        for _, langs, where, _, counts in messages:
            at = 0
            for lang, own in zip(langs, where, strict=True):
                np.add.at(sums[lang], own, counts[at : at + len(own)])
                at += len(own)
        rows, ids, given = [], {}, 0
        for lang in sorted(index):
            names, ids[lang] = list(index[lang]), np.zeros(len(index[lang]), np.int64)
            frequent = sorted(np.flatnonzero(sums[lang] >= least).tolist(), key=names.__getitem__)
            ids[lang][frequent] = 1 + bucket + buckets * np.arange(given, given + len(frequent))
            given += len(frequent)
            rows.append({"lang": lang, "n": int(sums[lang].sum()), "words": [names[k].decode() for k in frequent], "f": sums[lang][frequent].tolist(), "numbers": ids[lang][frequent].tolist()})
        if 1 + bucket + buckets * given >= 2**31:
            raise ValueError("a bucket has too many frequent words for 31-bit numbers")
        for shard, langs, where, places, _ in messages:
            own = np.concatenate([ids[lang][w] for lang, w in zip(langs, where, strict=True)])
            if own.any():
                rows.append({"shard": shard, "places": _packed(places[own > 0]), "ids": _packed(own[own > 0])})
        lists = [pa.field("words", pa.list_(pa.string())), pa.field("f", pa.list_(pa.int64())), pa.field("numbers", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("lang", pa.string()), ("n", pa.int64()), *lists]))

    return run


# ---- bitmaps ----


class _Bitmaps:
    """The bitmaps of a shard's words, ordered by block: an entry is (block, word, bits)."""

    def __init__(self, tokens: np.ndarray):
        at = np.flatnonzero(tokens)
        self.width = int(tokens.max(initial=0)) + 1
        key = (at // BLOCK) * self.width + tokens[at]
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.uint32(1) << (at[order] % BLOCK).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else np.empty(0, np.uint32)
        self.block, self.word = key[starts] // self.width, (key[starts] % self.width).astype(np.int64)
        self.first = np.searchsorted(self.block, np.arange(len(tokens) // BLOCK + 3))

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The words' own bitmaps, in batches of words: (paths, node, block, bits)."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        cost = np.cumsum(self.first[self.block[order] + 1] - self.first[self.block[order]])
        begin = 0
        while begin < len(word):
            end = int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + STEP, side="right"))
            end = int(np.searchsorted(word, word[max(end, begin + 1) - 1], side="right"))  # whole words
            own = order[begin:end]
            names, node = np.unique(word[begin:end], return_inverse=True)
            yield names[:, None], node, self.block[own], self.bits[own]
            begin = end

    def extend(self, paths, node, block, bits, pairs: np.ndarray | None):
        """All phrases one word longer, with their popcounts: (paths, node, block, bits, counts). pairs are the sorted
        numbers (word * width + next word) of those that may follow each other; None is all."""
        over = bits >> np.uint32(BLOCK - 1) != 0
        bits = np.r_[bits << np.uint32(1), np.ones(over.sum(), np.uint32)]
        node, block = np.r_[node, node[over]], np.r_[block, block[over] + 1]
        meets = self.first[block + 1] - self.first[block]
        row = np.repeat(np.arange(len(block)), meets)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(meets) - meets - self.first[block], meets)
        both = bits[row] & self.bits[entry]
        hit = np.flatnonzero(both)
        both, row, word = both[hit], row[hit], self.word[entry[hit]]
        if pairs is not None:
            ok = _among(paths[node[row], -1] * self.width + word, pairs)
            both, row, word = both[ok], row[ok], word[ok]
        if not len(row):
            return np.empty((0, paths.shape[1] + 1), np.int64), row, row, both, row
        key = node[row] * self.width + word
        order = np.argsort(key, kind="stable")
        key, both, row = key[order], both[order], row[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(fresh)
        counts = np.add.reduceat(np.bitwise_count(both).astype(np.int64), starts)
        longer = np.c_[paths[key[starts] // self.width], key[starts] % self.width]
        return longer, np.cumsum(fresh) - 1, block[row], both, counts


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _compact(tokens: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens numbered from 1 in the order of wanted (sorted, distinct), all others 0; and the numbers' old ones."""
    new = np.zeros(max(int(tokens.max(initial=0)), int(wanted.max(initial=0))) + 1, np.int32)
    new[wanted] = np.arange(1, len(wanted) + 1)
    return new[tokens], np.r_[0, wanted]


def _ascending(raw: bytes) -> np.ndarray:
    """Ascending numbers, packed as their differences."""
    return np.cumsum(_unpacked(raw, np.int64))


def _differences(numbers: np.ndarray) -> bytes:
    return _packed(np.diff(numbers, prepend=0))


PAIRS = "shard bigint, bucket int, keys binary, counts binary, tokens binary"


def _pairs(buckets: int):
    """Pairs of frequent words in a shard: their keys (first id above, second below 32 bits) and counts, packed for each
    bucket of keys; and the shard's tokens as global ids, 0 for what is not frequent."""

    def run(shards: pa.Table, words: pa.Table) -> pa.Table:
        out, rows = [], []
        if shards.num_rows:
            shard, tokens = shards.column("shard")[0].as_py(), _unpacked(shards.column("tokens")[0].as_py(), np.int32)
            local, known = (np.concatenate([np.empty(0, np.int64), *(_unpacked(x, np.int64) for x in words.column(c).to_pylist())]) for c in ("places", "ids"))
            order = np.argsort(local)
            tokens, ids = _compact(tokens, local[order])[0], np.r_[0, known[order]]
            maps = _Bitmaps(tokens)
            for root in maps.roots():
                paths, *_, counts = maps.extend(*root, None)
                out.append((ids[paths[:, 0]] << 32 | ids[paths[:, 1]], counts))
            keys, counts = (np.concatenate(p) for p in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 2
            bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((keys, bucket))
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                rows.append({"shard": shard, "bucket": k, "keys": _differences(keys[own]), "counts": _packed(counts[own].astype(np.int32))})
            rows.append({"shard": shard, "tokens": _packed(ids[tokens].astype(np.int32))})
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "tokens"))]))

    return run


KNOWN = "shard bigint, keys binary, frequent array<bigint>, f array<bigint>"


def _summed(least: int):
    """Sums the counts of a bucket's keys over all shards: the frequent ones with their sums, and for each shard those
    that it holds."""

    def run(table: pa.Table) -> pa.Table:
        keys = [_ascending(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        fresh = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
        sums, distinct = np.add.reduceat(counts[order], fresh), every[order][fresh]
        known, sums = distinct[sums >= least], sums[sums >= least]
        rows: list[dict] = [{"frequent": known.tolist(), "f": sums.tolist()}]
        for shard, own in zip(table.column("shard").to_pylist(), keys, strict=True):
            held = own[_among(own, known)]
            if len(held):
                rows.append({"shard": shard, "keys": _differences(held)})
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("frequent", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))]))

    return run


LONGER = "bucket int, phrases binary, counts binary"


def _phrases(longest: int, buckets: int):
    def run(shards: pa.Table, pairs: pa.Table) -> pa.Table:
        """Phrases of three words and more in a shard, along frequent pairs, and their counts, packed for each bucket of
        phrases. A phrase is a row of ids, 0 where it has no more words."""
        found, counts, rows = [np.empty((0, longest), np.int32)], [np.empty(0, np.int32)], []
        if shards.num_rows and pairs.num_rows:
            known = np.concatenate([_ascending(x) for x in pairs.column("keys").to_pylist()])
            first, second = known >> 32, known & 0xFFFFFFFF
            ids = np.unique(np.r_[first, second])
            every = _unpacked(shards.column("tokens")[0].as_py(), np.int32)
            at = np.minimum(np.searchsorted(ids, every), len(ids) - 1)
            maps = _Bitmaps(np.where(ids[at] == every, at + 1, 0).astype(np.int32))
            known = np.sort((np.searchsorted(ids, first) + 1) * maps.width + np.searchsorted(ids, second) + 1)
            ids = np.r_[0, ids].astype(np.int32)
            for nodes in maps.roots():
                for words in range(2, longest + 1):
                    *nodes, c = maps.extend(*nodes, known)
                    if not len(c):
                        break
                    if words > 2:
                        found.append(np.pad(ids[nodes[0]], ((0, 0), (0, longest - words))))
                        counts.append(c.astype(np.int32))
        found, counts = np.concatenate(found), np.concatenate(counts)
        number = np.zeros(len(found), np.uint64)
        for k in range(longest):
            number = mix(number ^ found[:, k].astype(np.uint64))
        bucket = (number % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((*found.T[::-1], bucket))
        found, counts, bucket = found[order], counts[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[k], edges[k + 1])
            rows.append({"bucket": k, "phrases": _packed(found[own].T), "counts": _packed(counts[own])})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())]))

    return run


def _summed_phrases(least: int, longest: int):
    """Sums the counts of a bucket's phrases over all shards; the frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        found = np.concatenate([_unpacked(x, np.int32).reshape(longest, -1).T for x in table.column("phrases").to_pylist()])
        counts = np.concatenate([_unpacked(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.lexsort(found.T[::-1])
        found, counts = found[order], counts[order]
        fresh = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]).any(1)])
        sums, found = np.add.reduceat(counts, fresh), found[fresh]
        keep = sums >= least
        return pa.Table.from_pylist([{"phrases": [[w for w in p if w] for p in found[keep].tolist()], "f": sums[keep].tolist()}], pa.schema([("phrases", pa.list_(pa.list_(pa.int64()))), ("f", pa.list_(pa.int64()))]))

    return run


# ---- the corpus ----


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, found): (lang, n) for each language with words; (lang, word, f, id) for each word that occurs
    least times or more in its language; (phrase, f) for each run of 1 to ``longest`` such words inside a piece that
    occurs least times or more, a phrase being the array of its words' ids.

    A null text is empty, a null language ``und``; repeated rows count each; a very long text is a shard of its own; other
    columns are not read; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 2**60 else 2_000 * rows.count()  # unknown for tables made by hand
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    shards = stored(rows.mapInArrow(_shards(shard, buckets), SHARDS), "phrase_shards")
    named = stored(shards.where("bucket IS NOT NULL").drop("tokens").groupBy("bucket").applyInArrow(_named(least, buckets), NAMED), "named_words")
    totals = stored(named.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "word_totals")
    words = named.where("lang IS NOT NULL").select("lang", F.explode(F.arrays_zip("words", "f", "numbers")).alias("w")).select("lang", F.col("w.words").alias("word"), "w.f", F.col("w.numbers").alias("id"))

    tokens, told = shards.where("tokens IS NOT NULL").select("shard", "tokens"), named.where("shard IS NOT NULL").select("shard", "places", "ids")
    pairs = stored(tokens.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_pairs(buckets), PAIRS), "pairs")
    drop_stored(shards)
    summed = stored(pairs.where("bucket IS NOT NULL").select("bucket", "shard", "keys", "counts").groupBy("bucket").applyInArrow(_summed(least), KNOWN), "frequent_pairs")
    known = summed.where("shard IS NULL").select(F.explode(F.arrays_zip("frequent", "f")).alias("x")).select(F.shiftright("x.frequent", 32).alias("a"), F.col("x.frequent").bitwiseAND(F.lit(2**32 - 1)).alias("b"), "x.f")
    tokens, held = pairs.where("tokens IS NOT NULL").select("shard", "tokens"), summed.where("shard IS NOT NULL").select("shard", "keys")
    packed = tokens.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_phrases(longest, buckets), LONGER)
    longer = packed.groupBy("bucket").applyInArrow(_summed_phrases(least, longest), "phrases array<array<bigint>>, f array<bigint>")
    found = words.select(F.array("id").alias("phrase"), "f").union(known.select(F.array("a", "b"), "f"))
    if longest > 2:
        found = found.union(longer.select(F.explode(F.arrays_zip("phrases", "f")).alias("p")).select("p.phrases", "p.f"))
    return totals, words, stored(found, "frequent_phrases")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly: products have at most 38 digits while a corpus has fewer than 10**17 words."""
    long, half = "decimal(38,0)", "decimal(19,0)"
    top = (F.lit(1000) * a).cast(half).cast(long) * n.cast(half)
    return F.call_function("div", top.cast(long), (left.cast(half) * right.cast(half)).cast(long))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard: int = SHARD, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, then a, both
    descending, then the phrase in byte order.

    A candidate is a phrase of 2 to ``longest`` words that occurs a >= least times. Cutting it after its first words
    gives the frequencies l and r of both parts and floor(1000 * a * n / (l * r)); the cut with the lowest score counts,
    the earlier one of equals. A candidate inside a longer one of the same frequency is dropped. Untidy tables: phrases().
    """
    totals, words, found = phrases(docs, least, longest, shard, lang_col, text_col)
    part = found.select(F.col("phrase").alias("part"), F.col("f").alias("pf"))
    several = found.where(F.size("phrase") > 1)
    # a phrase of the same frequency one word longer is enough: frequencies fall with the length
    inside = F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)")))
    inner = several.where(F.size("phrase") > 2).select(inside.alias("phrase"), "f").distinct()
    open_ = several.join(inner, ["phrase", "f"], "left_anti")
    cuts = open_.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.expr("slice(phrase, 1, k)")).join(part.withColumnRenamed("pf", "l"), "part")
    cuts = cuts.withColumn("part", F.expr("slice(phrase, k + 1, size(phrase) - k)")).join(part.withColumnRenamed("pf", "r"), "part")
    first = words.select(F.col("id"), "lang")
    cuts = cuts.withColumn("id", F.col("phrase")[0]).join(first, "id").join(totals, "lang").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = stored(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "best_phrases")  # with all ties
    spelled = kept.select("lang", "phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text"))
    ranked = kept.join(spelled, ["lang", "phrase"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
