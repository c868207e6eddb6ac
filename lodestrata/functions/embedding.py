"""Embedders: text column in, vector column out. Vectors have unit length, so a cosine is a dot product."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import text as T


def l2_normalise(vec: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return T.let(norm, lambda n: F.transform(vec, lambda v: F.when(n == 0, v.cast("double")).otherwise(v.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of two vectors, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def features(text: Column, low: int = 3, high: int = 5) -> Column:
    """``w:token`` for each token and ``g:gram`` for each character n-gram of ``^token$``, repeats kept."""

    def grams(token: Column) -> Column:
        padded = F.concat(F.lit("^"), token, F.lit("$"))
        return F.concat(F.array(F.concat(F.lit("w:"), token)), T.let(padded, pieces))

    def pieces(padded: Column) -> Column:
        def of_size(n: int) -> Column:
            count = F.length(padded) - n + 1
            return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), lambda i: F.concat(F.lit("g:"), F.substring(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(of_size, range(low, high + 1)))

    return F.flatten(F.transform(T.tokens(F.lower(F.coalesce(text, F.lit("")))), grams))


class Embedder(ABC):
    """A backend. Vectors of different names must never be compared."""

    name: str
    dim: int

    @abstractmethod
    def embed(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        """df with the vector of column ``text`` as column ``out`` (array<float>)."""


class NativeHashingEmbedder(Embedder):
    """Signed feature hashing by md5, in the JVM: the features are exploded, counted and gathered as a sparse vector."""

    def __init__(self, dim: int = 768):
        self.dim, self.name = dim, f"hashing-md5-{dim}"

    def slot(self, feature: Column) -> Column:
        return (F.conv(F.substring(F.md5(feature), 1, 12), 16, 10).cast("bigint") % self.dim).cast("int")

    def sign(self, feature: Column) -> Column:
        return F.when(F.conv(F.substring(F.md5(feature), 13, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)

    def sparse(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, slot, weight) of unit length: one row for each non-zero slot. Sums meet map-side first."""
        f = df.select(key, F.explode(features(F.col(text))).alias("f"))
        sums = f.groupBy(key, self.slot(F.col("f")).alias("slot")).agg(F.sum(self.sign(F.col("f"))).alias("v")).where("v != 0")
        norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        return sums.join(norms, key).select(key, "slot", (F.col("v") / F.col("norm")).alias("weight"))

    def embed(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        # without a shuffle: each feature is hashed once, then each slot sums its own
        def sums(signed: Column) -> Column:
            slots = F.array_distinct(F.transform(signed, lambda x: x["s"]))
            return F.map_from_arrays(slots, F.transform(slots, lambda s: F.aggregate(F.filter(signed, lambda x: x["s"] == s), F.lit(0.0), lambda t, x: t + x["v"])))

        hashed = F.transform(features(F.col(text)), lambda x: F.struct(self.slot(x).alias("s"), self.sign(x).alias("v")))
        dense = T.let(T.let(hashed, sums), lambda m: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
        return df.withColumn(out, F.transform(T.let(dense, l2_normalise), lambda v: v.cast("float")))


_TOKEN = re.compile(r"[\wऀ-ॿ]+")


DIGESTS = {"blake2b": lambda x: hashlib.blake2b(x, digest_size=8).digest(), "md5": lambda x: hashlib.md5(x, usedforsecurity=False).digest()}
#: Tokens and runs of characters whose slots a Python worker keeps.
KEPT, KEPT_RUNS = 200_000, 400_000

_kept: dict[tuple, tuple[dict[str, tuple[int, ...]], dict[str, int]]] = {}


def _slots(tokens: list[str], dim: int, low: int, high: int, digest: str) -> list[tuple[int, ...]]:
    """For each token the slots that its features fall into, doubled, and one more where the sign is minus. Tokens share
    most of their runs of characters, so each new run is hashed once; all digests are taken apart together."""
    words, runs = _kept.setdefault((dim, low, high, digest), ({}, {}))
    if len(words) > KEPT:
        words.clear()
    if len(runs) > KEPT_RUNS:
        runs.clear()
    fresh, hashed, own = [t for t in tokens if t not in words], DIGESTS[digest], []
    for token in fresh:
        padded = f"^{token}$"
        own.append([padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1)])
    if fresh:
        new = list(dict.fromkeys(x for xs in own for x in xs if x not in runs))
        raw = [hashed(b"w:" + t.encode()) for t in fresh] + [hashed(b"g:" + x.encode()) for x in new]
        parts = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        slots = parts[:, :6].astype(np.int64) @ (1 << np.arange(40, -1, -8)) % dim
        codes = (2 * slots + (parts[:, 6] % 2 == 0)).tolist()
        runs.update(zip(new, codes[len(fresh) :], strict=True))
        words.update((t, (c, *map(runs.__getitem__, xs))) for t, c, xs in zip(fresh, codes[: len(fresh)], own, strict=True))
    return [words[t] for t in tokens]


def hashing_vectors(texts: list[str | None], dim: int = 768, low: int = 3, high: int = 5, digest: str = "blake2b") -> np.ndarray:
    """Signed feature hashing, a row of unit length (or zeros) for each text. The features of each distinct token are
    hashed once; the slots of all texts are summed by one bincount."""
    known: dict[str, int] = {}
    found = [[known.setdefault(t, len(known)) for t in _TOKEN.findall((x or "").lower())] for x in texts]
    if not known:
        return np.zeros((len(texts), dim))
    row, token = np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.fromiter((t for f in found for t in f), np.int64)
    pairs, times = np.unique(row * len(known) + token, return_counts=True)
    found = _slots(list(known), dim, low, high, digest)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    codes, first = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum()), np.cumsum(sizes) - sizes
    slots, signs = codes >> 1, 1.0 - 2 * (codes & 1)
    row, token = pairs // len(known), pairs % len(known)
    n = sizes[token]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[token], n)
    out = np.bincount(np.repeat(row, n) * dim + slots[at], signs[at] * np.repeat(times, n), len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def hashing_vector(text: str | None, dim: int = 768, low: int = 3, high: int = 5, digest: str = "blake2b") -> np.ndarray:
    return hashing_vectors([text], dim, low, high, digest)[0]


class HashingEmbedder(Embedder):
    """The default: feature hashing by blake2b (or md5), in Arrow batches with a cache of tokens."""

    #: Texts that are summed at once.
    ROWS = 128

    def __init__(self, dim: int = 768, low: int = 3, high: int = 5, digest: str = "blake2b"):
        self.dim, self.low, self.high, self.digest = dim, low, high, digest
        usual = (dim, low, high, digest) == (768, 3, 5, "blake2b")
        self.name = "hashing-ngram-v1" if usual else f"hashing-ngram-v1-{digest}-{dim}-{low}-{high}"

    def embed(self, df: DataFrame, text: str, out: str = "vec", kind: str = "float") -> DataFrame:
        ship_package(df.sparkSession)
        settings, rows, wide = (self.dim, self.low, self.high, self.digest), self.ROWS, np.float64 if kind == "double" else np.float32

        @F.arrow_udf(f"array<{kind}>")
        def run(column: pa.Array) -> pa.Array:
            texts = column.to_pylist()
            flat = np.concatenate([np.empty(0, wide), *(hashing_vectors(texts[k : k + rows], *settings).astype(wide).ravel() for k in range(0, len(texts), rows))])
            return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, settings[0], dtype=np.int32), pa.array(flat))

        return df.withColumn(out, run(F.col(text)))

    def vector(self, text: str) -> list[float]:
        """One text on the driver, in double precision, for a query."""
        return hashing_vector(text, self.dim, self.low, self.high, self.digest).tolist()


class ModelEmbedder(Embedder):
    """A local model, loaded once for each Python worker. load() returns a function from texts to vectors."""

    def __init__(self, name: str, dim: int, load):
        self.name, self.dim, self.load = name, dim, load

    def embed(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        load = self.load

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for b in batches:
                x = np.asarray(list(model([t or "" for t in b])), np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.Series(list(np.divide(x, norm, out=x, where=norm > 0).astype(np.float32)))

        return df.withColumn(out, run(F.col(text)))


MODEL = "paraphrase-multilingual-MiniLM-L12-v2"


def _fastembed(model: str = f"sentence-transformers/{MODEL}"):
    from fastembed import TextEmbedding

    return TextEmbedding(model_name=model).embed


def _sentence_transformers(model: str = MODEL):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model).encode


def get_embedder(prefer: str = "auto") -> Embedder:
    """auto and hashing: the default. native: md5 hashing in the JVM. fastembed and sentence-transformers: local models,
    only when asked for; they raise ImportError where their library is missing."""
    if prefer == "native":
        return NativeHashingEmbedder()
    if prefer in ("fastembed", "sentence-transformers"):
        load, short = (_fastembed, "fastembed") if prefer == "fastembed" else (_sentence_transformers, "st")
        dim = len(next(iter(load()(["probe"]))))
        return ModelEmbedder(f"{short}:{MODEL}", dim, load)
    return HashingEmbedder()


def query_vector(spark: SparkSession, embedder: Embedder, text: str) -> list[float]:
    """The vector of one query text."""
    if isinstance(embedder, HashingEmbedder):
        return embedder.vector(text)
    row = embedder.embed(spark.createDataFrame([(text,)], "t string"), "t").first()
    return [float(v) for v in row["vec"]]
