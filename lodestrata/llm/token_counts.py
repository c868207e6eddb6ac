"""Token counts with a digest cache: only distinct texts that the cache does not know are encoded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..session import scratch_path, ship_package, stored
from .batches import pieces, texts
from .bpe import encoder

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: counts of another version are never taken."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The content that decides the count. Where the vocabulary lower-cases and drops white space, ASCII texts without
    special strings are lower-cased and their white space is collapsed; every other text stands for itself."""
    if not _folds(path):
        return text
    plain = (F.octet_length(text) == F.length(text)) & ~text.contains("<|")
    return F.when(plain, F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " ")).otherwise(text)


def _folds(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    return _is_word_end(json.loads(Path(path).read_text()))


def _is_word_end(spec: dict) -> bool:
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") is not None


@lru_cache(4)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    spec = json.loads(Path(path).read_text())
    if _is_word_end(spec) or spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel":
        return lambda batch: encoder(path).count_batch(batch)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return lambda batch: [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops texts whose digest this task has passed on already, so that a hot text is sent once by each task."""
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for d in b.column("digest").to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(fresh))


#: Bits of the filter that tells tasks which texts they may encode at once: at most, and for each digest in it.
FILTER_BITS, BITS_EACH = 2**28, 32


def _keyed(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(id, text, normal, digest)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("normal", normalised(F.col("text"), tokenizer))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("normal"), 256)))


def _known(spark, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) that the cache holds; two runs at once may both append a digest: one count stays."""
    before = _stored(spark, cache)
    return None if before is None else before.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(tokenizer: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n = _counter(tokenizer)(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64()), pa.array([version] * b.num_rows)], CACHE.names)

    return run


class _Filter:
    """A set of digests as bits: what isn't in it certainly isn't in the set. At most FILTER_BITS long."""

    def __init__(self, digests: DataFrame, most: int):
        self.bits = 2**15
        while self.bits < min(FILTER_BITS, BITS_EACH * most):
            self.bits *= 2
        place = F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("bigint") % self.bits
        maps = digests.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        filled = np.zeros(self.bits // 8, np.uint8)
        for r in maps.toLocalIterator():  # 2**15 bits each, numbered from 1, and so are the bits
            filled[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)[: len(filled)]
        self.filled = digests.sparkSession.sparkContext.broadcast(filled)

    def holds(self, digests: list[bytes]) -> np.ndarray:
        filled = self.filled.value
        p = np.fromiter((int.from_bytes(d[:7], "big") for d in digests), np.int64, len(digests)) % self.bits
        return filled[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Encodes the distinct texts of docs that the cache has no count for, appends their counts, and returns how many
    these are.

    Digests are counted and joined with the cache's. A text that is missing and stands in one row only is encoded where
    it is read; a filter of bounded size tells tasks which texts may be repeated or known. Only those are shuffled, by
    digest, checked against the cache and encoded once.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    ship_package(spark)
    rows = _keyed(docs, tokenizer, id_col, text_col)
    known, counted = _known(spark, cache, version), rows.groupBy("digest").agg(F.count("*").alias("n"))
    counted = counted.withColumn("known", F.lit(False)) if known is None else counted.join(known.select("digest", F.lit(True).alias("k")), "digest", "left").select("digest", "n", F.col("k").isNotNull().alias("known"))
    counted = stored(counted, "digests")
    missing, held = counted.agg(F.count_if(~F.col("known")), F.count_if(F.col("known") | (F.col("n") > 1))).first()
    if not missing:
        return 0
    texts_ = rows.select("digest", F.col("normal").alias("text"))
    if not held:
        texts_.mapInArrow(_encoded(tokenizer, version), CACHE).write.mode("append").parquet(cache)
        return missing
    marked = _Filter(counted.where("known OR n > 1"), held)

    def picked(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marked.holds(b.column("digest").to_pylist()) == inside))

        return run

    shape = "digest binary, text string"
    texts_.mapInArrow(picked(False), shape).mapInArrow(_encoded(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    shared = texts_.mapInArrow(picked(True), shape).mapInArrow(_first_of_each, shape).repartition("digest").mapInArrow(_first_of_each, shape)
    shared = shared.join(counted.where("NOT known").select("digest"), "digest", "left_semi")
    shared.mapInArrow(_encoded(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    return missing


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    cache is the path of a table (digest, n_tokens, tokenizer) that outlives the call: counts found there are joined,
    the distinct misses are encoded and appended. Without a path a new table in the shared folder serves this call.
    n_bytes is the UTF-8 length of the text itself; over_limit is n_tokens > limit. Null and empty texts have 0 bytes
    and 0 tokens; a null id stays null; repeated rows give repeated rows, encoded once; other columns are not read; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token_counts")
    fill_cache(docs, tokenizer, cache, id_col, text_col)
    counts = _known(spark, cache, tokenizer_version(tokenizer))
    if counts is None:  # docs are empty, and so was the cache
        counts = spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    # a table of its own: both sides of the join are exchanges then, so adaptive execution can split a text of very many rows
    counts = stored(counts, "counts")
    keyed = _keyed(docs, tokenizer, id_col, text_col).select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, cache: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
