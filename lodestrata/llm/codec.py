"""BPE encoding and decoding of whole texts by batched numpy merge rounds (see bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .batches import pieces, texts
from .bpe import encoder


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) for each row of docs.

    Null and empty texts give an empty array; a null id stays null; repeated rows give repeated rows; other columns are
    not read, whatever their names; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            ids, counts = encoder(tokenizer).encode_batch(texts(b.column("text")))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, ids.astype(np.int64))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of (id, ids); only for byte-level vocabularies. Null or empty ids give the empty text;
    bytes that are no UTF-8 are replaced as Python's "replace" does."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids in b.column("ids"):
                raw, _ = encoder(tokenizer).decode_bytes(np.array(ids.as_py() or [], np.uint32))
                out.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded text in UTF-8,
    both in lower-case hex. Null and empty texts have no tokens. Rows, ids and other columns as in ``encode``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            enc = encoder(tokenizer)
            ids, counts = enc.encode_batch(texts(b.column("text")))
            raw, lengths = enc.decode_bytes(ids)
            at = np.concatenate([[0], np.cumsum(counts)])
            to = np.concatenate([[0], np.cumsum(lengths)])[at]
            packed, raw = ids.astype("<u4").tobytes(), raw.tobytes()
            ids_sha = [hashlib.sha256(packed[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            text_sha = [hashlib.sha256(raw[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
