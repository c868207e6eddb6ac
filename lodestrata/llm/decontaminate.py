"""Which documents hold passages of a benchmark, by one FM-index for each shard of the training documents.

The index is built once, by each task over what it reads, and stored as a table; any number of benchmarks may be searched
in it. Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII, known by 64-bit numbers. A test
item's windows of ``width`` words are searched backwards through the wavelet ranks, their occurrences are located by
sampled suffix positions and merged to spans of words to be removed. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, stored
from .batches import pieces
from .fm_index import FMIndex
from .shingles import word_numbers

WIDTH = 10
#: Words after which a task begins another shard, and windows that one pass over the index looks for.
SHARD, PASS = 1_000_000, 200_000
FIELDS = ("vocabulary", "counts", "sizes", "levels", "marks", "samples")
KINDS = {"vocabulary": np.uint64, "levels": np.uint64, "marks": np.uint64, "samples": np.int32, "counts": np.int64, "sizes": np.int64}
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SPANS = "array<struct<start:bigint,end:bigint>>"


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_numbers([b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()], BETWEEN)


# ---- the index ----


def _indexed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, []

        def row() -> pa.RecordBatch:
            ids, words, sizes = zip(*held, strict=True)
            index = FMIndex.build(np.concatenate(words), np.concatenate(sizes))
            ids = pa.concat_arrays(ids)
            columns = [pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns += [pa.array([np.ascontiguousarray(index.fields[f], KINDS[f]).tobytes()], pa.binary()) for f in FIELDS]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", *FIELDS])

        for b in pieces(batches, "text"):
            held.append((b.column("id"), *_numbers(b.column("text"))))
            if sum(len(x[1]) for x in held) >= size:
                yield row()
                shard, held = shard + 1, []
        if held:
            yield row()

    return run


def build_index(docs: DataFrame, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each shard with its documents' ids and the arrays of its FM-index.

    Null and empty texts are documents without words; null ids and repeated rows are documents like others; a very long
    text is a shard of its own; other columns are not read; an empty table gives an empty index.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(_indexed(shard), f"shard bigint, ids array<{kind}>, " + ", ".join(f"{f} binary" for f in FIELDS)), "fm_index")


# ---- test phrases ----


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            numbers, sizes = _numbers(b.column("text"))
            items, at = b.column("item").to_pylist(), 0
            for item, n in zip(items, sizes.tolist(), strict=True):
                own = numbers[at : at + n]
                at += n
                found = {own[k : k + width].tobytes() for k in range(max(1, n - width + 1))} if n else ()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    return run


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item, as its words' numbers. An item of fewer words is one window,
    one without words none; a null id is written as the empty string, and items with one id are one item."""
    ship_package(items.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_windows(width), "item string, window binary").distinct(), "windows")


# ---- search ----


def _found(block: pa.Table, width: int, all_rows: bool):
    raw, items = block.column("window").to_pylist(), block.column("item").to_pylist()
    numbered = {w: k for k, w in enumerate(dict.fromkeys(raw))}
    phrases, lengths = np.zeros((len(numbered), width), np.uint64), np.zeros(len(numbered), np.int64)
    for w, k in numbered.items():
        own = np.frombuffer(w, np.uint64)
        phrases[k, : len(own)], lengths[k] = own, len(own)
    owners: list[list[str]] = [[] for _ in numbered]
    for w, item in zip(raw, items, strict=True):
        owners[numbered[w]].append(item)

    def rows_of(row: dict, ids: pa.Array) -> pa.RecordBatch:
        index = FMIndex(*(np.frombuffer(row[f], KINDS[f]) for f in FIELDS))
        sizes, starts = index.fields["sizes"], index.starts
        phrase, lo, hi = index.search(phrases, lengths)
        rows = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        phrase, at = np.repeat(phrase, hi - lo), index.locate(rows)
        edges = np.bincount(at, minlength=index.n + 1) - np.bincount(at + lengths[phrase], minlength=index.n + 1)
        hit = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
        begin, end = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])  # separators lie between documents
        owner = np.searchsorted(starts, begin, side="right") - 1
        items_of: list[set[str]] = [set() for _ in sizes]
        pairs = np.unique((np.searchsorted(starts, at, side="right") - 1) * max(1, len(owners)) + phrase)
        for doc, p in zip((pairs // max(1, len(owners))).tolist(), (pairs % max(1, len(owners))).tolist(), strict=True):
            items_of[doc].update(owners[p])
        spans = pa.ListArray.from_arrays(
            np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32),
            pa.StructArray.from_arrays([pa.array(begin - starts[owner]), pa.array(end - starts[owner])], ["start", "end"]),
        )
        columns = [pa.array([row["shard"]] * len(sizes), pa.int64()), pa.array(np.arange(len(sizes))), ids, pa.array(sizes), spans, pa.array([sorted(x) for x in items_of], pa.list_(pa.string()))]
        out = pa.RecordBatch.from_arrays(columns, ["shard", "place", "id", "n_words", "spans", "items"])
        return out if all_rows else out.filter(pa.array([bool(x) for x in items_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield rows_of({f: b.column(f)[k].as_py() for f in ("shard", *FIELDS)}, b.column("ids")[k].values)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that touch or overlap become one."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            own: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end])
            out.append([{"start": s, "end": e} for s, e in own])
        at = b.schema.get_field_index("spans")
        yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))


def search(index: DataFrame, tests: DataFrame, width: int = WIDTH, block: int = PASS, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each document of the index: how many words it has and how many of them lie
    in occurrences of windows, the ids of the items concerned as sorted strings, and the spans of words to be removed.

    tests comes from windows(). Of it at most about ``block`` rows at a time are sent to the tasks, each time in one pass
    over the index.
    """
    ship_package(index.sparkSession)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"shard bigint, place bigint, id {kind}, n_words bigint, spans {SPANS}, items array<string>"
    passes = max(1, -(-tests.count() // block))
    parts = []
    for k in range(passes):
        own = tests.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k).toArrow()
        parts.append(index.mapInArrow(_found(own, width, k == 0), schema))
    found = parts[0]
    if passes > 1:
        for p in parts[1:]:
            found = found.union(p)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
        found = found.groupBy("shard", "place").agg(F.any_value("id").alias("id"), F.any_value("n_words").alias("n_words"), *lists)
        found = found.withColumn("items", F.array_sort(F.array_distinct("items"))).mapInArrow(_merged, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id") -> DataFrame:
    """search() in a new index of docs, for the windows of items. Untidy tables: build_index(), windows()."""
    return search(build_index(docs, id_col=id_col), windows(items, width), width, id_col=id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@F.udf(T.StringType(), useArrow=True)
def _removed(text: str | None, spans: list | None) -> str | None:
    import re

    if text is None or not spans:
        return text
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its spans of words and what stands between their words."""
    return _removed(text, spans)
