"""Best-fit packing of tokenized documents into sequences of bounded length, by hierarchical residual packing.

Each task packs its own pieces best fit, longest first. Bins that are nearly full are final. The rest become items of
the next round: fewer tasks, larger pools, the same best fit, and so on until one pool holds all that is left or
nothing combines any more. Only (bin, fill) pairs move between rounds; the pieces stay where they were written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored
from .batches import pieces, texts
from .bpe import encoder

#: Items of one best-fit pool; a task with more works pool after pool, so its memory is bounded.
POOL = 100_000
#: A bin with at most this share of its capacity free is final before the last round.
SLACK = 0.005
#: Rounds of merging at most; each but the last has an eighth of the tasks, or a tenth fewer items, of the one before.
LEVELS = 63
#: A round that leaves more than this share of its items open is the last one.
STALLED = 0.9


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and fill of each bin: longest items first, each into the fullest bin it fits.

    lengths are from 1 to capacity. Free space is an integer, so open bins lie in one stack for each amount, and a bit
    mask of non-empty stacks finds the tightest one: no search over bins.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            k = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        left = free - n
        if left:
            stacks[left].append(k)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _new_bins(count: int, start: int) -> np.ndarray:
    return (TaskContext.get().partitionId() << 36) + start + np.arange(count)


def cut_and_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their local bins: (id, piece, start, length, ids_crc32, bin, at, fill)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for b in pieces(batches, "text"):
            ids, counts = encoder(tokenizer).encode_batch(texts(b.column("text")))
            ends = np.cumsum(counts)
            sizes = counts + 1
            full = np.insert(ids, ends, closing).astype("<u4")
            parts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            first = (np.cumsum(sizes) - sizes)[owner] + start
            raw = full.tobytes()
            crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(owner))
            yield b.column("id").take(pa.array(owner)), np.stack([piece, start, length, crc])

    def pack(pool: list[tuple[pa.Array, np.ndarray]], made: int) -> tuple[pa.RecordBatch, int]:
        ids = pa.concat_arrays([x for x, _ in pool])
        piece, start, length, crc = np.concatenate([x for _, x in pool], axis=1)
        bins, at, fills = best_fit(length, capacity)
        named = _new_bins(len(fills), made)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, (piece, start, length, crc, named[bins], at, fills[bins]))], names), made + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size, made = [], 0, 0
        for x in cut(batches):
            pool.append(x)
            size += x[1].shape[1]
            if size >= POOL:
                out, made = pack(pool, made)
                pool, size = [], 0
                yield out
        if pool:
            yield pack(pool, made)[0]

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def merge_round(items: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """Best fit over bins as items: (bin, fill) to (bin, parent, at, parent_fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        pool: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(pool)
            fill = table.column("fill").to_numpy()
            bins, at, fills = best_fit(fill, capacity)
            named = _new_bins(len(fills), made)
            made += len(fills)
            pool.clear()
            return pa.RecordBatch.from_arrays([table.column("bin").combine_chunks(), pa.array(named[bins]), pa.array(at), pa.array(fills[bins])], ["bin", "parent", "at", "parent_fill"])

        for b in batches:
            for k in range(0, b.num_rows, POOL):
                if sum(x.num_rows for x in pool) + b.num_rows - k > POOL and pool:
                    yield pack()
                pool.append(b.slice(k, POOL))
        if pool:
            yield pack()

    return items.repartition(tasks).mapInArrow(run, "bin bigint, parent bigint, at bigint, parent_fill bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids.

    A document is its ids and one closing id; only a longer one is cut, into pieces of ``capacity`` (the last may be
    shorter). One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    its closing id alone; null ids stay; repeated rows are documents of their own; other columns are not read; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    ship_package(spark)
    local = stored(cut_and_pack(docs, tokenizer, capacity, closing, id_col, text_col), "pieces")
    open_below = int(capacity * (1 - SLACK))
    items = local.where((F.col("at") == 0) & (F.col("fill") < open_below)).select("bin", "fill")
    n, tasks, level = items.count(), max(1, local.rdd.getNumPartitions()), 0
    links: list[DataFrame] = []
    while n > 1:
        tasks = max(1, -(-tasks // fan_in), -(-n // POOL))
        merged = stored(merge_round(items, tasks, capacity), f"bins{level}")
        links.append(merged)
        left = merged.where((F.col("at") == 0) & (F.col("parent_fill") < open_below)).select(F.col("parent").alias("bin"), F.col("parent_fill").alias("fill"))
        before, n, level = n, left.count(), level + 1
        if tasks == 1 or level == LEVELS or (n > STALLED * before and tasks == -(-before // POOL)):
            break
        items = left
    # names of bins are unique within a level: a sequence is (level, bin)
    number = lambda bin_, level: F.col(bin_) * (LEVELS + 1) + level
    where = None
    for k in reversed(range(len(links))):
        link = links[k].select("bin", "parent", F.col("at").alias("shift"))
        if where is None:
            where = link.select("bin", number("parent", k + 1).alias("sequence_id"), "shift")
        else:
            up = where.select(F.col("bin").alias("parent"), "sequence_id", F.col("shift").alias("more"))
            where = link.join(up, "parent", "left").select("bin", F.coalesce("sequence_id", number("parent", k + 1)).alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    if where is None:
        placed = local.select("*", number("bin", 0).alias("sequence_id"), F.lit(0).cast("bigint").alias("shift"))
    else:
        placed = local.join(where, "bin", "left").withColumn("sequence_id", F.coalesce("sequence_id", number("bin", 0)))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
