"""Approximate nearest neighbours by shifted Hilbert curves.

Each of several orderings projects all vectors on its own random axes, shifts them, and sorts them along a Hilbert
curve; Spark range-partitions the keys. A query's candidates in an ordering are the blocks around its own place; their
inner products are computed exactly, and the best of all orderings are merged.

How wide the windows have to be depends on the vectors. Those without structure (independent in all dimensions) have no
order that keeps neighbours together, and windows have to cover a share of the table; of clustered ones a few blocks
are enough. So the width is measured: a bounded sample of the queries is answered by brute force, and the windows are
as wide as it takes for the orderings together to hold ``recall`` of the true neighbours. All queries then take it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, ship_package, stored
from .vectors import moments, pack_blocks, usable

#: Orderings, dimensions of each, and bits of each dimension.
CURVES, DIMS, BITS = 8, 8, 7
#: Vectors of a block at most, and blocks that the table is cut into at least (of LEAST vectors, though).
BLOCK, BLOCKS, LEAST = 4096, 64, 32
#: Queries that the width of the windows is measured on, and the share of their true neighbours that they have to hold.
SAMPLE, RECALL = 100, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (non-negative integers below 2**bits), by Skilling's transform."""
    x = cells.T.astype(np.uint64)
    one, zero = np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, zero)
    x ^= fix
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


class Curve:
    """One ordering: an orthonormal projection, a scale of each axis and a shift."""

    def __init__(self, number: int, scatter: np.ndarray, mean: np.ndarray, dims: int, bits: int):
        r = np.random.default_rng([20_071, number])
        dims = min(dims, len(mean))
        self.axes = np.linalg.qr(r.normal(size=(len(mean), dims)))[0]
        centred = scatter - np.outer(mean, mean)
        self.spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", self.axes, centred @ self.axes), 1e-12))
        self.middle = mean @ self.axes
        self.shift, self.bits = r.uniform(-0.5, 0.5, dims), bits

    def keys(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = ((unit @ self.axes - self.middle) / self.spread + self.shift + 4) / 8
        return hilbert_keys(np.clip(z * 2**self.bits, 0, 2**self.bits - 1).astype(np.int64), self.bits).view(np.int64)


def ordered(distinct: DataFrame, curves: list[Curve]) -> DataFrame:
    """(curve, place, id): where each row of (id, vec) lies along each curve, counted from 0. Only keys and ids are
    sorted, in ranges of Spark's."""
    spark, dim = distinct.sparkSession, len(curves[0].axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for c, curve in enumerate(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve.keys(x)), b.column("id")], ["curve", "key", "id"])

    keyed = distinct.select("id", "vec").mapInArrow(run, "curve int, key bigint, id bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal vectors are one row, so a key repeats only for different vectors of one cell; the id splits those
    ranges = stored(keyed.repartitionByRange(parts, "curve", "key", "id").withColumn("part", F.spark_partition_id()), "curves")
    counts = {(r["curve"], r["part"]): r["count"] for r in ranges.groupBy("curve", "part").count().collect()}  # a number for each partition and curve in it
    offset, total = [], {}
    for c, p in sorted(counts):
        offset.append((c, p, total.get(c, 0)))
        total[c] = total.get(c, 0) + counts[c, p]
    starts = spark.createDataFrame(offset or [(0, 0, 0)], "curve int, part int, start bigint")
    place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "id")) - 1
    return stored(ranges.withColumn("place", place).join(F.broadcast(starts), ["curve", "part"]).select("curve", (F.col("start") + F.col("place")).alias("place"), "id"), "places")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores the k best, ties to smaller ids; and all that tie with the last."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], col[keep]


def _true_neighbours(own: DataFrame, sample: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    """Ids of each sampled vector's k best other rows, by brute force over all rows: one pass, the best of each batch
    go on."""
    ids, x = np.array([i for i, _ in sample]), np.array([v for _, v in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, other = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1]), b.column("id").to_numpy()
            row, col = _best(scores := x @ y.T, other, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(other[col]), pa.array(scores[row, col])], ["query", "id", "score"])

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    near = own.select("id", "vec").mapInArrow(run, "query bigint, id bigint, score double").where("id != query").withColumn("r", best).where(F.col("r") <= k)
    out: dict[int, list[int]] = {}
    for r in near.collect():  # k rows of each sampled query
        out.setdefault(r["query"], []).append(r["id"])
    return out


def window_reach(places: DataFrame, near: dict[int, list[int]], curves: int, n: int, block: int, recall: float) -> int:
    """Blocks on either side of a query's own that its window has to hold, so that in at least one of the curves
    ``recall`` of the sampled queries' true neighbours lie in it."""
    blocks = -(-n // block)
    ids = sorted({*near, *(i for x in near.values() for i in x)})
    at = {(r["curve"], r["id"]): r["place"] // block for r in places.where(F.col("id").isin(ids)).collect()} if ids else {}
    needed = []
    for q, found in near.items():
        for i in found:
            needed.append(min(_reach_of(at[c, q], at[c, i], blocks) for c in range(curves)))
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


def _reach_of(own: int, other: int, blocks: int) -> int:
    """The least reach with which the window around block ``own`` holds block ``other``. At the ends of the curve windows
    are shifted inwards, so all are 2 * reach + 1 blocks wide."""
    shifted = -(-(blocks - 1 - other) // 2) if own > other else -(-other // 2)
    return min(abs(own - other), shifted)


def _candidates(queries: DataFrame, blocks: DataFrame, n_blocks: int, reach: int, k: int, dim: int) -> DataFrame:
    """(query, id, score): for each query the k best rows of each block of the window around its own."""
    first = F.greatest(F.lit(0), F.least(F.col("block") - reach, F.lit(n_blocks - 1 - 2 * reach)))
    window = F.sequence(first, F.least(F.lit(n_blocks - 1), first + 2 * reach))
    near = queries.select(F.explode(window).alias("block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, ids = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("q_ids", "ids"))
                q, x = (np.frombuffer(b.column(c)[i].as_py(), "<f8").reshape(-1, dim) for c in ("q_vecs", "vecs"))
                for a in range(0, len(q), 256):
                    row, col = _best(scores := q[a : a + 256] @ x.T, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + row]), pa.array(ids[col]), pa.array(scores[row, col])], ["query", "id", "score"])

    return near.join(blocks.select("block", "ids", "vecs"), "block").mapInArrow(run, "query bigint, id bigint, score double")


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, block: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): for each row of table that is_query holds for (a condition on its column "id"), its
    k nearest other rows found, by inner product in double precision, ties to smaller ids.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids, nor (as a
    candidate of another length) vectors of other lengths. Fewer candidates than k are all returned. Repeated ids are
    one row, the least of their vectors. Other columns are not read; an empty table gives an empty table.
    """
    spark = table.sparkSession
    ship_package(spark)
    rows = usable(table, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec"))
    # of equal vectors a list can never hold more than the k + 1 smallest ids
    few = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    copies = rows.withColumn("r", few).where(F.col("r") <= k + 1).groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("copies"))
    distinct = stored(copies.withColumn("dim", F.size("vec")), "vectors")
    asked = stored(rows.where(is_query).select(F.col("id").alias("query_id"), "vec").join(distinct.select("vec", "id"), "vec").select("query_id", "id"), "queries")
    found = None
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        own = distinct.where(F.col("dim") == dim)
        n, total, scatter = moments(own)
        size = block or min(BLOCK, max(LEAST, -(-n // BLOCKS)))
        places = ordered(own, [Curve(c, scatter / n, total / n, dims, bits) for c in range(curves)])
        mine = asked.select("id").distinct().join(own, "id")
        drawn = [(r["id"], r["vec"]) for r in mine.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vec").collect()]
        reach = window_reach(places, _true_neighbours(own, drawn, k) if drawn else {}, curves, n, size, recall)
        for c in range(curves):
            along = places.where(F.col("curve") == c).select("id", F.floor(F.col("place") / size).alias("block")).join(own.select("id", "vec"), "id")
            packed = stored(pack_blocks(along), "blocks")
            queries = pack_blocks(along.join(asked.select("id").distinct(), "id", "left_semi"))
            best = stored(_candidates(queries, packed, -(-n // size), reach, k + 1, dim), "candidates")
            drop_stored(packed)
            found = best if found is None else found.union(best)
        drop_stored(places)
    if found is None:
        found = spark.createDataFrame([], "query bigint, id bigint, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    # equal vectors were one: each query row gets the copies back
    wide = asked.withColumnRenamed("id", "query").join(top.drop("r"), "query").join(distinct.select("id", "copies"), "id")
    wide = wide.select("query_id", F.explode("copies").alias("id"), "score").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return wide.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
