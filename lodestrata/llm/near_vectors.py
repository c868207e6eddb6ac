"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one vector with a count. Unit vectors are turned to principal axes, largest variance first, and dealt
by their leading coordinates into tiles of bounded size. Two tiles meet unless their bounding boxes are too far apart;
they travel in groups, so that a tile is sent once to each group that it has work with.
Within a pair of tiles the leading coordinates are multiplied first; the product of the suffix norms, which rides along
as one more coordinate, bounds what the others can add, so a pair stops as soon as its cosine can't reach the
threshold. What is left is computed in double precision from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, ship_package, stored
from .components import components
from .vectors import moments, pack_blocks, usable

#: Vectors of a tile.
TILE = 4096
#: Leading dimensions of the first and the second bound, as shares of all.
LEADING = (0.25, 0.5)
#: Rounding that the bounds allow for.
MARGIN = 1e-9
#: Candidate pairs that are computed exactly at once.
CHUNK = 100_000
#: Groups of tiles at least, and vectors of a group: each tile is sent to as many places as there are groups, so what is
#: shuffled is GROUPS times the vectors up to GROUPS * GROUP of them, and two groups fit a task's memory.
GROUPS, GROUP = 12, 131_072


def _bounded(x: np.ndarray, upto: int) -> np.ndarray:
    """The leading coordinates and the norm of the rest."""
    return np.column_stack([x[:, :upto], np.sqrt(np.maximum((x[:, upto:] ** 2).sum(1), 0))])


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component in a graph of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _together(root: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The roots after further links."""
    if not ends:
        return root
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    return _local_roots(root[a], root[b], len(root))[root]


def _rows(content: bytes, dim: int, n: int) -> np.ndarray:
    """Packed vectors, stored in single precision where that holds them exactly, in double precision."""
    return np.frombuffer(content, f"<f{len(content) // (n * dim)}").reshape(n, dim).astype("<f8", copy=False)


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs with a cosine of at least the threshold; for equal tiles i < j. x and y: original rows."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    px, py = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    first, second = (max(1, int(round(s * axes.shape[0]))) for s in LEADING)
    ax, ay = _bounded(px, first), _bounded(py, first)
    bx, by = _bounded(px, second), _bounded(py, second)
    for a in range(0, len(x), 512):
        i, j = np.nonzero(ax[a : a + 512] @ ay.T >= threshold - MARGIN)
        i += a
        if same:
            upper = i < j
            i, j = i[upper], j[upper]
        for c in range(0, len(i), CHUNK):
            p, q = i[c : c + CHUNK], j[c : c + CHUNK]
            alive = np.einsum("ij,ij->i", bx[p], by[q]) >= threshold - MARGIN
            p, q = p[alive], q[alive]
            if len(p):
                hit = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
                yield p[hit], q[hit]


def near_vectors(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of table.

    n_links counts the other rows with a cosine of at least the threshold; component_id is the smallest id reachable by
    links; kept is id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing: no links, a component of their own. Rows with a null id take no part and keep nulls (kept false).
    Repeated rows are rows of their own, linked with each other. Vectors of different lengths are never linked. Other
    columns are not read; an empty table gives an empty table.
    """
    spark = table.sparkSession
    ship_package(spark)
    rows = usable(table, id_col, vector_col)
    distinct = stored(rows.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("id"), "least", "copies", "vec", F.size("vec").alias("dim")), "vectors")
    parts = []
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        parts.append(_linked(distinct.where(F.col("dim") == dim), threshold))
    if not parts:
        parts = [distinct.select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("other"))]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = stored(found, "tile_links")
    roots = components(found.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = distinct.select("id", "least", "copies", "vec").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # tables of their own: a component may hold much of all vectors, and one vector much of all rows; with exchanges on
    # both sides of a join adaptive execution can split such a key
    groups = stored(groups, "groups")
    least = stored(groups.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    groups = stored(groups.join(least, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    sound = rows.join(groups, "vec").select("id", "n_links", "component_id")
    other = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    unsound = other.where(~F.coalesce(F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False)))
    out = sound.union(unsound.select("id", F.lit(0).cast("bigint"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(distinct: DataFrame, threshold: float) -> DataFrame:
    """(id, links, other): for each pair of groups of tiles an id's links in it, weighted by copies, and the smallest id
    of its component within the pair."""
    spark = distinct.sparkSession
    n, total, scatter = moments(distinct)
    dim = len(total)
    values, axes = np.linalg.eigh(scatter / max(n, 1))
    axes = np.ascontiguousarray(axes[:, ::-1])
    tiles = max(1, -(-n // TILE))
    lead = F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(v)) for v in axes[:, 0])), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    # ranges of the leading coordinate; equal vectors are one row here, so no range is hot. A range that is larger than
    # a tile is cut by position.
    keyed = distinct.select("id", "copies", "vec", (lead / norm).alias("lead")).repartitionByRange(tiles, "lead", "id")
    ranked = stored(keyed.withColumn("part", F.spark_partition_id().cast("bigint")), "ordered")
    place = F.row_number().over(Window.partitionBy("part").orderBy("lead", "id")) - 1
    tiled = ranked.withColumn("block", F.col("part") * 1_000_000 + F.floor(place / TILE))
    blocks = stored(pack_blocks(tiled, "copies", narrow=True), "tiles")
    drop_stored(ranked)
    groups = min(tiles, max(GROUPS, -(-n // GROUP)))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, vecs, n in zip(*(b.column(c).to_pylist() for c in ("block", "vecs", "n")), strict=True):
                x = _rows(vecs, dim, n)
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :8]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()])], ["block", "lo", "hi"])

    boxes = blocks.select("block", "vecs", "n").mapInArrow(box, "block bigint, lo array<double>, hi array<double>")
    boxes = stored(boxes.withColumn("grp", (F.floor(F.col("block") / 1_000_000) * groups / tiles).cast("int")), "boxes")
    # tiles meet by cells of their leading coordinate, as wide as two vectors that link can be apart; then by their boxes
    reach = (2 - 2 * threshold) ** 0.5 + MARGIN
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach))).alias("cell")
    one, two = boxes.toDF("i", "lo_i", "hi_i", "grp_i"), boxes.toDF("j", "lo_j", "hi_j", "grp_j")
    one = one.select("*", cells(F.get("lo_i", F.lit(0)), F.get("hi_i", F.lit(0))))
    two = two.select("*", cells(F.get("lo_j", F.lit(0)) - reach, F.get("hi_j", F.lit(0)) + reach))
    gap = F.expr("aggregate(sequence(0, size(lo_i) - 1), 0D, (s, k) -> s + pow(greatest(0D, lo_i[k] - hi_j[k], lo_j[k] - hi_i[k]), 2))")
    pairs = one.join(two, "cell").where((F.col("i") <= F.col("j")) & (gap <= 2 - 2 * threshold + MARGIN)).select("i", "j", "grp_i", "grp_j").distinct()
    # a tile travels once to each pair of groups that has work for it, not once to each tile that it meets
    square = F.least("grp_i", "grp_j") * groups + F.greatest("grp_i", "grp_j")
    sent = pairs.select(square.alias("square"), F.explode(F.array("i", "j")).alias("block"), "i", "j")
    sent = sent.groupBy("square", "block").agg(F.collect_set(F.when(F.col("block") == F.col("i"), F.col("j"))).alias("meets"))
    # few squares with much work each: in ranges each has a task of its own
    work = sent.join(blocks, "block").repartitionByRange(groups * (groups + 1) // 2, "square")

    def compare(table: pa.Table) -> pa.Table:
        at = {b: k for k, b in enumerate(table.column("block").to_pylist())}
        ids, copies = ([np.frombuffer(x.as_buffer(), "<i8") for x in table.column(c)] for c in ("ids", "copies"))
        vecs = lambda k: _rows(table.column("vecs")[k].as_buffer(), dim, len(ids[k]))
        start = np.cumsum([0, *map(len, ids)])
        every = np.concatenate(ids)
        links, root = np.zeros(len(every), np.int64), np.arange(len(every))
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for i, meets in enumerate(table.column("meets").to_pylist()):
            x = vecs(i) if meets else None
            for j in (at[b] for b in meets):
                y, shift = (x, 0) if i == j else (vecs(j), len(ids[i]))
                own = np.arange(shift + len(ids[j]))
                for p, q in close_pairs(x, y, axes, threshold, i == j):
                    np.add.at(links, start[i] + p, copies[j][q])
                    np.add.at(links, start[j] + q, copies[i][p])
                    # links of this chunk between the roots so far: the local graph never holds more than a chunk
                    own = _local_roots(own[p], own[q + shift], len(own))[own]
                joined = np.flatnonzero(own != np.arange(len(own)))
                place = lambda k, i=i, j=j, shift=shift: np.where(k < shift, start[i] + k, start[j] + k - shift) if i != j else start[i] + k
                ends.append((place(own[joined]), place(joined)))
                waiting += len(joined)
                if waiting > CHUNK * 10:
                    root, ends, waiting = _together(root, ends), [], 0
        root = _together(root, ends)
        busy = np.flatnonzero(links)
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, root, every)
        return pa.table([pa.array(every[busy]), pa.array(links[busy]), pa.array(least[root[busy]])], names=["id", "links", "other"])

    return work.groupBy("square").applyInArrow(compare, "id bigint, links bigint, other bigint")
