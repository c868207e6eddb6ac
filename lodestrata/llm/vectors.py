"""What the vector operators share: usable vectors, groups of equal ones, packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows whose id isn't null and whose vector is not null, not empty, not zero, and has
    finite components only."""
    vec = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.coalesce(sound, F.lit(False)))


def pack_blocks(rows: DataFrame, columns: str = "", narrow: bool = False) -> DataFrame:
    """(block, n, ids, vecs, ...) from (block, id, vec, extra columns of longs): one row for each block, with its columns
    as little-endian bytes. Blocks must be of bounded size. narrow: vectors that single precision holds exactly are packed
    in it, so readers must tell by the length."""
    extra = columns.split()

    def run(table: pa.Table) -> pa.Table:
        flat = table.column("vec").combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(c.flatten() for c in flat.chunks)
        cols = [np.asarray(table.column(c).to_numpy()).astype("<i8").tobytes() for c in ("id", *extra)]
        values = flat.to_numpy(zero_copy_only=False).astype("<f8")
        with np.errstate(over="ignore"):
            small = values.astype("<f4")
        values = small if narrow and (small == values).all() else values
        return pa.table([pa.array([table.column("block")[0].as_py()]), pa.array([table.num_rows]), *(pa.array([c], pa.binary()) for c in cols), pa.array([values.tobytes()], pa.binary())], names=["block", "n", "ids", *extra, "vecs"])

    schema = "block bigint, n bigint, ids binary" + "".join(f", {c} binary" for c in extra) + ", vecs binary"
    return rows.select("block", "id", "vec", *extra).groupBy("block").applyInArrow(run, schema)


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum and scatter matrix (not centred) of the unit vectors of (id, vec), over all rows. The sums
    meet in Spark, by matrix entry; only one matrix comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"))
                x = np.column_stack([np.ones(len(x)), x / np.linalg.norm(x, axis=1, keepdims=True)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    cells = rows.select("vec").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    if not cells:
        return 0, np.zeros(0), np.zeros((0, 0))
    size = int(round(len(cells) ** 0.5))
    full = np.zeros(size * size)
    for r in cells:
        full[r["at"]] = r["value"]
    full = full.reshape(size, size)
    return int(round(full[0, 0])), full[0, 1:], full[1:, 1:]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
