"""Vectors in Arrow batches: dense matrices of them, and the largest dot products with a block of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products that are held at a time.
PRODUCTS = 4_000_000


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` numbers: longer lists are cut, shorter ones end in zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, kept = np.repeat(np.arange(len(lengths)), lengths), at < dim
    out[row[kept], at[kept]] = flat[kept]
    return out


def whole(column: pa.Array) -> np.ndarray:
    """Which lists are there and hold no null."""
    ok, flat = column.is_valid().to_numpy(zero_copy_only=False).copy(), column.flatten()
    if flat.null_count:
        row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        ok[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    return ok


def _best(query: np.ndarray, score: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of each query's k best scores, and of all that may tie with the last of them after rounding."""
    order = np.lexsort((-score, query))
    q = query[order]
    starts = np.searchsorted(q, np.unique(q))
    sizes = np.diff(np.r_[starts, len(q)])
    least = score[order][starts + np.minimum(sizes, k) - 1]
    return order[score[order] >= np.repeat(least, sizes) - slack]


def best_products(queries: pa.Table, k: int, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(qid, id, score) of at least the k best of a task's vectors (id, vec) for each query (qid, qvec)."""
    queries = queries.combine_chunks()
    queries = queries.filter(pa.array(whole(queries.column("qvec").combine_chunks())))
    qids, qvec = queries.column("qid").combine_chunks(), queries.column("qvec").combine_chunks()
    dim = int(np.diff(qvec.offsets.to_numpy()).max(initial=0))
    q = matrix(qvec, dim).T.copy() if len(qids) else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            query, score = (np.concatenate([h[x] for h in held]) for x in (0, 1))
            keep = _best(query, score, k, slack)
            return query[keep], score[keep], pa.concat_arrays([h[2] for h in held]).take(pa.array(keep))

        if not len(qids):
            return
        step = max(1, PRODUCTS // len(qids))
        for b in batches:
            b = b.filter(pa.array(whole(b.column("vec"))))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                products = matrix(part.column("vec"), dim) @ q
                least = np.partition(products, len(products) - k, axis=0)[len(products) - k] if len(products) > k else np.full(len(qids), -np.inf)
                row, query = np.nonzero(products >= least - slack)
                held.append((query, products[row, query], part.column("id").take(pa.array(row))))
                if sum(len(h[0]) for h in held) > 4 * k * len(qids):
                    held = [merged()]
        if held:
            query, score, ids = merged()
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), ids, pa.array(score)], ["qid", "id", "score"])

    return run
