"""Arrow batches in pieces of bounded size, for operators that run Python on whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters of text that one numpy pass takes at once; a longer text is a piece of its own.
PIECE = 1_000_000


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most about ``size`` bytes of the column ``text``, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[str]:
    """The column's values, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def for_arrow(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The id as _id, the kept columns and the text as _text, once; and the names of those that the result keeps."""
    ship_package(docs.sparkSession)
    others = [c for c in keep if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("_id"), *others, F.col(text_col).alias("_text"))
    return rows, ["_id", *others, *(["_text"] if text_col in keep else [])]


def schema_of(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def back(out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns' own names again."""
    return out.withColumnsRenamed({"_id": id_col, "_text": text_col})
