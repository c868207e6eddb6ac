"""Readers as table functions of SQL: ``SELECT f.name, t.* FROM files f, LATERAL read_sheet(f.name, f.content) t``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.embedding import hashing_vector
from ..session import ship_package


class ReadSheet:
    """Rows of a CSV, TSV or XLSX file, with their cells as texts; none where the file can't be parsed or is another kind."""

    def eval(self, name: str, content: bytes) -> Iterator[tuple]:
        from .files import csv_grid, xlsx_grid

        kind = name.rsplit(".", 1)[-1].lower() if name else ""
        parse = {"csv": csv_grid(), "tsv": csv_grid(), "xlsx": xlsx_grid, "xlsm": xlsx_grid}.get(kind)
        if parse and content is not None:
            for r in _sound(parse, name, content):
                yield r["sheet_idx"], r["sheet"], r["row_idx"], r["cells"]


class ReadSections:
    """Paragraphs of a DOCX file or slides of a PPTX file: number, whether it is a heading (a title), text."""

    def eval(self, name: str, content: bytes) -> Iterator[tuple]:
        from . import ooxml

        kind = name.rsplit(".", 1)[-1].lower() if name else ""
        if content is None:
            return
        if kind == "docx":
            for k, (heading, text) in enumerate(_sound(lambda _, c: ooxml.document_blocks(c), name, content)):
                yield k, heading, text
        elif kind == "pptx":
            for k, title, lines, _ in _sound(lambda _, c: ooxml.slides(c), name, content):
                yield k, True, title
                yield k, False, "\n".join(lines)


class EmbedText:
    """The hashing vector of a text, slot by slot; zeros are left out."""

    def eval(self, text: str, dim: int) -> Iterator[tuple]:
        for slot, weight in enumerate(hashing_vector(text, dim).tolist()):
            if weight:
                yield slot, weight


def _sound(parse, name: str, content: bytes) -> list:
    try:
        return list(parse(name, bytes(content)))
    except MemoryError:
        raise
    except Exception:  # a broken file has no rows; ingest_with_outcomes says why
        return []


FUNCTIONS = {
    "read_sheet": (ReadSheet, "sheet_idx: int, sheet: string, row_idx: int, cells: array<string>"),
    "read_sections": (ReadSections, "number: int, heading: boolean, text: string"),
    "embed_text": (EmbedText, "slot: int, weight: double"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    ship_package(spark)
    for name, (function, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=schema))
