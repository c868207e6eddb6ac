"""Files to records: listing, dispatch by name, one reader for each format.

A reader takes (name, content) and gives plain rows; sheets and documents are shaped by the native operators after
that. Parsing bytes is the only Python step, in Arrow batches on the executors.
"""

from __future__ import annotations

import contextlib
import csv
import io
import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from importlib import import_module

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.records import TYPES, as_records
from ..operators.sections import block_sections, markdown_sections, stem
from ..operators.tabular import sheet_records, sheet_type
from ..session import is_local, ship_package, stored
from . import ooxml

CONNECTORS = {"csv": "csv", "tsv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "pdf": "pdf", "pptx": "pptx", "docx": "docx", "png": "scan", "jpg": "scan", "jpeg": "scan", "tif": "scan", "tiff": "scan"}
#: Below so many characters a PDF page is taken for a scan.
LEAST_PAGE_TEXT = 20

_warned: set[str] = set()


class NotInstalled(Exception):
    """A library that a file's format needs is missing."""


def optional_import(module: str, package: str):
    """The module. Where it isn't installed, one warning, and the file that needs it is skipped with that reason."""
    try:
        return import_module(module)
    except ImportError:
        reason = f"{package} is not installed"
        if module not in _warned:
            _warned.add(module)
            print(f"[skip] {reason}; files that need it are skipped", file=sys.stderr)
        raise NotInstalled(reason) from None


def connector(name: Column) -> Column:
    """Which reader a file goes to. Text files are scans if their name begins with ``scan`` or holds ``.ocr``."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    scan = name.startswith("scan") | F.contains(name, F.lit(".ocr"))
    start = F.when(ext.isin("md", "markdown", "txt"), F.when(scan, "scan").otherwise("deck"))
    return reduce(lambda acc, item: acc.when(ext == item[0], item[1]), CONNECTORS.items(), start).otherwise("unknown")


def _any(low: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def document_type(kind: str, name: Column) -> Column:
    """Source type by the file's name; what counts first differs by format."""
    low = F.lower(name)
    minutes = (_any(low, "minute", "meeting"), "minutes")
    rules = {
        "docx": ([(_any(low, "letter", "correspond"), "letter"), minutes], "report"),
        "pdf": ([minutes, (_any(low, "letter"), "letter")], "report"),
        "deck": ([minutes, (_any(low, "report"), "report")], "deck"),
    }
    cases, default = rules[kind]
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(default)


def local_paths(root: str) -> list[str]:
    """Files under a local folder, names sorted within each folder; those that begin with a dot are left out."""
    if os.path.isfile(root):
        return [root]
    return [os.path.join(d, n) for d, _, names in os.walk(root) for n in sorted(names) if not n.startswith(".")]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, size, mtime) of each file; contents aren't read. Local folders are walked here, since Spark hides
    files whose name begins with an underscore and those below dot folders; other file systems are Spark's to list."""
    if "://" in root:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    if not is_local(spark):
        raise ValueError(f"{root} is a path of the driver's machine; name a file system that all machines reach, such as hdfs://... or file:///... on a shared mount")
    rows = []
    for path in local_paths(root):
        with contextlib.suppress(OSError):  # gone meanwhile
            seen = os.stat(path)
            rows.append((path, os.path.basename(path), seen.st_size, int(seen.st_mtime)))
    return spark.createDataFrame(rows, "path string, name string, size bigint, mtime bigint")


def read_listed(files: DataFrame, root: str) -> DataFrame:
    """The files of a listing of root with their content; workers read the bytes."""
    spark = files.sparkSession
    if "://" in root:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
        return files.join(found, "path").select("path", "name", "content", "size", "mtime")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                with open(row.path, "rb") as f:
                    yield pd.DataFrame({"path": [row.path], "name": [row.name], "content": [f.read()], "size": [row.size], "mtime": [row.mtime]})

    return files.select("path", "name", "size", "mtime").repartition(64).mapInPandas(load, "path string, name string, content binary, size bigint, mtime bigint")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, content, size, mtime) of each file under root."""
    if "://" not in root:
        return read_listed(listing(spark, root), root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), "content", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


#: What became of a file: read, empty (nothing in it to index), skipped (a library is missing) or failed, with the reason.
OUTCOME = "struct<path: string, outcome: string, reason: string, items: bigint>"
OUTCOME_ARROW = pa.struct([("path", pa.string()), ("outcome", pa.string()), ("reason", pa.string()), ("items", pa.int64())])
#: Rows, and bytes of files, that are parsed before they go on.
BATCH, BATCH_BYTES = 2_000, 4_000_000


def parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str, outcomes: list[DataFrame] | None = None) -> DataFrame:
    """The rows that parse(name, content) yields for each file; a column source_file with the name comes first.

    A file that can't be parsed yields nothing and stops no other one. What became of each file is appended to
    ``outcomes`` as a table (path, outcome, reason, items); the parsed rows are then stored, so that both read them."""
    ship_package(files.sparkSession)
    types = StructType.fromDDL(schema)
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of small files go on together; those of a file with more than one batch wait, packed, in a temporary file
        until it is known that the file is sound, so neither many files nor a large one are many Python objects."""
        kind = pa.schema([("source_file", pa.string()), *((n, to_arrow_type(types[n].dataType)) for n in names), ("_outcome", OUTCOME_ARROW)])
        packed = lambda rows: pa.RecordBatch.from_pylist(rows, schema=kind)
        held, size = [], 0
        for b in batches:
            for path, name, content in zip(b.column("path"), b.column("name"), b.column("content"), strict=True):
                path, name, content = path.as_py(), name.as_py(), content.as_py()
                rows, items, outcome, reason, spool = [], 0, "read", None, None
                try:
                    for r in parse(name, bytes(content)):
                        rows.append({"source_file": name, **r})
                        items += 1
                        if len(rows) == BATCH:
                            spool = spool or _Spool(kind)
                            spool.add(packed(rows))
                            rows = []
                    outcome = "read" if items else "empty"
                except NotInstalled as e:
                    outcome, reason = "skipped", str(e)
                except MemoryError:
                    raise
                except Exception as e:  # whatever is wrong with the bytes of one file
                    outcome, reason = "failed", f"{type(e).__name__}: {e}"[:200]
                if outcome not in ("read", "empty"):
                    rows, items, spool = [], 0, None
                if spool:
                    yield from spool.batches()
                held += rows
                held.append({"source_file": name, "_outcome": {"path": path, "outcome": outcome, "reason": reason, "items": items}})
                size += len(content or b"")
                if len(held) >= BATCH or size >= BATCH_BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    every = files.select("path", "name", "content").mapInArrow(run, f"source_file string, {schema}, _outcome {OUTCOME}")
    if outcomes is not None:
        every = stored(every, "parsed")
        outcomes.append(every.where("_outcome IS NOT NULL").select("_outcome.*"))
    return every.where("_outcome IS NULL").drop("_outcome")


class _Spool:
    """Batches that wait in a temporary file."""

    def __init__(self, schema: pa.Schema):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.writer = pa.ipc.new_stream(self.file, schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.writer.close()
        self.file.seek(0)
        with self.file, pa.ipc.open_stream(self.file) as reader:
            yield from reader


GRID = "sheet_idx int, sheet string, row_idx int, cells array<string>"


def csv_grid(strict_compat: bool = False) -> Callable[[str, bytes], Iterator[dict]]:
    """Rows of a CSV or TSV file; strict_compat reads both with commas."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        delimiter = "\t" if name.lower().endswith(".tsv") and not strict_compat else ","
        sheet = os.path.splitext(name)[0]
        reader = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=delimiter)
        for i, cells in enumerate(reader):
            yield {"sheet_idx": 0, "sheet": sheet, "row_idx": i, "cells": cells}

    return parse


def xlsx_grid(name: str, content: bytes) -> Iterator[dict]:
    for k, (sheet, rows) in enumerate(ooxml.workbook(content)):
        for i, cells in enumerate(rows):
            yield {"sheet_idx": k, "sheet": sheet, "row_idx": i, "cells": cells}


def docx_blocks(name: str, content: bytes) -> Iterator[dict]:
    yield {"blocks": [{"is_heading": h, "text": t} for h, t in ooxml.document_blocks(content)]}


def pptx_slides(name: str, content: bytes) -> Iterator[dict]:
    for n, title, lines, notes in ooxml.slides(content):
        body = "\n".join(lines).strip()
        if body:
            yield {"title": (title or lines[0])[:120], "raw_text": body, "row_or_page": f"slide {n}", "has_notes": notes}


def _first_line(text: str, name: str) -> str:
    return next((x.strip() for x in text.splitlines() if x.strip()), name)[:120]


def pdf_pages(name: str, content: bytes) -> Iterator[dict]:
    """Pages with text; a page with hardly any is read by OCR where that is installed."""
    fitz = optional_import("fitz", "pymupdf")
    with fitz.open(stream=content, filetype="pdf") as pages:
        for n, page in enumerate(pages, 1):
            text, by = page.get_text().strip(), "text-layer"
            if len(text) < LEAST_PAGE_TEXT and (read := _ocr(lambda page=page: page.get_pixmap(dpi=200).tobytes("png"))):
                text, by = read, OCR_NAME
            if text.strip():
                yield {"title": _first_line(text, name), "raw_text": text, "row_or_page": f"page {n}", "extractor": by}


OCR_NAME = "tesseract(mar+hin+eng)"


def _ocr(image: Callable[[], bytes]) -> str:
    """Text of an image, or nothing where OCR isn't installed or fails."""
    import shutil

    if shutil.which("tesseract") is None:
        return ""
    try:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(image())), lang="mar+hin+eng").strip()
    except Exception:  # an unreadable image is a file without text
        return ""


def scan_text(name: str, content: bytes) -> Iterator[dict]:
    """Text of an image by OCR; of a text file as it is."""
    if name.lower().endswith(".txt"):
        text, engine = content.decode("utf-8", "replace"), "sidecar/plain-text"
    else:
        text, engine = _ocr(lambda: content), OCR_NAME
    yield {"text": text, "ocr_engine": engine}


def scan_records(files: DataFrame, strict_compat: bool = False, outcomes: list[DataFrame] | None = None) -> DataFrame:
    """One record for each scan with text. An image without OCR takes the text of ``<stem>.ocr.txt`` beside it; such a
    sidecar is a record of its own only with strict_compat, or where no image stands beside it."""
    # bytes of text files are text already; only images need Python
    rows = files.select("path", "name", "content")
    is_text = F.lower("path").endswith(".txt")
    own = [] if outcomes is not None else None
    images = parsed(rows.where(~is_text).withColumn("name", F.col("path")), scan_text, "text string, ocr_engine string", own).withColumnRenamed("source_file", "path")
    images = images.join(rows.where(~is_text).select("path", "name"), "path")
    plain = rows.where(is_text).select("path", "name", _decoded(F.col("content")).alias("text"), F.lit("sidecar/plain-text").alias("ocr_engine"))
    if outcomes is not None:
        outcomes += own
        outcomes.append(plain.select("path", F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("items")))
    # images and the texts beside them meet once, by folder and stem
    key, sidecar = F.regexp_replace("path", r"(\.ocr)?\.[^./]*$", "").alias("key"), F.lower("path").endswith(".ocr.txt")
    beside = plain.where(sidecar).select(key, F.struct("name", "text").alias("beside"))
    both = images.select(key, F.struct("name", "text", "ocr_engine").alias("image")).join(beside, "key", "left" if strict_compat else "full_outer")
    own_text = T.strip(F.coalesce("image.text", F.lit(""))) != ""
    seen = both.select(F.coalesce("image.name", "beside.name").alias("name"), F.when(own_text, F.col("image.text")).otherwise(F.col("beside.text")).alias("text"), F.when(own_text, F.col("image.ocr_engine")).otherwise("sidecar/plain-text").alias("ocr_engine"))
    plain = plain if strict_compat else plain.where(~sidecar)
    every = seen.unionByName(plain.drop("path")).where(F.col("text").isNotNull() & (T.strip(F.col("text")) != ""))
    name = F.col("name")
    line = F.get(F.filter(F.transform(F.split("text", T.LINE_END), T.strip), lambda x: x != ""), F.lit(0))
    return every.select(name.alias("source_file"), F.substring(F.coalesce(line, name), 1, 120).alias("title"), F.col("text").alias("raw_text"), F.lit("page 1").alias("row_or_page"), F.lit("scan").alias("source_type"), _extra(ocr_engine=F.col("ocr_engine")))


def _extra(**known: Column) -> Column:
    kinds = {"columns": "map<string, string>", "ocr_engine": "string", "extractor": "string", "has_notes": "boolean", "origin_id": "string", "origin_modified": "string"}
    return F.struct(*((known.get(k, F.lit(None))).cast(t).alias(k) for k, t in kinds.items())).alias("extra")


def _decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, bad ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def ingest(files: DataFrame, strict_compat: bool = False, kinds: set[str] | None = None, outcomes: list[DataFrame] | None = None) -> DataFrame:
    """Records (untagged) of all files (path, name, content). kinds: formats that occur, where the caller knows; a
    format that doesn't occur then costs no scan. outcomes: a list to which tables (path, outcome, reason, items) of what
    became of the files are appended, see ingest_with_outcomes()."""
    every = files.withColumn("connector", connector(F.col("name")))
    if kinds is None:
        kinds = {r[0] for r in every.select("connector").distinct().collect()}
    part = lambda kind: every.where(F.col("connector") == kind)
    out: list[DataFrame] = []
    if "csv" in kinds:
        out.append(sheet_records(parsed(part("csv"), csv_grid(strict_compat), GRID, outcomes)))
    if "xlsx" in kinds:
        out.append(sheet_records(parsed(part("xlsx"), xlsx_grid, GRID, outcomes), workbook=True))
    if "deck" in kinds:
        text = part("deck").select(F.col("name").alias("source_file"), _decoded(F.col("content")).alias("text"))
        out.append(as_records(markdown_sections(text).withColumn("source_type", document_type("deck", F.col("source_file")))))
    if "docx" in kinds:
        blocks = parsed(part("docx"), docx_blocks, "blocks array<struct<is_heading: boolean, text: string>>", outcomes)
        out.append(as_records(block_sections(blocks).withColumn("source_type", document_type("docx", F.col("source_file")))))
    if "pptx" in kinds:
        slides = parsed(part("pptx"), pptx_slides, "title string, raw_text string, row_or_page string, has_notes boolean", outcomes)
        out.append(as_records(slides.withColumn("source_type", F.lit("deck")).withColumn("extra", _extra(has_notes=F.col("has_notes")))))
    if "pdf" in kinds:
        pages = parsed(part("pdf"), pdf_pages, "title string, raw_text string, row_or_page string, extractor string", outcomes)
        kind = F.when(F.col("extractor") == OCR_NAME, "scan").otherwise(document_type("pdf", F.col("source_file")))
        out.append(as_records(pages.withColumn("source_type", kind).withColumn("extra", _extra(extractor=F.col("extractor")))))
    if "scan" in kinds:
        out.append(as_records(scan_records(part("scan"), strict_compat, outcomes)))
    if "unknown" in kinds:
        text = part("unknown").select(F.col("name").alias("source_file"), F.col("name").alias("title"), _decoded(F.col("content")).alias("raw_text"))
        out.append(as_records(text))
    if outcomes is not None and kinds & {"deck", "unknown"}:  # any bytes are text of some kind
        outcomes.append(every.where(F.col("connector").isin("deck", "unknown")).select("path", F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("items")))
    if not out:
        return files.sparkSession.createDataFrame([], ", ".join(f"{c} {k}" for c, k in TYPES.items()))
    return reduce(DataFrame.unionByName, out)


def ingest_with_outcomes(files: DataFrame, strict_compat: bool = False, kinds: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, outcomes): the records of all files, and for each file (path, outcome, reason, items)."""
    found: list[DataFrame] = []
    records = ingest(files, strict_compat, kinds, found)
    none = files.sparkSession.createDataFrame([], "path string, outcome string, reason string, items bigint")
    return records, reduce(DataFrame.unionByName, found, none)


__all__ = ["connector", "document_type", "ingest", "ingest_with_outcomes", "listing", "local_paths", "optional_import", "read_files", "read_listed", "scan_records", "sheet_type", "stem"]
