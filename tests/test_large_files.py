"""Large files and many small ones: what waits for a file's end is packed, and doesn't grow with it as Python objects."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.plans import office
from lodestrata.sources import files, ooxml


def peak(n: int) -> int:
    rows = ((k, [k, f"name {k}", 1.5 * k]) for k in range(n))
    tracemalloc.start()
    content = office.workbook([("big", rows)])
    read = sum(len(r["cells"]) for r in files.xlsx_grid("x.xlsx", content))
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 3 * n
    return found - len(content)


def test_workbooks_are_streamed(monkeypatch):
    monkeypatch.setattr(ooxml, "SPOOL", 10_000)
    assert peak(20_000) < 2 * peak(5_000)


def test_rows_out_of_order_and_merged_ranges(monkeypatch):
    monkeypatch.setattr(ooxml, "SPOOL", 10)
    content = office.workbook([("s", [(3, ["d", "e"]), (0, ["a"]), (3, ["", "f"]), (5, ["x", "y", "z"])])])
    (name, rows), = ooxml.workbook(content)
    assert (name, list(rows)) == ("s", [["a", "", ""], ["", "", ""], ["", "", ""], ["d", "f", ""], ["", "", ""], ["x", "y", "z"]])


@pytest.mark.parametrize("end", ["", "broken"])
def test_a_large_file_is_read_whole_or_not_at_all(spark, monkeypatch, end):
    monkeypatch.setattr(files, "BATCH", 3)

    def parse(name, content):
        for i in range(10):
            yield {"n": i}
        if name == "broken":
            raise ValueError("late")

    table = spark.createDataFrame([("p/a", "a", b""), (f"p/{end}", end, b""), ("p/none", "none", None)], "path string, name string, content binary").coalesce(1)
    outcomes = []
    rows = files.parsed(table, parse, "n int", outcomes)
    sizes = {r["source_file"]: r["count"] for r in rows.groupBy("source_file").count().collect()}
    said = {r["path"]: (r["outcome"], r["items"]) for r in outcomes[0].collect()}
    assert sizes == ({"a": 10} if end else {"a": 10, "": 10})
    assert said == {"p/a": ("read", 10), f"p/{end}": ("failed", 0) if end else ("read", 10), "p/none": ("failed", 0)}


def test_small_files_share_batches(spark):
    table = spark.range(500).select(F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("name"), F.lit(b"x").alias("content")).coalesce(1)
    sizes = files.parsed(table, lambda name, content: iter([{"n": 1}]), "n int").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"rows": [b.num_rows]}) for b in bs), "rows long")
    assert sizes.count() < 10


@pytest.mark.parametrize("strict", [False, True])
def test_sidecars_without_and_beside_images(spark, strict):
    rows = [("in/a.png", "A.png", b"-"), ("in/a.ocr.txt", "a.ocr.txt", b"one"), ("in/b.JPG", "b.JPG", b"-"), ("in/c.ocr.txt", "c.ocr.txt", b"two"), ("in/scan_d.txt", "scan_d.txt", b"three"), ("else/a.ocr.txt", "a.ocr.txt", b"four")]
    got = sorted((r["source_file"], r["raw_text"]) for r in files.scan_records(spark.createDataFrame(rows, "path string, name string, content binary"), strict).collect())
    assert got == sorted([("A.png", "one"), ("c.ocr.txt", "two"), ("scan_d.txt", "three"), ("a.ocr.txt", "four"), *([("a.ocr.txt", "one")] if strict else [])])
