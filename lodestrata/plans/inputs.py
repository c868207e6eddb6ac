"""The test tables as records, grids, texts and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.records import as_records
from ..session import ship_package, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for queries that work hard on each row."""
    return spread(table(spark, sf_dir, name))


def first_line(text: Column) -> Column:
    return F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 120)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: source as file, language as sheet, ``doc N`` as place; key fields hold the language."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", first_line(text).alias("title"), text.alias("raw_text"), F.col("source").alias("source_file"), F.col("lang").alias("sheet"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("row_or_page"), F.lit("report").alias("source_type"), F.col("source").alias("recipient"), F.col("lang").alias("key_fields"),
    )
    return as_records(rows)


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, txt): a date in one of six notations, or one of two texts without a valid date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd.MM.yyyy", "d MMMM yyyy", "MMM d, yyyy")
    text = F.when(k == 6, "2025-13-40 then 14-06-2025").when(k == 7, "12 apples 2025")
    for i, f in enumerate(formats):
        text = text.when(k == i, F.concat(F.lit("placed on "), F.date_format(d, f), F.lit(" by phone")))
    return texts(spark, sf_dir, "orders").select("o_orderkey", text.alias("txt"))


def customer_grid(spark: SparkSession, sf_dir: str, sheets: int = 1) -> DataFrame:
    """One file for each nation's customers. By the nation's number the header has up to four rows above it (a title, an
    empty row, figures), one name twice or not, a blank name; of the customers some rows are empty and some cells blank,
    padded, numbers or dates. A second sheet repeats every other customer, written and numbered otherwise."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("n"), "c_name", "c_mktsegment")
    kind = F.when(F.col("n") % 3 == 0, "register").when(F.col("n") % 3 == 1, "minutes").otherwise("sheet")
    c = c.withColumn("source_file", F.concat(kind, F.lit("_"), F.col("n").cast("string"), F.lit(".csv")))
    k, above = F.col("c_custkey"), F.col("n") % 5
    row = lambda *values: F.array(*(F.lit(v) if isinstance(v, str) else v for v in values))
    blank = row("", "", "", "", "", "")
    person = lambda name: F.when(k % 13 == 0, blank).otherwise(
        row(k.cast("string"), F.when(k % 7 == 0, "  ").otherwise(name), F.when(k % 5 == 0, " war ROOM ").otherwise(F.col("c_mktsegment")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Account  of "), F.floor(k / 3).cast("string"))), F.when(k % 6 == 0, "x").otherwise(""), F.when(k % 3 == 0, "1/2/2024").otherwise(""))
    )
    place = above + F.row_number().over(Window.partitionBy("source_file").orderBy("c_custkey")) - 1
    files = c.select("source_file", "n").distinct()
    i = F.col("row_idx")
    figure = F.when((i + F.col("n")) % 3 == 0, row("Customer list", "", "", "", "", "")).when((i + F.col("n")) % 3 == 1, blank).otherwise(row("2024", "15.03", " 7 ", "", "", ""))
    top = files.select("source_file", "n", F.explode(F.sequence(F.lit(0), above)).alias("row_idx"))
    header = row("Sr", " Name ", "Type", F.when(F.col("n") % 2 == 0, "Name").otherwise("Subject"), "", "Date")
    top = top.select("source_file", "row_idx", F.when(i == above, header).otherwise(figure).alias("cells"))

    def sheet(number: int, name: str, rows: DataFrame) -> DataFrame:
        every = top.unionByName(rows)
        return every.select("source_file", F.lit(number).alias("sheet_idx"), F.lit(name).alias("sheet"), "row_idx", "cells")

    one = sheet(0, "first", c.select("source_file", (place + 1).alias("row_idx"), person(F.col("c_name")).alias("cells")))
    if sheets == 1:
        return one
    other = F.concat(F.lit("  "), F.lower(F.regexp_replace("c_name", "#", " # ")))
    again = c.where("c_custkey % 2 = 0").select("source_file", (place + 1).alias("row_idx"), person(F.when(k % 10 == 0, other).otherwise(F.upper("c_name"))).alias("cells"))
    return one.unionByName(sheet(1, "second", again))


def grid_files(grid: DataFrame) -> DataFrame:
    """(path, name, content): each sheet of a grid as the CSV file it may have come from, all cells quoted."""
    line = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    lines = grid.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("x"))
    content = F.encode(F.array_join(F.transform("x", lambda r: r["line"]), "\r\n"), "UTF-8")
    return lines.select(F.col("source_file").alias("path"), F.col("source_file").alias("name"), content.alias("content"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, content): documents as Markdown with a heading, as scans' texts, as files of an unknown kind, and as
    minutes without a heading, by their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    name = F.when(kind == 0, F.concat(F.lit("plan_"), k, F.lit(".md"))).when(kind == 1, F.concat(F.lit("scan_"), k, F.lit(".txt")))
    name = name.when(kind == 2, F.concat(F.lit("log_"), k, F.lit(".bin"))).otherwise(F.concat(F.lit("meeting_"), k, F.lit(".txt")))
    plain = F.replace("text", F.lit("#"), F.lit("+"))
    text = F.when(kind == 0, F.concat(F.lit("# T"), k, F.lit("\n"), plain)).when(kind == 3, plain).otherwise(F.col("text"))
    return d.select(name.alias("path"), name.alias("name"), F.encode(text, "UTF-8").alias("content"))


#: Characters that XML doesn't hold, and those beyond the basic plane; plans/oracle.py reads it from here too.
NO_XML = r"[^\x{20}-\x{7E}\n\x{A0}-\x{D7FF}]"


def _in_order(rows: pa.Table, *by: str) -> Iterator[dict]:
    """Rows in order. They stay packed until their turn: a workbook of all rows of a group may be large."""
    order = pc.sort_indices(rows.select(by), sort_keys=[(c, "ascending") for c in by])
    for at in range(0, len(order), 1000):
        yield from rows.take(order.slice(at, 1000)).to_pylist()


def workbooks(grid: DataFrame) -> DataFrame:
    """(path, name, content): a grid's files as workbooks."""
    from . import office

    def build(table: pa.Table) -> pa.Table:
        rows = _in_order(table, "sheet_idx", "row_idx")
        sheets = ((name, ((r["row_idx"], r["cells"]) for r in own)) for (_, name), own in groupby(rows, lambda r: (r["sheet_idx"], r["sheet"])))
        blank = ("blank", [(0, ["", " "])])  # holds nothing, so it gives no record
        name = table.column("source_file")[0].as_py().replace(".csv", ".xlsx")
        return pa.table({"path": [name], "name": [name], "content": pa.array([office.workbook(chain(sheets, [blank]))], pa.binary())})

    ship_package(grid.sparkSession)
    return grid.groupBy("source_file").applyInArrow(build, "path string, name string, content binary")


def office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, content): documents as text files of a word processor, with a heading before or after their first
    line, and as decks of one slide, every other one with notes, by their number."""
    from . import office

    text = F.regexp_replace(F.coalesce("text", F.lit("")), NO_XML, " ")
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents = [], []
            for k, own in zip(b.column("doc_id").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if k % 2:
                    names.append(f"deck_{k}.pptx")
                    contents.append(office.deck([(f"T{k}", own, f"n{k}" if k % 4 == 1 else "")]))
                else:
                    names.append(f"letter_{k}.docx" if k % 4 else f"text_{k}.docx")
                    at = k % 4 // 2
                    paragraphs = [(False, x) for x in own]
                    contents.append(office.document([*paragraphs[:at], (True, f"H{k}"), *paragraphs[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array(contents, pa.binary())], ["path", "name", "content"])

    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).mapInArrow(build, "path string, name string, content binary")


def order_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, content): the orders of each of 50 groups of customers as a workbook of numbers, dates with and
    without a time of day, truth values and texts."""
    from . import office

    def build(t: pa.Table) -> pa.Table:
        cells = ([r["k"], r["price"], (float(r["day"]) if r["k"] % 2 else r["day"] + 0.5,), r["status"] == "O", r["status"]] for r in _in_order(t, "k"))
        name = f"orders_{t.column('part')[0].as_py()}.xlsx"
        return pa.table({"path": [name], "name": [name], "content": pa.array([office.workbook([("orders", enumerate(cells))])], pa.binary())})

    ship_package(spark)
    orders = table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    rows = orders.select((F.col("o_custkey") % 50).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), day.alias("day"), F.col("o_orderstatus").alias("status"))
    return rows.groupBy("part").applyInArrow(build, "path string, name string, content binary")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, content): documents as images with their text in a sidecar beside them, images without one, and
    sidecars without an image, by their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    image = F.struct(F.concat(F.lit("photo_"), k, F.when(kind == 0, ".png").otherwise(".JPG")).alias("name"), F.lit("no image").cast("binary").alias("content"))
    sidecar = F.struct(F.concat(F.lit("photo_"), k, F.lit(".ocr.txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    files = d.select(F.explode(F.when(kind == 3, F.array(sidecar)).when(kind == 2, F.array(image)).otherwise(F.array(image, sidecar))).alias("f"))
    return files.select(F.concat(F.lit("in/"), F.col("f.name")).alias("path"), "f.*")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, concept, rank): of each benchmark text the first two words and the next two as a phrase."""
    w = T.tokens(F.col("text"))
    terms = F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.concat(F.get(w, F.lit(2)), F.lit(" "), F.get(w, F.lit(3))))
    return table(spark, sf_dir, "benchmark").select(F.explode(terms).alias("term"), F.col("item_id").alias("concept"), F.col("item_id").alias("rank")).where("term is not null")


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, content): documents under names of formats that they aren't, and empty ones, by their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    k, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    name = F.when(kind == 0, F.concat(F.lit("a_"), k, F.lit(".md")))
    for i, end in enumerate((".docx", ".xlsx", ".pptx", ".pdf", ".csv"), 1):
        name = name.when(kind == i, F.concat(F.lit("a_"), k, F.lit(end)))
    content = F.when(kind == 5, F.lit("").cast("binary")).otherwise(F.concat(F.lit("x").cast("binary"), "content"))
    return d.select(name.alias("path"), name.alias("name"), content.alias("content"))


#: Phrases that tag_texts picks from, by the customer's number; plans/oracle.py reads them from here too.
TAG_PHRASES = (
    ("the cabinet met", "war room review of data centre", "Conference on water supply", "nothing else", "a district dataset"),
    ("in Pune and Mumbai", "at New Delhi", "", "मुंबई बैठक"),
    ("on 2025-03-09", "dated 5 March 2024", "13-14-2025", "", "Apr 7, 2023", "1999/12/31 then 2024-01-01"),
    ("for the Home department", "by GAD", "", "Chief Minister's Office and Finance", "cmo", "", "Rural Development"),
)


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer: phrases with a topic, places, a date and a department in all combinations, a person."""
    c = texts(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    parts = [F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int")) for x in TAG_PHRASES]
    text = F.concat_ws(" ", *parts, F.concat(F.lit("with Shri Ab"), k.cast("string")))
    kind = F.when(k % 3 == 0, "letter").otherwise("report")
    return as_records(c.select(F.concat(F.lit("note "), k.cast("string")).alias("title"), text.alias("raw_text"), F.lit("notes.csv").alias("source_file"), k.cast("string").alias("row_or_page"), kind.alias("source_type"), F.element_at(F.array(*map(F.lit, TAG_PHRASES[0])), (k % 5 + 1).cast("int")).alias("recipient")))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests of pages: by the page's number some files are new, some gone, some changed."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("size")).withColumn("path", F.concat("path", F.lit("#"), F.col("page_id").cast("string")))
    old = p.where("page_id % 7 != 0").select("path", "size", F.lit(1).cast("bigint").alias("mtime"))
    new = p.where("page_id % 5 != 0").select("path", "size", F.when(F.col("page_id") % 3 == 0, 2).otherwise(1).cast("bigint").alias("mtime"))
    return old, new
