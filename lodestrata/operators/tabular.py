"""Sheets to records: header detection and row shaping over a grid (source_file, sheet_idx, sheet, row_idx, cells).

row_idx counts from 0. All is native; only the first rows of a sheet take part in header detection, so its windows are
small whatever the sheet's size, and rows meet their header by an equi-join on the sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vocab
from ..functions.records import as_records

SHEET = ("source_file", "sheet_idx")
#: Rows that may be the header, and rows below that are compared with it.
SCAN, BELOW = 6, 4
DATE_LIKE = rf"^{T.SPACE}*{T.DIGIT}{{1,4}}[-/.]{T.DIGIT}{{1,2}}[-/.]{T.DIGIT}{{1,4}}{T.SPACE}*$"
ALL_DIGITS = r"^[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+$"


def header_scores(grid: DataFrame) -> DataFrame:
    """(source_file, sheet_idx, row_idx, score) of the first rows of each sheet.

    Rows with fewer than two filled cells score 0; else 0.4 for the share of filled cells, 0.4 for the share of these
    that look like labels, 0.2 for the share of the next rows that have about as many filled cells.
    """
    filled = F.filter(F.transform("cells", T.strip), lambda c: c != "")
    rows = grid.where(F.col("row_idx") < SCAN + BELOW).select(*SHEET, "row_idx", F.size("cells").alias("width"), filled.alias("filled")).withColumn("n", F.size("filled"))
    ahead = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(1, BELOW)
    rows = rows.withColumn("below", F.collect_list(F.struct("n", "width")).over(ahead)).where(F.col("row_idx") < SCAN)
    label = F.size(F.filter("filled", lambda c: (F.length(c) <= 40) & ~F.regexp_replace(c, "[.-]", "").rlike(ALL_DIGITS)))
    alike = F.size(F.filter("below", lambda b: (b["width"] > 0) & (F.abs(b["n"] - F.col("n")) <= 1)))
    score = F.col("n") / F.col("width") * 0.4 + label / F.col("n") * 0.4 + alike / F.greatest(F.lit(1), F.size("below")) * 0.2
    return rows.select(*SHEET, "row_idx", F.when(F.col("n") < 2, 0.0).otherwise(score).alias("score"))


def detect_headers(grid: DataFrame) -> DataFrame:
    """(source_file, sheet_idx, header_idx): the best score, the earliest of equal ones."""
    best = F.max(F.struct("score", (-F.col("row_idx")).alias("back")))
    return header_scores(grid).groupBy(*SHEET).agg(best.alias("b")).select(*SHEET, (-F.col("b.back")).alias("header_idx"))


def dedupe_headers(cells: Column) -> Column:
    """Stripped names, empty ones as col1, col2 ..., the second and further ones of a name as name_1, name_2 ..."""
    names = F.transform(cells, lambda c, i: F.when(T.strip(c) == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(T.strip(c)))

    def numbered(names: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(names, 1, i), lambda x: x == name))
            return F.when(before > 0, F.concat(name, F.lit("_"), before.cast("string"))).otherwise(name)

        return F.transform(names, one)

    return T.let(names, numbered)


def row_pairs(headers: Column, cells: Column) -> Column:
    """(h, v) of the filled cells, by header; of one header's several values the last one, at the first one's place."""
    every = F.filter(F.transform(headers, lambda h, i: F.struct(h.alias("h"), T.strip(F.coalesce(F.get(cells, i), F.lit(""))).alias("v"))), lambda p: p["v"] != "")

    def merged(every: Column) -> Column:
        first = F.filter(every, lambda p, i: F.size(F.filter(F.slice(every, 1, i), lambda q: q["h"] == p["h"])) == 0)
        return F.transform(first, lambda p: F.struct(p["h"].alias("h"), F.element_at(F.filter(every, lambda q: q["h"] == p["h"]), -1)["v"].alias("v")))

    return T.let(every, merged)


def _holds(header: Column, hints) -> Column:
    low = F.lower(header)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in hints])


def explicit_category(pairs: Column, columns=vocab.CATEGORY_COLUMNS, taxonomy=vocab.TAXONOMY) -> Column:
    """The taxonomy's name for the first value, in column order, of a category column that is such a name; else null."""
    names = F.create_map(*(F.lit(x) for t in taxonomy for x in (t.lower(), t)))
    values = F.transform(F.filter(pairs, lambda p: _holds(p["h"], columns)), lambda p: F.try_element_at(names, F.lower(T.strip(p["v"]))))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def pick_fields(pairs: Column, hints) -> Column:
    """Values of all columns whose lower-cased header holds a hint, two spaces between."""
    return F.array_join(F.transform(F.filter(pairs, lambda p: _holds(p["h"], hints)), lambda p: p["v"]), "  ")


def pick_title(pairs: Column, preferred=vocab.TITLE_COLUMNS) -> Column:
    """The first column of the most preferred hint that any header holds; else the first value of over three characters
    that is no number and no date; else the first value. Headers that differ in case only share the last one's value."""
    low = F.transform(pairs, lambda p: F.struct(F.lower(p["h"]).alias("h"), p["v"].alias("v")))

    def by_hint(hint: str) -> Column:
        name = F.get(F.filter(low, lambda p: F.contains(p["h"], F.lit(hint))), F.lit(0))["h"]
        return F.try_element_at(F.filter(low, lambda p: p["h"] == name), F.lit(-1))["v"]

    plain = F.get(F.filter(pairs, lambda p: (F.length(p["v"]) > 3) & ~p["v"].rlike(ALL_DIGITS) & ~p["v"].rlike(DATE_LIKE)), F.lit(0))["v"]
    return F.coalesce(*map(by_hint, preferred), plain, F.get(pairs, F.lit(0))["v"])


def shape_rows(grid: DataFrame, source_type: Column | None = None) -> DataFrame:
    """A record for each filled row below its sheet's header, with sheet_idx and row_idx beside the record's fields."""
    heads = detect_headers(grid)
    picked = grid.join(heads, list(SHEET)).where(F.col("row_idx") == F.col("header_idx")).select(*SHEET, "header_idx", dedupe_headers(F.col("cells")).alias("headers"))
    rows = grid.join(picked, list(SHEET)).where(F.col("row_idx") > F.col("header_idx"))
    rows = rows.withColumn("pairs", row_pairs(F.col("headers"), F.col("cells"))).where(F.size("pairs") > 0)
    body = F.array_join(F.transform("pairs", lambda p: F.concat(p["h"], F.lit(": "), p["v"])), "\n")
    columns = F.map_from_entries("pairs")
    none = F.lit(None).cast("string")
    shaped = rows.select(
        *SHEET,
        "row_idx",
        pick_title(F.col("pairs")).alias("title"),
        body.alias("raw_text"),
        "sheet",
        F.concat(F.lit("row "), (F.col("row_idx") + 1).cast("string")).alias("row_or_page"),
        (source_type if source_type is not None else sheet_type(F.col("source_file"))).alias("source_type"),
        F.coalesce(explicit_category(F.col("pairs")), F.lit(vocab.UNCATEGORISED)).alias("category"),
        pick_fields(F.col("pairs"), vocab.RECIPIENT_COLUMNS).alias("recipient"),
        pick_fields(F.col("pairs"), vocab.SUBJECT_COLUMNS).alias("key_fields"),
        F.struct(columns.alias("columns"), none.alias("ocr_engine"), none.alias("extractor"), F.lit(None).cast("boolean").alias("has_notes"), none.alias("origin_id"), none.alias("origin_modified")).alias("extra"),
    )
    return shaped


def sheet_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(_any(low, "letter", "correspond", "register"), "letter").when(_any(low, "minute"), "minutes").otherwise("tracker")


def _any(low: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def content_key(columns: Column) -> Column:
    """Sorted values of ten characters or more, squeezed and in lower case; null where a row has none."""
    values = F.array_sort(F.filter(F.transform(F.map_values(columns), lambda v: F.lower(T.squeezed(v))), lambda v: F.length(v) >= 10))
    return F.when(F.size(values) > 0, values)


def drop_near_duplicates(shaped: DataFrame) -> DataFrame:
    """Of one file's rows with equal content keys the first, in sheet and row order; rows without a key all stay."""
    keyed = shaped.withColumn("_key", content_key(F.col("extra.columns")))
    first = keyed.where("_key is not null").groupBy("source_file", "_key").agg(F.min(F.struct("sheet_idx", "row_idx")).alias("_at"))
    kept = keyed.join(first, ["source_file", "_key"], "left").where(F.col("_at").isNull() | (F.col("_at") == F.struct("sheet_idx", "row_idx")))
    return kept.select(*shaped.columns)


def sheet_records(grid: DataFrame, workbook: bool = False) -> DataFrame:
    """Records of all sheets; workbooks drop empty sheets and near-duplicate rows."""
    if not workbook:
        return as_records(shape_rows(grid))
    filled = grid.where(F.exists("cells", lambda c: c != "")).select(*SHEET).distinct()
    return as_records(drop_near_duplicates(shape_rows(grid.join(filled, list(SHEET), "left_semi"))))
