"""The record: its schema, identity and derived texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRA = "struct<columns: map<string, string>, ocr_engine: string, extractor: string, has_notes: boolean, origin_id: string, origin_modified: string>"
#: Fields and their types, in order.
TYPES = {
    "title": "string", "raw_text": "string", "source_file": "string", "sheet": "string", "row_or_page": "string", "source_type": "string", "date": "string", "language": "string",
    "department": "string", "category": "string", "location": "array<string>", "entities": "array<string>", "alias_text": "string", "recipient": "string", "key_fields": "string",
    "extra": EXTRA, "id": "string",
}


def record_id(source_file: Column, sheet: Column, row_or_page: Column, title: Column) -> Column:
    """First 16 hex digits of the SHA-1 of file, sheet, place and title; a null counts as the word None."""
    parts = [F.coalesce(c, F.lit("None")) for c in (source_file, sheet, row_or_page, title)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def provenance(source_file: Column, sheet: Column, row_or_page: Column) -> Column:
    named = F.when(sheet != "", F.concat(F.lit("sheet '"), sheet, F.lit("'")))
    return F.concat_ws(" · ", source_file, named, F.when(row_or_page != "", row_or_page))


def search_text(title: Column, raw_text: Column, alias_text: Column, location: Column, entities: Column) -> Column:
    """All that is searched: the fields that aren't empty, each place and each entity, one a line."""
    empty = F.array().cast("array<string>")
    parts = F.concat(F.array(title, raw_text, alias_text), F.coalesce(location, empty), F.coalesce(entities, empty))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def as_records(rows: DataFrame) -> DataFrame:
    """All fields of the record, with defaults for those that rows don't have, and the id."""
    defaults = {"source_type": F.lit("unknown"), "language": F.lit("und"), "category": F.lit("Uncategorised"), "alias_text": F.lit(""), "recipient": F.lit(""), "key_fields": F.lit(""), "location": F.array(), "entities": F.array()}
    have = set(rows.columns)
    cols = {c: (F.col(c) if c in have else defaults.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in TYPES.items() if c != "id"}
    out = rows.select(*cols.values())
    return out.withColumn("id", record_id(F.col("source_file"), F.col("sheet"), F.col("row_or_page"), F.col("title")))


def to_json(*columns: str) -> Column:
    """One JSON object, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str) -> Column:
    """The schema's fields; unknown ones are dropped."""
    return F.from_json(text, schema)
