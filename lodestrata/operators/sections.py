"""Documents to sections, native: each document is one row, and its sections come from array functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = rf"^(#{{1,2}}){T.SPACE}+(.*)$"


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def _titled(title: Column, body: Column) -> Column:
    return T.strip(F.concat(title, F.lit("\n"), body))


def markdown_sections(files: DataFrame, name: str = "source_file", text: str = "text") -> DataFrame:
    """(name, title, raw_text, row_or_page) for each section under a first- or second-level heading.

    Every heading counts, also those without a body, which make no section; what stands before the first heading is
    section 0 under the file's stem. A file without any section is one record, its whole text on page 1.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), T.LINE_END)
    rows = files.select(F.col(name), F.col(text).alias("_text"), stem(F.col(name)).alias("_stem"), lines.alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"))), lambda h: h["line"].rlike(HEADING))
    rows = rows.withColumn("_heads", F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("line"))), heads))

    def section(h: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("_heads"), k + 1)["at"], F.size("_lines") + 1)
        title = F.when(k == 0, F.col("_stem")).otherwise(F.regexp_extract(h["line"], HEADING, 2))
        body = T.strip(F.array_join(F.slice("_lines", h["at"] + 1, after - h["at"] - 1), "\n"))
        return F.struct(k.alias("n"), title.alias("title"), body.alias("body"))

    found = F.filter(F.transform("_heads", section), lambda s: s["body"] != "")
    # a file without sections is a null: a test of found beside it would make all sections twice
    out = rows.select(name, "_text", "_stem", F.explode_outer(found).alias("s"))
    title = F.when(T.strip(F.col("s.title")) == "", F.col("s.title")).otherwise(T.strip(F.col("s.title")))
    single = F.col("s").isNull()
    return out.select(
        name,
        F.when(single, F.col("_stem")).otherwise(title).alias("title"),
        F.when(single, F.coalesce("_text", F.lit(""))).otherwise(_titled(F.col("s.title"), F.col("s.body"))).alias("raw_text"),
        F.when(single, "page 1").otherwise(F.concat(F.lit("section "), F.col("s.n").cast("string"))).alias("row_or_page"),
    )


def budget_chunks(paragraphs: Column, budget: int = 1500) -> Column:
    """Paragraphs in groups: a group ends with the paragraph that brings it to the budget or beyond. Bodies of the
    groups, stripped, empty ones left out."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"), F.lit(False).alias("any"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["any"], F.concat(acc["open"], F.lit("\n"), p)).otherwise(p)
        size = acc["size"] + F.length(p)
        full = size >= budget
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"),
            F.when(full, "").otherwise(joined).alias("open"),
            F.when(full, 0).otherwise(size).alias("size"),
            (~full).alias("any"),
        )

    every = F.aggregate(paragraphs, empty, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.filter(F.transform(every, T.strip), lambda b: b != "")


def block_sections(files: DataFrame, name: str = "source_file", budget: int = 1500) -> DataFrame:
    """Sections of (name, blocks array<struct<is_heading boolean, text string>>), as markdown_sections has them; files
    without headings become chunks (``part n``) of about ``budget`` characters. Titles have 120 characters at most."""
    rows = files.select(name, "blocks", stem(F.col(name)).alias("_stem"))
    headed = F.exists("blocks", lambda b: b["is_heading"])
    heads = F.filter(F.transform("blocks", lambda b, i: F.struct((i + 1).alias("at"), b["text"].alias("line"), b["is_heading"].alias("is"))), lambda h: h["is"])
    heads = F.transform(heads, lambda h: F.struct(h["at"].alias("at"), h["line"].alias("line")))
    rows = rows.withColumn("_headed", headed).withColumn("_heads", F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("_stem").alias("line"))), heads))

    def section(h: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("_heads"), k + 1)["at"], F.size("blocks") + 1)
        body = T.strip(F.array_join(F.transform(F.slice("blocks", h["at"] + 1, after - h["at"] - 1), lambda b: b["text"]), "\n"))
        return F.struct(k.alias("n"), h["line"].alias("title"), body.alias("body"))

    sections = F.filter(F.transform("_heads", section), lambda s: s["body"] != "")
    parts = F.transform(budget_chunks(F.transform("blocks", lambda b: b["text"]), budget), lambda b, i: F.struct(i.alias("n"), F.when(i > 0, F.concat("_stem", F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise(F.col("_stem")).alias("title"), b.alias("body")))
    out = rows.select(name, "_headed", F.explode(F.when(F.col("_headed"), sections).otherwise(parts)).alias("s"))
    return out.select(
        name,
        F.when(F.col("_headed"), F.substring("s.title", 1, 120)).otherwise(F.col("s.title")).alias("title"),
        F.when(F.col("_headed"), _titled(F.col("s.title"), F.col("s.body"))).otherwise(F.col("s.body")).alias("raw_text"),
        F.when(F.col("_headed"), F.concat(F.lit("section "), F.col("s.n").cast("string"))).otherwise(F.concat(F.lit("part "), (F.col("s.n") + 1).cast("string"))).alias("row_or_page"),
    )
