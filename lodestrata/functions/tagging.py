"""Rule tags as Spark columns: dates, departments, categories, places, people. One projection, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vocab

_D = T.DIGIT
_E = T.EDGE
_S = T.SPACE
YEAR_FIRST = rf"{_E}({_D}{{4}})[-/]({_D}{{1,2}})[-/]({_D}{{1,2}}){_E}"
DAY_FIRST = rf"{_E}({_D}{{1,2}})[-/.]({_D}{{1,2}})[-/.]({_D}{{4}}){_E}"
IN_WORDS = rf"{_E}({_D}{{1,2}}){_S}+([A-Za-z]{{3,9}})\.?{_S}+({_D}{{4}}){_E}|{_E}([A-Za-z]{{3,9}})\.?{_S}+({_D}{{1,2}}),?{_S}+({_D}{{4}}){_E}"
# Titles that begin a person's or office's name.
TITLES = ("Hon'?ble", "Shri", r"Smt\.?", r"Dr\.?", r"Mr\.?", r"Ms\.?", "President", "Governor", "Prime Minister", "Chief Minister", "Minister", "Secretary")
_NAME = r"[A-Z][\p{L}\p{N}_.'-]+"
ENTITY = rf"{_E}(?:{'|'.join(TITLES)}){_S}+{_NAME}(?:{_S}+{_NAME})*"


def _number(digits: Column) -> Column:
    """Digits of any of the scripts in use, as an int."""
    return F.translate(digits, "०१२३४५६७८९", "0123456789").try_cast("int")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd where each part is in its range (1900 to 2100, 1 to 12, 1 to 31), whatever the calendar says; else null."""
    sound = year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)
    return F.when(sound, F.format_string("%04d-%02d-%02d", year, month, day))


def parse_date(text: Column) -> Column:
    """The date of the first year-first match, else of the first day-first match, else of the first match in words. A
    match out of range, or with an unknown month, is null and ends the search."""

    def groups(pattern: str, *which: int) -> list[Column]:
        return [F.regexp_extract(text, pattern, k) for k in which]

    y1, m1, d1 = map(_number, groups(YEAR_FIRST, 1, 2, 3))
    d2, m2, y2 = map(_number, groups(DAY_FIRST, 1, 2, 3))
    da, ma, ya, mb, db, yb = groups(IN_WORDS, 1, 2, 3, 4, 5, 6)
    months = F.create_map(*(F.lit(x) for item in vocab.month_numbers().items() for x in item))
    month = F.try_element_at(months, F.lower(F.when(da != "", ma).otherwise(mb)))
    words = iso_date(_number(F.when(da != "", ya).otherwise(yb)), month, _number(F.when(da != "", da).otherwise(db)))
    return F.when(text.rlike(YEAR_FIRST), iso_date(y1, m1, d1)).when(text.rlike(DAY_FIRST), iso_date(y2, m2, d2)).when(text.rlike(IN_WORDS), words)


def _first_of(low: Column, choices: list[tuple[str, str]]) -> Column:
    """Label of the first substring that occurs."""
    start = F.when(F.contains(low, F.lit(choices[0][0])), choices[0][1])
    return reduce(lambda acc, c: acc.when(F.contains(low, F.lit(c[0])), c[1]), choices[1:], start)


def infer_department(text: Column, departments=vocab.DEPARTMENTS, shorthands=vocab.DEPARTMENT_SHORTHANDS) -> Column:
    return _first_of(F.lower(F.coalesce(text, F.lit(""))), [*((d.lower(), d) for d in departments), *shorthands])


def infer_category(text: Column, hint: Column | None = None, hints=vocab.CATEGORY_HINTS, default: str = vocab.UNCATEGORISED) -> Column:
    hay = F.lower(F.concat(F.coalesce(hint, F.lit("")) if hint is not None else F.lit(""), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.coalesce(_first_of(hay, [(t.lower(), c) for c, triggers in hints.items() for t in triggers]), F.lit(default))


def extract_locations(text: Column, places=vocab.PLACES) -> Column:
    """Places that are substrings of the text, case and all, in the gazetteer's order."""
    return F.filter(T.literals(places), lambda p: F.contains(F.coalesce(text, F.lit("")), p))


def distinct_texts(items: Column) -> Column:
    """Without empty ones and repeats, first places kept."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def extract_entities(text: Column) -> Column:
    return distinct_texts(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)), T.strip))


def tag(records: DataFrame, hint: str | None = None) -> DataFrame:
    """Fills the tag fields of records: date, department, location, entities where empty, category where it is
    Uncategorised and the record is no letter, language and alias_text always."""
    basis = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("raw_text", F.lit("")))
    unknown = F.coalesce(F.col("category"), F.lit(vocab.UNCATEGORISED)) == vocab.UNCATEGORISED
    category = infer_category(basis, F.col(hint) if hint else None)
    return records.withColumns(
        {
            "date": F.when(F.coalesce("date", F.lit("")) != "", F.col("date")).otherwise(parse_date(basis)),
            "language": T.detect_language(basis),
            "department": F.when(F.coalesce("department", F.lit("")) != "", F.col("department")).otherwise(infer_department(basis)),
            "category": F.when(unknown & (F.col("source_type") != "letter"), category).otherwise(F.coalesce("category", F.lit(vocab.UNCATEGORISED))),
            "location": F.when(F.size("location") > 0, F.col("location")).otherwise(extract_locations(basis)),
            "entities": F.when(F.size("entities") > 0, F.col("entities")).otherwise(extract_entities(basis)),
            "alias_text": T.alias_text(basis),
        }
    )


