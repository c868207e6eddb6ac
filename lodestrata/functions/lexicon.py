"""Lexicons that are tables: all terms of one in a text by one pass of an automaton, however many there are.

The functions in text.py and tagging.py write each term into the plan, which is right for the few fixed ones. Here terms
come from a DataFrame ("add a row, gain a synonym"). They go to the tasks in blocks of at most BLOCK terms; each block is
an Aho-Corasick automaton, built once in each Python worker, that reads a text once. Words that only count as whole tokens
are looked up among the text's tokens instead, so their many occurrences within other words are never seen.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Terms of one automaton.
BLOCK = 500_000
#: A token, see text.TOKEN.
TOKEN = re.compile(r"[\wऀ-ॿ]+")

_built: dict[str, object] = {}


def _automaton(key: str, terms: list):
    """The automaton of a block of (term, values), which a worker builds once."""
    if key not in _built:
        import ahocorasick

        while len(_built) > 3:  # of earlier queries
            _built.pop(next(iter(_built)))
        made = ahocorasick.Automaton()
        for term, values in terms:
            made.add_word(term, (term, values))
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _finder(shared):
    """A UDF from texts to the values of all of a block's terms in them: of words that count as whole tokens, and of terms
    that count anywhere."""
    key = uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        words, terms = shared.value
        found, out = _automaton(key, terms) if terms else None, []
        for text in column.to_pylist():
            hits = {t: words[t] for t in words.keys() & set(TOKEN.findall(text))} if text and words else {}
            if text and found:
                hits.update(v for _, v in found.iter(text))
            out.append(list(dict.fromkeys(x for v in hits.values() for x in v)))
        return pa.array(out, pa.list_(pa.string()))

    return run


def _matches(lexicon: DataFrame, term: str, value: str, whole: bool = False) -> Callable[[Column], Column]:
    """A function from a text column to the values (strings) of all terms in it, without repeats. whole: terms without a
    space count as whole tokens only."""
    spark = lexicon.sparkSession
    ship_package(spark)
    blocks = max(1, -(-lexicon.count() // BLOCK))
    finders = []
    for b in range(blocks):
        own = lexicon if blocks == 1 else lexicon.where(F.pmod(F.xxhash64(term), F.lit(blocks)) == b)
        grouped: dict[str, list[str]] = {}
        for r in own.where(F.col(term) != "").select(term, value).collect():  # about BLOCK rows
            grouped.setdefault(r[0], []).append(r[1])
        words = {t: v for t, v in grouped.items() if whole and " " not in t}
        terms = sorted((t, v) for t, v in grouped.items() if t not in words)
        finders.append(_finder(spark.sparkContext.broadcast((words, terms))))
    return lambda text: F.array_distinct(F.concat(*(f(text) for f in finders)))


def places(df: DataFrame, text: str, gazetteer: DataFrame, out: str = "places") -> DataFrame:
    """tagging.extract_locations for a table (place, rank bigint): places that are substrings, case and all, by rank."""
    found = _matches(gazetteer.withColumn("_", F.concat(F.lpad(F.col("rank").cast("string"), 19, "0"), F.lit(" "), "place")), "place", "_")
    return df.withColumn(out, F.transform(F.array_sort(found(F.coalesce(F.col(text), F.lit("")))), lambda x: F.substring(x, 21, 2**31 - 1)))


def category(df: DataFrame, text: str, hints: DataFrame, out: str = "category", default: str = "Uncategorised") -> DataFrame:
    """tagging.infer_category for a table (trigger, category, rank bigint): the category of the first trigger, by rank,
    that is a substring of the lower-cased text."""
    keyed = hints.select(F.lower("trigger").alias("trigger"), F.concat(F.lpad(F.col("rank").cast("string"), 19, "0"), F.lit(" "), "category").alias("_"))
    found = F.array_min(_matches(keyed, "trigger", "_")(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return df.withColumn(out, F.coalesce(F.substring(found, 21, 2**31 - 1), F.lit(default)))


def synonyms(df: DataFrame, text: str, lexicon: DataFrame, out: str = "aliases") -> DataFrame:
    """text.expand_terms for a table (term, concept): all terms of each concept that the text names, words as whole tokens
    and phrases as substrings, without those whose lower case is a token of the text; in code point order."""
    called, member = lexicon.select(F.lower("term").alias("term"), "concept"), lexicon.select(F.col("term").alias("member"), "concept")
    # each word also gives itself, so that it is known which members are tokens of the text
    own = called.where(~F.contains("term", F.lit(" "))).select("term", F.concat(F.lit("token "), "term").alias("_"))
    low = F.lower("member")
    pairs = called.join(member, "concept").select("term", F.concat(F.lit("alias "), F.lpad(F.length(low).cast("string"), LENGTH, "0"), low, "member").alias("_")).union(own).distinct()
    found = _matches(pairs, "term", "_", whole=True)(F.lower(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn(out, F.arrow_udf(_without_tokens, "array<string>")(found))


#: Digits of the length of an alias's lower case, which stands between "alias " and the alias.
LENGTH = 10


def _without_tokens(column: pa.Array) -> pa.Array:
    """The aliases among what synonyms() finds, in code point order, without those whose lower case is a token."""
    out, first = [], len("alias ") + LENGTH
    for found in column.to_pylist():
        tokens, kept = {x[6:] for x in found if x.startswith("token ")}, set()
        for x in found:
            if x.startswith("alias "):
                at = first + int(x[6:first])
                if x[first:at] not in tokens:
                    kept.add(x[at:])
        out.append(sorted(kept))
    return pa.array(out, pa.list_(pa.string()))
