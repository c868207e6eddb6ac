"""Text functions as Spark columns: tokens, terms, cross-lingual expansion, language, snippets.

All of them stay in the JVM. Patterns follow Unicode, not ASCII: word characters, white space and digits are spelled
out as classes, since Java's shorthands are narrower.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Letters, numbers and the underscore; and the whole Devanagari block, marks and danda included.
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
#: Where a word begins or ends, for WORD.
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: White space as str.isspace() has it.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: What ends a line in str.splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
DIGIT = r"\p{Nd}"


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row, also where use has it in the lambda of another function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def content_terms(text: Column, stopwords=vocab.STOPWORDS) -> Column:
    """Tokens that are worth a query: two characters or more, no stopword, no number."""
    stop = literals(stopwords)
    return F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~t.rlike(r"^[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+$"))


def expand_terms(text: Column, lexicon=vocab.LEXICON) -> Column:
    """Synonyms of all lexicon terms in the text (words as tokens, phrases as substrings), without those whose lower
    case is a token of the text; in code point order. A phrase is never a token, so it may come back itself."""
    index = vocab.alias_index(lexicon)
    words = [t for t in index if " " not in t]

    def synonyms(low: Column, own: Column) -> Column:
        found = [F.when(F.contains(low, F.lit(p)), literals(index[p])).otherwise(literals(())) for p in index if " " in p]
        if words:
            table = F.create_map(*(x for w in words for x in (F.lit(w), literals(index[w]))))
            # the few tokens that are terms are found by hash first; the map is small
            found.append(F.flatten(F.transform(F.array_intersect(own, literals(words)), lambda t: table[t])))
        every = F.array_distinct(F.flatten(F.array(*found))) if found else literals(())
        return F.array_sort(F.filter(every, lambda a: ~F.array_contains(own, F.lower(a))))

    low = F.lower(F.coalesce(text, F.lit("")))
    return let(F.struct(low.alias("low"), F.array_distinct(tokens(text)).alias("own")), lambda x: synonyms(x["low"], x["own"]))


def alias_text(text: Column, lexicon=vocab.LEXICON) -> Column:
    return F.array_join(expand_terms(text, lexicon), " ")


def with_aliases(text: Column, gap: str = "  ", lexicon=vocab.LEXICON) -> Column:
    """The text and, after the gap, its own aliases; the empty text stays empty."""
    text = F.coalesce(text, F.lit(""))
    aliases = alias_text(text, lexicon)
    return F.when(aliases == "", text).otherwise(F.concat(text, F.lit(gap), aliases))


def detect_language(text: Column, first=("mar", vocab.MARATHI_MARKERS), second=("hin", vocab.HINDI_MARKERS), script: str = r"[\x{0900}-\x{097F}]", latin: str = "eng", least: float = 0.15) -> Column:
    """und without letters of either script; mixed where both have more than ``least`` of them; the script's two
    languages by the number of distinct marker words, ties to the first; else the Latin language."""
    a, b = F.regexp_count(text, F.lit(script)), F.regexp_count(text, F.lit("[A-Za-z]"))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    count = lambda markers: F.size(F.array_intersect(words, literals(markers)))
    in_a, in_b = a > least * (a + b), b > least * (a + b)
    return (
        F.when(text.isNull() | (strip(text) == "") | (a + b == 0), "und")
        .when(in_a & in_b, "mixed")
        .when(in_a, F.when(count(second[1]) > count(first[1]), second[0]).otherwise(first[0]))
        .otherwise(latin)
    )


def snippet(raw_text: Column, title: Column, query: Column, width: int = 220, lexicon=vocab.LEXICON) -> Column:
    """An excerpt of at most ``width`` characters around the earliest place of any query token or alias of two
    characters or more (a plain substring, stopwords too); the title where there is no text."""
    terms = F.filter(F.array_union(tokens(query), expand_terms(query, lexicon)), lambda t: F.length(t) >= 2)

    def excerpt(text: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 1 - width // 3)
        end = F.least(F.length(text), start + width)
        cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(width)), F.when(end < F.length(text), "…").otherwise(""))
        head = F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "…").otherwise(""))
        return F.when(text == "", title).when(at.isNull(), head).otherwise(cut)

    def earliest(low: Column) -> Column:
        return F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0))

    # squeezed and in lower case once, then searched for each term
    placed = let(squeezed(raw_text), lambda text: F.struct(text.alias("text"), let(F.lower(text), earliest).alias("at")))
    return let(placed, lambda x: excerpt(x["text"], x["at"]))


def accent_fold() -> tuple[str, str]:
    """Letters of the Latin blocks up to U+017F with one diacritic, and their lower-case bases."""
    pairs = []
    for code in range(0xC0, 0x180):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn":
            pairs.append((chr(code), parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def index_tokens(text: Column) -> Column:
    """The keyword index's own tokens: runs of letters, numbers and private-use characters, in lower case, Latin
    letters without their accent. Marks, underscores and punctuation separate."""
    old, new = accent_fold()
    text = F.coalesce(text, F.lit(""))
    # few texts hold a combining mark, and looking for one is cheaper than looking behind every character
    whole = F.when(text.rlike(r"[\x{0300}-\x{036F}]"), F.regexp_replace(text, r"(?<=\p{IsLatin})[\x{0300}-\x{036F}]+", "")).otherwise(text)
    plain = F.translate(whole, old, new)
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.lower)
