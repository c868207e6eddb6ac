"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Besides, transducers rewrite what disguises an identifier
(homoglyphs and full-width forms, invisible characters, "at"/"dot" in brackets or words, spelled digits) and keep for
each character of the rewritten text where it comes from; identifiers found there are mapped back to spans of the
source. A disguised span is added only where no plain span of its kind overlaps it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import back, for_arrow, pieces, schema_of, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's place in KINDS, start, end

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ANY_DIGIT = re.compile(r"[0-9]")

# Letters and digits that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits in words, in the four languages of the tables.
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    "oh": "0",
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
}
#: So many spelled digits, in a row or with numerals between them, are taken for a number.
SPELLED = 3

ODD = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *INVISIBLE])) + "\uff01-\uff5e\U0001d400-\U0001d7ff]|(?![0-9])\\d")
# How the four languages call the sign, and references that HTML has for the marks in identifiers.
_AT = "(?:at|arroba|arobase|klammeraffe)"
REFERENCES = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "lowbar": "_"}
REFERENCE = re.compile(rf"&(?:#(?:([0-9]{{2,3}})|x([0-9a-f]{{2}}))|({'|'.join(REFERENCES)}));", re.I)
#: Four numerals with a spaced dot between each two.
SPACED_DOTS = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s+\.\s+[0-9]{1,3}){3}(?!\w)")
WHITE = re.compile(r"\s+")
BRACKETS = re.compile(rf"[\[({{<]\s*(?:({_AT}|@)|(dot|punkt|punto|point|\.))\s*[\])}}>]", re.I)
_DOT = "(?:dot|punkt|punto|point)"
PLAIN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(\s+{_AT}\s+|\s*@\s*)[A-Za-z0-9-]+((?:(?:\s+(?:{_DOT}|\.)\s+|\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.I)
#: An address whose "at" and dots stand between underscores or hyphens.
JOINED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:(?![_-]at[_-])[A-Za-z0-9._%+-])*([_-]at[_-])(?:(?![_-]dot[_-])[A-Za-z0-9-])+(?:[_-]dot[_-](?:(?![_-]dot[_-])[A-Za-z0-9-])+)+", re.I)
JOINED_DOT = re.compile(r"[_-]dot[_-]", re.I)
PLAIN_LABEL = re.compile(rf"(\s+(?:{_DOT}|\.)\s+|\.)([A-Za-z0-9-]+)", re.I)
DOT_WORD = re.compile(_DOT)
_WORDS = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
TIMES = {"double": 2, "triple": 3}
_DIGIT = rf"(?:(?:(?:{'|'.join(TIMES)})[\s-]+)?(?:{_WORDS})|[0-9])"
#: A spelled digit, once or several times, or a numeral.
_PART = rf"(?:(?:(?:{'|'.join(TIMES)})[\s-]+)?(?:{_WORDS})|[0-9]{{1,16}})"
NUMBER = re.compile(rf"(?<![^\W_])(?:plus[\s,-]+|\+\s*)?{_PART}(?:(?:[\s,-]+(?:dot|punkt|point|punto)[\s,-]+|[\s,.-]+){_PART}){{{SPELLED - 1},}}(?![^\W_])", re.I)
_GROUP = rf"(?:[0-9]{{2,}}|{_DIGIT}(?:[\s,-]+{_DIGIT}){{0,7}})"
#: Four numerals or spelled ones with dots between them, some of them in words.
DOTTED = re.compile(rf"(?<![^\W_])(?<!\.){_GROUP}(?:(?:[\s,-]+{_DOT}[\s,-]+|\.){_GROUP}){{3}}(?![^\W_])", re.I)
DOTTED_PART = re.compile(rf"({_DOT}|\.)|([0-9]+)|({_DIGIT})", re.I)
PLUS = re.compile(r"(?:plus[\s,-]+|\+\s*)\Z", re.I)
#: A quick look for a dot in words before a numeral.
DOT_DIGIT = re.compile(rf"{_DOT}[\s,-]+{_DIGIT}")
NUMBER_PART = re.compile(rf"(plus|\+)|(dot|punkt|point|punto|\.)|({_PART})", re.I)
SPELLED_WORD = re.compile(rf"(?<![^\W_])(?:{'|'.join(w for w in DIGIT_WORDS)})(?:[\s,.-]+(?:dot[\s,-]+)?(?:{'|'.join(w for w in DIGIT_WORDS)})(?![^\W_])){{{SPELLED - 1}}}", re.I)
#: A quick look for a spelled digit before another digit, before the exact patterns.
TWO_DIGITS = re.compile(rf"[\W_](?:{'|'.join(DIGIT_WORDS)})[\s,.-]+(?:{_DOT}[\s,-]+)?{_DIGIT}")
# Last labels that an address in words ("name at host dot com") may end in, besides those of two letters.
LAST_LABELS = frozenset("com org net edu gov mil int info biz name pro app dev example test local invalid museum travel online site shop cloud tech".split())

#: Labels that are English words of their own: "at this point in" is no address, so they don't end one after "point".
WORD_LABELS = frozenset("am an as at be by do go he if in is it me my no of on or so to up us we info name pro app dev example test local invalid museum travel online site shop cloud tech".split())


def _digits(said: str) -> str:
    """The digits of a spelled digit, which may be doubled, or of a numeral."""
    *times, digit = re.split(r"[\s-]+", said.lower())
    return DIGIT_WORDS.get(digit, digit) * (TIMES[times[0]] if times else 1)


def luhn(digits: str) -> bool:
    """The check digit is right: every second digit from the right doubled, nines cast out."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand: leftmost and non-overlapping within each kind, ordered by kind and start."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            at, step = m.start(), 64
            while True:  # backwards over the local part, in growing steps
                head = text[max(free, at - step) : at]
                size = len(head) - len(head.rstrip(LOCAL))
                if size < len(head) or at - step <= free:
                    break
                step *= 4
            if size:
                out.append((0, at - size, m.end()))
                free = m.end()
    if ANY_DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


class Rewritten:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.edited = False

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (from, to, new) in ascending order, without overlaps. Each new character stands for the whole span."""
        if not self.edited:
            self.edited, n = True, len(self.text)
            self.start, self.end, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            text.append(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def _odd_edits(text: str) -> list[tuple[int, int, str]]:
    def plain(c: str) -> str:
        if c in HOMOGLYPHS or c in INVISIBLE:
            return HOMOGLYPHS.get(c, "")
        if (digit := unicodedata.decimal(c, None)) is not None:  # of any script
            return str(digit)
        form = unicodedata.normalize("NFKC", c)  # full-width forms, mathematical letters
        return HOMOGLYPHS.get(form, form)

    return [(m.start(), m.end(), plain(m[0])) for m in ODD.finditer(text)]


def _reference_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in REFERENCE.finditer(text):
        c = REFERENCES[m[3].lower()] if m[3] else chr(int(m[1]) if m[1] else int(m[2], 16))
        if " " < c < "\x7f":
            out.append((*m.span(), c))
    return out


def _spaced_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + x.start(), m.start() + x.end(), "") for m in SPACED_DOTS.finditer(text) for x in WHITE.finditer(m[0])]


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """The white space around the brackets goes with them."""
    edits, at = [], 0
    for m in BRACKETS.finditer(text):
        a, b = m.span()
        while a > at and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m[1] else "."))
        at = b
    return edits


def _spelled(text: str) -> bool:
    """Some number holds enough spelled digits."""
    return any(sum(x[3] is not None and x[3][0].isalpha() for x in NUMBER_PART.finditer(m[0])) >= SPELLED for m in NUMBER.finditer(text))


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in NUMBER.finditer(text):
        if not any(c.isalpha() for c in m[0]):
            continue
        at = m.start()
        for x in NUMBER_PART.finditer(text, m.start(), m.end()):
            if x.start() > at:  # what separates the digits goes
                edits.append((at, x.start(), ""))
            edits.append((*x.span(), "+" if x[1] else "." if x[2] else _digits(x[3])))
            at = x.end()
    return edits


def _address_edits(found: Rewritten) -> list[tuple[int, int, str]]:
    """Addresses with "at" or dots in words. A dot in words, or one that an earlier edit made, tells them from prose."""
    edits, at, text = [], 0, found.text
    while m := PLAIN_AT.search(text, at):
        at, dots, told = m.end(1), [], False
        for x in PLAIN_LABEL.finditer(text, m.start(2), m.end(2)):
            word, last = x[1].strip().lower(), x[2].lower()
            told |= x[1] != "." or found.edited and found.changed[x.start(1)]
            dots.append((*x.span(1), "."))
            ends = last in LAST_LABELS or len(last) == 2 and last.isalpha()
            if told and ends and not (word in ("point", ".") and x[1] != "." and last in WORD_LABELS):
                if at == m.end(1):
                    edits.append((*m.span(1), "@"))
                edits += dots
                at, dots = x.end(), []
    return edits


def _joined_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in JOINED.finditer(text):
        edits.append((*m.span(1), "@"))
        edits += [(*x.span(), ".") for x in JOINED_DOT.finditer(text, m.end(1), m.end())]
    return edits


def _dotted_edits(text: str) -> list[tuple[int, int, str]]:
    """Numbers that dots in words join to an address."""
    edits = []
    for m in DOTTED.finditer(text):
        if PLUS.search(text, max(0, m.start() - 16), m.start()):
            continue
        new, values, at = [], [""], m.start()
        for x in DOTTED_PART.finditer(text, m.start(), m.end()):
            if x.start() > at:  # what separates the digits goes
                new.append((at, x.start(), ""))
            to = "." if x[1] else x[2] or _digits(x[3])
            if to == ".":
                values.append("")
            else:
                values[-1] += to
            if to != x[0]:
                new.append((*x.span(), to))
            at = x.end()
        if all(len(v.lstrip("0")) <= 3 and int(v[-3:]) <= 255 for v in values):
            edits += new
    return edits


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that appear only after rewriting, as spans of the source."""
    found = Rewritten(text)
    if not text.isascii() and (edits := _odd_edits(text)):
        found.replace(edits)
    if "&" in text and ";" in text and (edits := _reference_edits(found.text)):
        found.replace(edits)
    if " . " in found.text and (edits := _spaced_edits(found.text)):
        found.replace(edits)
    low = found.text.lower()
    if edits := _bracket_edits(found.text):
        found.replace(edits)
        low = found.text.lower()
    dots = DOT_WORD.search(low) is not None
    if dots and ("_at" in low or "-at" in low) and (edits := _joined_edits(found.text)):
        found.replace(edits)
        low = found.text.lower()
    if (dots or found.edited or "@" in low and " . " in low) and (edits := _address_edits(found)):
        found.replace(edits)
        low = found.text.lower()
    if dots and DOT_DIGIT.search(low) and (edits := _dotted_edits(found.text)):
        found.replace(edits)
        low = found.text.lower()
    if TWO_DIGITS.search(f" {low}") and (SPELLED_WORD.search(low) or _spelled(found.text)) and (edits := _number_edits(found.text)):
        found.replace(edits)
    if not found.edited:
        return []
    out = []
    for kind, a, b in plain_spans(found.text):
        start, end = found.start[a], found.end[b - 1]
        whole = any(found.changed[a:b]) or end - start != b - a
        if whole and not any(k == kind and s < end and start < e for k, s, e in [*plain, *out]):
            out.append((kind, start, end))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, spans array<struct<kind, start, end, disguised>>) for each row of docs, by kind as in KINDS, then start.

    keep may name the text column. Offsets count code points, ends are exclusive. Null and empty texts have no spans; null ids stay; repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty table.
    """
    rows, names = for_arrow(docs, id_col, text_col, keep)
    schema = schema_of(rows, names) + ", spans array<struct<kind: string, start: bigint, end: bigint, disguised: boolean>>"
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            out = []
            for text in texts(b.column("_text")):
                plain = plain_spans(text)
                spans = sorted([(*s, False) for s in plain] + [(*s, True) for s in disguised_spans(text, plain)])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "disguised": d} for k, s, e, d in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(kind_of))], [*names, "spans"])

    return back(rows.mapInArrow(run, schema), id_col, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the plain spans, and all spans as one string. The counts n_* are of plain spans.

    One row for each row of found, repeated ones and null ids too; no spans give 0, the digest of the empty string and
    the empty string; an empty table gives an empty table; columns other than the id and spans are not read."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    plain = F.filter("spans", lambda s: ~s["disguised"])
    return found.select(id_col, *map(count, KINDS), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, such as [EMAIL]. Of overlapping spans the one that
    starts first counts, the longer one of two that start together, the first kind of two with equal ends; what the
    others cover beyond it goes with it. A null text stays null, one without spans as it is."""
    start = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["kind"]))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(fresh.alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(start, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))))
