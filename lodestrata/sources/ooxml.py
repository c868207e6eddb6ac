"""Office Open XML with the standard library: worksheets, document blocks, slides."""

from __future__ import annotations

import datetime
import io
import pickle
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHOW = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of dates among the built-in ones.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Bytes of a sheet's rows beyond which they wait on disk.
SPOOL = 8 << 20
LARGEST_GRID = (1_048_576, 16_384)


class _Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Relations of a part: id to (kind, target part)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], full)
        return out


def format_cell(value) -> str:
    """Dates without a time of day as yyyy-mm-dd, others with hours and minutes; nothing for None."""
    if value is None:
        return ""
    if isinstance(value, datetime.datetime):
        midnight = (value.hour, value.minute, value.second) == (0, 0, 0)
        return value.strftime("%Y-%m-%d" if midnight else "%Y-%m-%d %H:%M")
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def _date_styles(package: _Package) -> list[bool]:
    """For each cell style whether its number format is one of a date."""
    root = package.xml("xl/styles.xml")
    if root is None:
        return []
    custom = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code, re.I)) and "general" not in code.lower()
    xfs = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in xfs] if xfs is not None else []
    return [custom.get(i, i in DATE_FORMATS) for i in ids]


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell's name."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _cell_text(cell: ET.Element, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    if kind in ("str", "e"):
        return value
    if kind == "d":
        return format_cell(datetime.datetime.fromisoformat(value.replace("Z", "")))
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        moment = epoch + datetime.timedelta(days=float(value))
        return format_cell((moment + datetime.timedelta(microseconds=500)).replace(microsecond=0))
    number = float(value)
    return value if re.fullmatch(r"-?\d+", value) else str(int(number)) if number.is_integer() and "e" not in value.lower() and "." not in value else repr(number)


def workbook(content: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(sheet name, rows) of each worksheet: cached values, merged ranges filled with their first cell's value. Rows are
    read as they are asked for, those of one sheet before the next one."""
    package = _Package(content)
    book = package.xml("xl/workbook.xml")
    targets = package.targets("xl/workbook.xml")
    strings = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in strings.findall(f"{MAIN}si")] if strings is not None else []
    dates = _date_styles(package)
    properties = book.find(f"{MAIN}workbookPr")
    late = properties is not None and properties.get("date1904") in ("1", "true")
    epoch = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
    for sheet in book.iter(f"{MAIN}sheet"):
        kind, target = targets.get(sheet.get(f"{REL}id"), ("", ""))
        if target in package.names and kind == "worksheet":
            yield sheet.get("name"), _sheet_rows(package, target, shared, dates, epoch)


def _sheet_rows(package: _Package, target: str, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> Iterator[list[str]]:
    """A worksheet's rows. Width, height and merged ranges are only known at its end: until then rows wait in a file, so
    that a large sheet is never a tree, nor a dictionary of cells."""
    width = height = 0
    row_at = last = -1
    merges: list[tuple[int, int, int, int]] = []
    stray: dict[int, dict[int, str]] = {}  # cells of rows that come out of order
    parents: list[ET.Element] = []
    held: list[tuple[int, list[str]]] = []
    with tempfile.SpooledTemporaryFile(SPOOL) as kept, package.zip.open(target) as stream:
        for event, e in ET.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == f"{MAIN}mergeCell":
                first, _, end = e.get("ref").partition(":")
                (r0, c0), (r1, c1) = _place(first), _place(end or first)
                if r0 <= r1 and c0 <= c1:
                    merges.append((r0, c0, r1, c1))
                    width, height = max(width, c1 + 1), max(height, r1 + 1)
            if e.tag != f"{MAIN}row":
                continue
            row_at = int(e.get("r", row_at + 2)) - 1
            col_at, cells = -1, []
            for c in e.findall(f"{MAIN}c"):
                at = _place(c.get("r")) if c.get("r") else (row_at, col_at + 1)
                col_at = at[1]
                text = _cell_text(c, shared, dates, epoch)
                width, height = max(width, col_at + 1), max(height, at[0] + 1)
                if at[0] != row_at or row_at <= last:
                    stray.setdefault(at[0], {})[col_at] = text
                    continue
                if row_at in stray:
                    stray[row_at].pop(col_at, None)
                cells += [""] * (col_at + 1 - len(cells))
                cells[col_at] = text
            if cells:
                held.append((row_at, cells))
                last = row_at
                if len(held) == 1000:
                    pickle.dump(held, kept, pickle.HIGHEST_PROTOCOL)
                    held = []
            if parents:
                parents[-1].remove(e)
        pickle.dump(held, kept, pickle.HIGHEST_PROTOCOL)
        kept.seek(0, 2)
        size = kept.tell()
        kept.seek(0)

        def in_order() -> Iterator[tuple[int, list[str]]]:
            while kept.tell() < size:
                yield from pickle.load(kept)  # noqa: S301  what was written above

        rows = in_order()
        ahead = next(rows, None)
        opening = sorted(range(len(merges)), key=lambda m: merges[m][0], reverse=True)
        live: list[int] = []
        values: dict[int, str] = {}
        for r in range(height):
            cells = []
            if ahead is not None and ahead[0] == r:
                cells, ahead = ahead[1], next(rows, None)
            cells = cells + [""] * (width - len(cells))
            for c, text in stray.get(r, {}).items():
                cells[c] = text
            while opening and merges[opening[-1]][0] == r:
                live.append(opening.pop())
            if live:
                live = sorted(m for m in live if merges[m][2] >= r)
                for m in live:
                    r0, c0, _, c1 = merges[m]
                    if r == r0:
                        values[m] = cells[c0]
                    cells[c0 : c1 + 1] = [values[m]] * (c1 + 1 - c0)
            yield cells


def _paragraph_text(p: ET.Element) -> str:
    parts = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n", f"{WORD}cr": lambda e: "\n"}
    return "".join(parts[e.tag](e) for r in p.iter(f"{WORD}r") for e in r if e.tag in parts)


def document_blocks(content: bytes) -> Iterator[tuple[bool, str]]:
    """(is_heading, text) of the body's paragraphs, then of its tables' rows, cells joined by bars."""
    package = _Package(content)
    styles = package.xml("word/styles.xml")
    names: dict[str, str] = {}
    default = ""
    for s in styles.iter(f"{WORD}style") if styles is not None else ():
        name = s.find(f"{WORD}name")
        names[s.get(f"{WORD}styleId")] = (name.get(f"{WORD}val") if name is not None else "").lower()
        if s.get(f"{WORD}type") == "paragraph" and s.get(f"{WORD}default") in ("1", "true"):
            default = names[s.get(f"{WORD}styleId")]
    body = package.xml("word/document.xml").find(f"{WORD}body")
    for p in body.findall(f"{WORD}p"):
        text = _paragraph_text(p).strip()
        if text:
            style = p.find(f"{WORD}pPr/{WORD}pStyle")
            key = style.get(f"{WORD}val") if style is not None else None
            name = names.get(key, (key or "").lower()) if key else default
            yield name.startswith("heading") or name == "title", text
    for table in body.findall(f"{WORD}tbl"):
        for row in table.findall(f"{WORD}tr"):
            cells = ["\n".join(_paragraph_text(p) for p in c.findall(f"{WORD}p")).strip() for c in row.findall(f"{WORD}tc")]
            if any(cells):
                yield False, " | ".join(cells)


def _lines(shape: ET.Element) -> list[str]:
    """Paragraphs of a text frame, or rows of a table."""
    out = []
    frame = shape.find(f"{SHOW}txBody")
    for p in frame.findall(f"{DRAW}p") if frame is not None else ():
        line = "".join(t.text or "" for r in p.findall(f"{DRAW}r") for t in r.findall(f"{DRAW}t")).strip()
        if line:
            out.append(line)
    for row in shape.iter(f"{DRAW}tr"):
        cells = ["\n".join("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in c.iter(f"{DRAW}p")).strip() for c in row.findall(f"{DRAW}tc")]
        if any(cells):
            out.append(" | ".join(cells))
    return out


def _holder(shape: ET.Element) -> ET.Element | None:
    return shape.find(f".//{SHOW}nvPr/{SHOW}ph")


def slides(content: bytes) -> Iterator[tuple[int, str, list[str], bool]]:
    """(number, title, lines, has notes) of each slide in order; the speaker's notes are the last line."""
    package = _Package(content)
    targets = package.targets("ppt/presentation.xml")
    order = [targets[s.get(f"{REL}id")][1] for s in package.xml("ppt/presentation.xml").iter(f"{SHOW}sldId")]
    for n, part in enumerate(order, 1):
        tree = package.xml(part).find(f"{SHOW}cSld/{SHOW}spTree")
        lines, title = [], ""
        for shape in tree:
            if shape.tag not in (f"{SHOW}sp", f"{SHOW}graphicFrame"):
                continue
            found, holder = _lines(shape), _holder(shape)
            if found and not title and holder is not None and holder.get("type") in ("title", "ctrTitle"):
                title = found[0]
            lines += found
        notes = ""
        for kind, target in package.targets(part).values():
            root = package.xml(target) if kind == "notesSlide" else None
            for shape in root.iter(f"{SHOW}sp") if root is not None else ():
                holder = _holder(shape)
                if holder is not None and holder.get("type") == "body":
                    paragraphs = shape.iter(f"{DRAW}p")
                    notes = "\n".join("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in paragraphs).strip()
        if notes:
            lines.append(f"Notes: {notes}")
        yield n, title, lines, bool(notes)
