"""Small spreadsheets, documents and slide decks in the Office formats, for queries and tests that read them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from itertools import batched
from xml.sax.saxutils import escape, quoteattr

SCHEMAS, RELATIONS = "http://schemas.openxmlformats.org", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = f'xmlns="{SCHEMAS}/spreadsheetml/2006/main" xmlns:r="{RELATIONS}"'
WORD = f'xmlns:w="{SCHEMAS}/wordprocessingml/2006/main"'
SHOW = f'xmlns:p="{SCHEMAS}/presentationml/2006/main" xmlns:a="{SCHEMAS}/drawingml/2006/main" xmlns:r="{RELATIONS}"'


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _relations(*links: tuple[str, str]) -> str:
    """Links (kind, target) with the ids r1, r2, ..."""
    rows = "".join(f'<Relationship Id="r{i}" Type="{RELATIONS}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(links, 1))
    return f'<Relationships xmlns="{SCHEMAS}/package/2006/relationships">{rows}</Relationships>'


def _cell(place: str, value: str | float | bool | tuple[float]) -> str:
    """A cell with a text, a number, a truth value, or, in a tuple, the serial number of a date."""
    if isinstance(value, str):
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>' if value else ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    return f'<c r="{place}" s="1"><v>{value[0]!r}</v></c>' if isinstance(value, tuple) else f'<c r="{place}"><v>{value!r}</v></c>'


def workbook(sheets: Iterable[tuple[str, Iterable[tuple[int, list]]]]) -> bytes:
    """(name, rows) for each sheet, a row being its number from 0 and its cells, see _cell(). Rows are packed as they
    come, so a large sheet is never one text."""
    out, names = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, rows) in enumerate(sheets, 1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                part.write(f"<worksheet {SHEET}><sheetData>".encode())
                for some in batched(rows, 1000):
                    cells = lambda at, row: "".join(_cell(f"{chr(65 + k)}{at + 1}", c) for k, c in enumerate(row))
                    part.write("".join(f'<row r="{at + 1}">{cells(at, row)}</row>' for at, row in some).encode())
                part.write(b"</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {SHEET}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", _relations(*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1))))
        z.writestr("xl/styles.xml", f'<styleSheet {SHEET}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
    return out.getvalue()


def document(paragraphs: list[tuple[bool, str]]) -> bytes:
    """(is a heading, text) for each paragraph."""
    style = '<w:pPr><w:pStyle w:val="Top"/></w:pPr>'
    body = "".join(f'<w:p>{style if heading else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>' for heading, text in paragraphs)
    styles = '<w:style w:type="paragraph" w:styleId="Top"><w:name w:val="heading 1"/></w:style>'
    return _package({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {WORD}>{styles}</w:styles>"})


def deck(slides: list[tuple[str, list[str], str]]) -> bytes:
    """(title, lines, notes) for each slide."""
    lines = lambda texts: "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in texts)
    shape = lambda kind, texts: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{lines(texts)}</p:txBody></p:sp>'
    tree = lambda kind, shapes: f"<p:{kind} {SHOW}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{kind}>"
    parts = {
        "ppt/presentation.xml": f"<p:presentation {SHOW}><p:sldIdLst>" + "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _relations(*(("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1))),
    }
    for i, (title, body, notes) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = tree("sld", shape("title", [title]) + shape("body", body))
        if notes:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = _relations(("notesSlide", f"../notesSlides/n{i}.xml"))
            parts[f"ppt/notesSlides/n{i}.xml"] = tree("notes", shape("body", [notes]))
    return _package(parts)
