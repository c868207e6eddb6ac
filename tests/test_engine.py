import io
import os
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata import cli, web
from lodestrata.config import load
from lodestrata.functions.tagging import tag
from lodestrata.operators import search as S
from lodestrata.plans import engine
from lodestrata.sources import drive, files
from lodestrata.streaming import watch as W

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHOW = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx():
    def row(r, *cells):
        return f'<row r="{r}">' + "".join(c if c.startswith("<c") else f'<c r="{"ABCD"[i]}{r}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(cells) if c) + "</row>"

    sheet = f'<worksheet {M}><sheetData>{row(1, "Cabinet tracker")}{row(2, "note")}{row(3, "Sr", "Date", "प्रवर्ग", "तपशील")}'
    sheet += row(4, '<c r="A4"><v>1</v></c>', '<c r="B4" s="1"><v>45823</v></c>', "Cabinet Decisions", "Approval of the new scheme")
    sheet += '</sheetData><mergeCells><mergeCell ref="A1:D1"/></mergeCells></worksheet>'
    return package({
        "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(f'<Relationship Id="r1" Type="{KIND}worksheet" Target="worksheets/sheet1.xml"/>'),
        "xl/styles.xml": f'<styleSheet {M}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
    })


def docx():
    p = lambda text, style="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Review", "H1") + p("first body") + p("Actions", "H2") + p("second body") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H2", "Heading 2")))
    return package({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {WORD}>{styles}</w:styles>"})


def pptx():
    sp = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    return package({
        "ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(f'<Relationship Id="r1" Type="{KIND}slide" Target="slides/slide1.xml"/>'),
        "ppt/slides/slide1.xml": f"<p:sld {SHOW}><p:cSld><p:spTree>{sp('title', 'Quantum mission')}{sp('body', 'Scope of work')}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": RELS.format(f'<Relationship Id="n" Type="{KIND}notesSlide" Target="../notesSlides/n1.xml"/>'),
        "ppt/notesSlides/n1.xml": f"<p:notes {SHOW}><p:cSld><p:spTree>{sp('body', 'ask for funds')}</p:spTree></p:cSld></p:notes>",
    })


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    letters = "Letters out\nSr,Date,Recipient,Subject\n" + "".join(f"{i},0{i}-03-2025,Officer number {i},Routine matter {i}\n" for i in range(1, 8))
    letters += "8,11-02-2025,Hon'ble President,Invitation to the summit\n9,12-02-2024,Secretary,The President will visit\n"
    (root / "vip_letters.csv").write_bytes(b"\xef\xbb\xbf" + letters.encode())
    (root / "sub" / "_tracker.tsv").write_text("Sr\tप्रवर्ग\tतपशील\n1\tWar Room\tपाणीपुरवठा योजना आढावा\n")
    (root / "deck.md").write_text("# Plan\nQuantum centre in Pune, 19 April 2025\n## Water\nwater supply in Nashik\n")
    (root / "scan_note.txt").write_text("Cabinet note\nquantum policy")
    (root / "photo.png").write_bytes(b"no image")
    (root / "photo.ocr.txt").write_text("text of the photo")
    (root / "cabinet_tracker.xlsx").write_bytes(xlsx())
    (root / "ps_meeting_minutes.docx").write_bytes(docx())
    (root / "quantum.pptx").write_bytes(pptx())
    (root / "odd.bin").write_bytes(b"plain \xff bytes")
    (root / ".hidden").write_text("x")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    return root, engine.build_index(spark, root, corpus)


def test_ingest(spark, corpus):
    rows = {(r["source_file"], r["row_or_page"]): r for r in tag(files.ingest(files.read_files(spark, corpus))).collect()}
    assert {f for f, _ in rows} == {"vip_letters.csv", "_tracker.tsv", "deck.md", "scan_note.txt", "photo.png", "cabinet_tracker.xlsx", "ps_meeting_minutes.docx", "quantum.pptx", "odd.bin"}
    x = rows["cabinet_tracker.xlsx", "row 4"]
    assert x["category"] == "Cabinet Decisions" and x["date"] == "2025-06-15" and x["sheet"] == "S1" and x["extra"]["columns"]["Date"] == "2025-06-15"
    assert rows["ps_meeting_minutes.docx", "section 1"]["raw_text"] == "Review\nfirst body"
    assert rows["ps_meeting_minutes.docx", "section 2"]["raw_text"] == "Actions\nsecond body\na | b" and rows["ps_meeting_minutes.docx", "section 2"]["source_type"] == "minutes"
    s = rows["quantum.pptx", "slide 1"]
    assert s["title"] == "Quantum mission" and s["raw_text"].endswith("Notes: ask for funds") and s["extra"]["has_notes"]
    assert rows["photo.png", "page 1"]["raw_text"] == "text of the photo" and rows["odd.bin", None]["raw_text"] == "plain � bytes"
    assert rows["_tracker.tsv", "row 2"]["category"] == "War Room" and rows["vip_letters.csv", "row 10"]["recipient"] == "Hon'ble President"


def test_search(spark, index):
    root, figures = index
    assert figures["indexed"] == figures["count"] == sum(figures["by_language"].values())
    found = engine.search(spark, root, "Letters to the President", answer=True)
    assert found.hits[0]["provenance"] == "vip_letters.csv · sheet 'vip_letters' · row 10" and found.answer.startswith("Top match: Invitation")
    assert all(h["score"] <= 3 / 61 + 1e-12 for h in found.hits)
    only = engine.search(spark, root, "quantum", filters={"date": ["2025-01-01", "2025-12-31"], "source_type": "deck", "bogus": 1})
    assert {h["source_type"] for h in only.hits} == {"deck"} and all(h["date"].startswith("2025") for h in only.hits)
    assert "पाणीपुरवठा" in engine.search(spark, root, "water supply", limit=3).hits[0]["title"] + engine.search(spark, root, "water supply", limit=3).hits[1]["title"]
    assert engine.search(spark, root, "").hits[0]["keyword_rank"] is None
    with pytest.raises(ValueError, match="vectors"):
        engine.search(spark, root, "x", embedder="native")
    assert engine.search(spark, root + "/none", "x", answer=True).answer == "No records matched this query."


def test_append_keeps_the_last(spark, corpus, tmp_path):
    root = str(tmp_path / "i")
    deck = os.path.join(corpus, "deck.md")
    a = engine.build_index(spark, root, deck)
    b = engine.build_index(spark, root, deck, reset=False)
    assert (a["count"], b["indexed"], b["count"]) == (2, 2, 2)


def test_bm25_against_python(spark):
    import math

    docs = ["a b c a", "b c d", "a a a a a", "d e", ""]
    f = spark.createDataFrame([(0, t, i, float(d.split().count(t))) for i, d in enumerate(docs) for t in ("a", "d") if t in d.split()], "qid int, phrase string, id int, f double")
    lengths = spark.createDataFrame([(i, len(d.split())) for i, d in enumerate(docs)], "id int, len bigint")
    avg = sum(len(d.split()) for d in docs) / 5
    want = {}
    for t in ("a", "d"):
        n = sum(t in d.split() for d in docs)
        idf = math.log((5 - n + 0.5) / (n + 0.5))
        for i, d in enumerate(docs):
            if k := d.split().count(t):
                want[i] = want.get(i, 0) + (idf if idf > 0 else 1e-6) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(d.split()) / avg))
    got = {r["id"]: r["score"] for r in S.bm25(f, lengths, 5, avg).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_fuse_order(spark):
    k = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "qid int, id string, rank int")
    v = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "qid int, id string, rank int")
    got = [(r["id"], round(r["score"], 9)) for r in S.fuse(k, v).orderBy("rank").collect()]
    assert got == [("b", round(2 / 62 + 1 / 61, 9)), ("a", round(2 / 61, 9)), ("c", round(1 / 62, 9))]


def test_watch_and_streams(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.txt").write_text("one")
    seen = []
    W.watch(lambda: seen.append(1) or {"indexed": 1}, once=True, on_update=lambda s: seen.append(s["at"]))
    W.watch(lambda: None, once=True, on_update=seen.append)
    assert len(seen) == 2
    old = spark.createDataFrame(W.manifest(spark, str(data)).collect())
    (data / "b.txt").write_text("two")
    (data / "a.txt").write_text("longer")
    assert {r["change"] for r in W.manifest_diff(old, W.manifest(spark, str(data))).collect()} == {"added", "changed"}
    names = []
    W.stream_files(spark, str(data), str(tmp_path / "cp"), lambda df, _: names.extend(r["name"] for r in df.select("name").collect())).awaitTermination()
    assert sorted(names) == ["a.txt", "b.txt"]


def test_snapshots_as_a_stream(spark, tmp_path):
    import datetime

    snapshots = [{"a": 1, "b": 1}, {"a": 2, "c": 1}, {"a": 2, "c": 1}, {"b": 5, "c": 1}]
    for k, s in enumerate(snapshots):
        rows = [(datetime.datetime(2025, 1, 1, 0, k), p, n, 1) for p, n in s.items()]
        spark.createDataFrame(rows, W.SNAPSHOT).write.mode("append").parquet(f"{tmp_path}/in")
        W.follow_snapshots(spark, f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out").awaitTermination()
    got = {(r["at"].minute, r["path"], r["change"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "c", "added"), (1, "b", "removed"), (3, "b", "added"), (3, "a", "removed")}


def test_snapshots_keep_their_state_by_groups_of_paths(spark, tmp_path):
    """One row of state and one call of Python for a group, not for a path; a group of which nothing is left goes."""
    new = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + k))
    paths = [spark.range(60), spark.range(30, 90), spark.range(0)]
    for k, ids in enumerate(paths):
        size = F.col("id") * (1 + F.lit(k) * (F.col("id") % 2))
        rows = ids.select(new(60 * k).alias("at"), F.format_string("p%d", "id").alias("path"), size.alias("size"), F.lit(1).cast("bigint").alias("mtime"))
        rows = rows.union(spark.createDataFrame([("only", 9, 9)], "path string, size bigint, mtime bigint").select(new(60 * k).alias("at"), "*"))
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        query = W.follow_snapshots(spark, f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", 3)
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert 0 < max(state) <= 3 and (k < 2 or state[-1] == 1)
    got = sorted((r["at"], r["path"], r["change"]) for r in spark.read.parquet(f"{tmp_path}/out").select(F.unix_seconds("at").alias("at"), "path", "change").collect())
    want = [(0, f"p{i}", "added") for i in range(60)] + [(0, "only", "added")] + [(60, f"p{i}", "removed") for i in range(30)] + [(60, f"p{i}", "changed") for i in range(31, 60, 2)]
    want += [(60, f"p{i}", "added") for i in range(60, 90)] + [(120, f"p{i}", "removed") for i in range(30, 90)]
    assert got == sorted((1_700_000_000 + at, path, change) for at, path, change in want)


class FakeDrive:
    """Answers as the drive client does."""

    def __init__(self):
        self.items = {"root": [{"id": "1", "name": "deck.md", "mimeType": "text/markdown", "modifiedTime": "t1"}, {"id": "f", "name": "sub", "mimeType": drive.FOLDER}, {"id": "9", "name": "form", "mimeType": f"{drive.NATIVE}.form"}], "f": [{"id": "2", "name": "Tracker", "mimeType": f"{drive.NATIVE}.spreadsheet", "modifiedTime": "t2"}, {"id": "3", "name": "scan_a.txt", "mimeType": "text/plain"}]}
        self.content = {"1": b"# A\nquantum body", "2": xlsx(), "3": b"scanned words"}

    def files(self):
        return self

    def list(self, q, **_):
        return Answer({"files": self.items.get(q.split("'")[1], [])})

    def get_media(self, fileId, **_):
        return Answer(self.content[fileId])

    export_media = get_media


class Answer:
    def __init__(self, value):
        self.value = value

    def execute(self):
        return self.value


def test_drive(spark, tmp_path, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
    got = {r["source_file"]: r for r in drive.ingest_drive(drive.drive_files(spark, FakeDrive, "root", share=2)).collect()}
    assert set(got) == {"deck.md", "Tracker", "scan_a.txt"}
    assert got["deck.md"]["title"] == "A" and got["deck.md"]["extra"]["origin_id"] == "1" and got["Tracker"]["sheet"] == "S1"
    assert {r["name"] for r in drive.drive_files(spark, FakeDrive, "root", recursive=False).collect()} == {"deck.md"}
    assert drive.drive_files(spark, FakeDrive, "empty").count() == 0
    assert engine.build_index_drive(spark, str(tmp_path / "i"), FakeDrive, "root")["count"] == len(got)
    assert got["scan_a.txt"]["source_type"] == "scan" and got["Tracker"]["extra"]["origin_modified"] == "t2"
    for k in drive.CREDENTIALS:
        monkeypatch.delenv(k, raising=False)
    with pytest.raises(FileNotFoundError):
        drive.credentials()


def test_cli_and_web(spark, index, monkeypatch, capsys):
    import json
    import threading
    import urllib.request

    monkeypatch.setenv("LODESTRATA_INDEX", index[0])
    monkeypatch.setenv("LODESTRATA_PORT", "0")
    assert cli.main(["query", "quantum", "-n", "2", "--json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 2
    assert cli.main(["stats"], spark) == 0 and "by_language" in capsys.readouterr().out
    assert cli.parse_filters(["date=2025-01-01..2025-12-31", "x", "language=eng"]) == {"date": ["2025-01-01", "2025-12-31"], "language": "eng"}
    server = web.server(spark, load())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    said = json.load(urllib.request.urlopen(f"{base}/api/stats"))
    assert said["count"] == said["records"] == index[1]["count"] and said["watching"] is False and ":" in said["updated"] and said["embedder"]
    assert b"<form" in urllib.request.urlopen(base).read()
    server.shutdown()


def test_upsert(spark):
    from lodestrata.operators.index import upsert

    a = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, ordinal int")
    b = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "id int, v string, ordinal int")
    want = [(1, "a"), (2, "c"), (3, "e")]
    assert sorted((r["id"], r["v"]) for r in upsert(a, b).collect()) == want


def test_pointers_leave_no_gap(spark, tmp_path):
    from lodestrata.operators.index import Index

    index, root = Index(spark, str(tmp_path / "i")), tmp_path / "i"
    assert not index.exists()
    for k in range(4):
        (root / f"s{k}" / "records").mkdir(parents=True)
        index._point({"snapshot": f"s{k}", "count": k})
        assert index.meta() == {"snapshot": f"s{k}", "count": k}
    assert sorted(p.name for p in root.iterdir() if p.name[0] in "cs") == ["current-2.json", "current-3.json", "s2", "s3"]
    (root / "torn.tmp").write_text("{")  # a writer that died before its rename
    assert index.meta()["snapshot"] == "s3"
