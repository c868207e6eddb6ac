"""Lexicons that are tables against the functions that write their terms into the plan; table functions of SQL."""

import random

from pyspark.sql import functions as F
from test_engine import docx, pptx, xlsx

from lodestrata.functions import lexicon as L
from lodestrata.functions import tagging as G
from lodestrata.functions import text as T
from lodestrata.functions import vocab as V
from lodestrata.functions.embedding import hashing_vector
from lodestrata.sources import files, tables

PARTS = ["war", "room", "data", "centre", "पुणे", "पाणीपुरवठा", "water", "supply", "Pune", "New", "Delhi", "x_y", "w.r.t", "été", "ÉTÉ", "a", "war room", "data centre", "वॉर रूम", "Straße"]


def texts(r):
    rows = [" ".join(r.choice(PARTS) for _ in range(r.randrange(9))) for _ in range(300)]
    return [*rows, *(x.replace(" ", r.choice(["", "-", "_", ".", "  "])) for x in rows[:100]), "", None, "a" * 5000]


def test_tables_equal_the_plan(spark, monkeypatch):
    r = random.Random(4)
    df = spark.createDataFrame(list(enumerate(texts(r))), "id int, text string").repartition(3)
    groups = [tuple({r.choice(PARTS) + r.choice(["", " " + r.choice(PARTS)]) for _ in range(r.randint(1, 4))}) for _ in range(40)] + [*V.LEXICON, ("Alone",)]
    hints = {f"c{i % 5}{i}": tuple(r.sample(PARTS, 2)) for i in range(9)}
    names = list(dict.fromkeys([*r.sample(PARTS, 9), *V.PLACES]))
    table = spark.createDataFrame([(t, i) for i, g in enumerate(groups) for t in g], "term string, concept int")
    triggers = spark.createDataFrame([(t, c, k) for k, (c, ts) in enumerate(hints.items()) for t in ts], "trigger string, category string, rank bigint")
    gazetteer = spark.createDataFrame([(p, k) for k, p in enumerate(names)] + [(None, 99)], "place string, rank bigint")
    for block in (L.BLOCK, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.places(L.category(L.synonyms(df, "text", table), "text", triggers), "text", gazetteer)
        rows = got.select("text", "aliases", "category", "places", T.expand_terms(F.col("text"), tuple(groups)).alias("a"), G.infer_category(F.col("text"), hints=hints).alias("c"), G.extract_locations(F.col("text"), tuple(names)).alias("p")).collect()
        assert len(rows) == 403
        for x in rows:
            assert (x["aliases"], x["category"], x["places"]) == (x["a"], x["c"], x["p"]), x["text"]
    none = L.synonyms(df, "text", table.limit(0))
    assert none.where("size(aliases) > 0").count() == 0 == L.synonyms(df.limit(0), "text", table).count()


def test_words_are_looked_up_as_tokens(spark, monkeypatch):
    """No automaton holds words that count as whole tokens only."""
    shared, inner = [], L._finder
    monkeypatch.setattr(L, "_finder", lambda x: shared.append(x.value) or inner(x))
    terms = spark.createDataFrame([("a", 0), ("Beta", 0), ("b c", 0), ("w.r", 1), ("other", 1)], "term string, concept int")
    docs = spark.createDataFrame([(0, "aaa beta"), (1, "a b cd"), (2, "w.r"), (3, "")], "k int, text string")
    got = {r["k"]: r["aliases"] for r in L.synonyms(docs, "text", terms).collect()}
    assert got == {0: ["a", "b c"], 1: ["Beta", "b c"], 2: [], 3: []}
    assert sorted(shared[0][0]) == ["a", "beta", "other", "w.r"] and [t for t, _ in shared[0][1]] == ["b c"]


def test_table_functions(spark):
    tables.register(spark)
    rows = [("a.csv", b"x,y\n1,\n"), ("b.XLSX", xlsx()), ("c.docx", docx()), ("d.pptx", pptx()), ("e.xlsx", b"broken"), ("f.txt", b"text"), ("g.csv", None)]
    spark.createDataFrame(rows, "name string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.name, t.sheet, t.row_idx, t.cells FROM some_files f, LATERAL read_sheet(f.name, f.content) t").collect()
    assert [(r["row_idx"], r["cells"]) for r in got if r["name"] == "a.csv"] == [(0, ["x", "y"]), (1, ["1", ""])]
    assert {r["name"] for r in got} == {"a.csv", "b.XLSX"} and [r["cells"][3] for r in got if r["name"] == "b.XLSX"][-1] == "Approval of the new scheme"
    said = spark.sql("SELECT f.name, t.* FROM some_files f, LATERAL read_sections(f.name, f.content) t").collect()
    assert [(r["heading"], r["text"]) for r in said if r["name"] == "c.docx"][:2] == [(True, "Review"), (False, "first body")]
    assert ("d.pptx", 1, True, "Quantum mission") in [tuple(r) for r in said]
    vec = {r["slot"]: r["weight"] for r in spark.sql("SELECT t.* FROM (SELECT 'some words' AS w) q, LATERAL embed_text(q.w, 32) t").collect()}
    assert all(abs(vec.get(k, 0.0) - v) < 1e-12 for k, v in enumerate(hashing_vector("some words", 32)))


def test_outcomes_of_each_file(spark):
    rows = [("in/a.md", "a.md", b"# A\nx"), ("in/b.docx", "b.docx", b"no"), ("in/c.xlsx", "c.xlsx", xlsx()), ("in/d.csv", "d.csv", b""), ("in/e.pdf", "e.pdf", b"%PDF"), ("in/scan.txt", "scan.txt", b"seen")]
    records, outcomes = files.ingest_with_outcomes(spark.createDataFrame(rows, "path string, name string, content binary"))
    got = {r["path"]: (r["outcome"], r["reason"]) for r in outcomes.collect()}
    assert got["in/b.docx"] == ("failed", "BadZipFile: File is not a zip file") and got["in/d.csv"] == ("empty", None)
    assert got["in/a.md"] == got["in/c.xlsx"] == got["in/scan.txt"] == ("read", None) and got["in/e.pdf"][0] in ("skipped", "failed")
    assert {r["source_file"] for r in records.collect()} == {"a.md", "c.xlsx", "scan.txt"}
    none = spark.createDataFrame([], "path string, name string, content binary")
    assert files.ingest_with_outcomes(none)[1].count() == 0


def test_bytes_are_decoded_as_python_does(spark):
    r = random.Random(9)
    rows = [(bytes(r.choice([0x41, 0xC3, 0xA9, 0xE0, 0xA4, 0xB0, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xC0]) for _ in range(r.randrange(9))),) for _ in range(3000)]
    got = spark.createDataFrame(rows, "b binary").select("b", files._decoded(F.col("b")).alias("t")).collect()
    assert [(x["b"], x["t"]) for x in got if bytes(x["b"]).decode("utf-8", "replace") != x["t"]] == []


def test_pdf_pages(monkeypatch):
    """Text layers, OCR of pages with hardly any text, and pages without either; the library is a stand-in."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def get_text(self):
            return self.text

        def get_pixmap(self, dpi):
            assert dpi == 200
            return types.SimpleNamespace(tobytes=lambda kind: f"{kind} of {self.text}".encode())

    class Pages(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    texts = ["\n First line of the page \nsecond line", "few", "  ", "only a few letters"]
    opened = lambda stream, filetype: Pages(map(Page, texts)) if (stream, filetype) == (b"%PDF", "pdf") else None
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=opened))
    monkeypatch.setattr(files, "_ocr", lambda image: "read by eye" if image() == b"png of few" else "")
    got = list(files.pdf_pages("a.pdf", b"%PDF"))
    assert [(r["row_or_page"], r["title"], r["extractor"]) for r in got] == [("page 1", "First line of the page", "text-layer"), ("page 2", "read by eye", files.OCR_NAME), ("page 4", "only a few letters", "text-layer")]
    monkeypatch.setitem(sys.modules, "fitz", None)
    import pytest

    with pytest.raises(files.NotInstalled):
        list(files.pdf_pages("a.pdf", b"%PDF"))
