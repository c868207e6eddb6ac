from pyspark.sql import functions as F

from lodestrata.operators import sections, tabular

ROWS = [["Register of letters", "", "", ""], ["office copy", "", "", ""], ["Sr", "Date", "Subject", "Status"], ["1", "14-06-2025", "Water supply", "open"], ["2", "15-06-2025", "Road works", "closed"]]
GRID = "source_file string, sheet_idx int, sheet string, row_idx int, cells array<string>"


def grid(spark, *sheets):
    rows = [("f.csv", k, f"s{k}", i, cells) for k, sheet in enumerate(sheets) for i, cells in enumerate(sheet)]
    return spark.createDataFrame(rows, GRID)


def test_header(spark):
    assert tabular.detect_headers(grid(spark, ROWS)).first()["header_idx"] == 2
    assert tabular.detect_headers(grid(spark, [["only"], [""]])).first()["header_idx"] == 0


def test_dedupe_headers(spark):
    df = spark.createDataFrame([(["Status", "Status", "", "Date", " Status "],)], "c array<string>")
    assert df.select(tabular.dedupe_headers(F.col("c"))).first()[0] == ["Status", "Status_1", "col3", "Date", "Status_2"]


def test_shape_rows(spark):
    got = tabular.shape_rows(grid(spark, [*ROWS, ["", "", "", ""], ["7", "1-1-2025", "Short"], ["8", "2025-01-01", "", "", "beyond"]])).orderBy("row_idx").collect()
    assert [r["row_or_page"] for r in got] == ["row 4", "row 5", "row 7", "row 8"]
    assert got[0]["raw_text"] == "Sr: 1\nDate: 14-06-2025\nSubject: Water supply\nStatus: open"
    assert got[0]["title"] == "Water supply" and got[0]["key_fields"] == "Water supply" and got[0]["source_type"] == "tracker"
    assert got[3]["title"] == "8" and got[3]["extra"]["columns"] == {"Sr": "8", "Date": "2025-01-01"}


def test_category_recipient_and_near_duplicates(spark):
    one = [["Sr", "Recipient Name", "Category"], ["1", "The Honourable Governor", "war room"], ["2", "The Prime Minister of India", "none"], ["3", "short", ""]]
    two = [["No", "Name", "Type", "Extra"], ["9", "the  honourable governor", "", "x"], ["3", "short", "", ""]]
    shaped = tabular.shape_rows(grid(spark, one, two))
    first = shaped.where("sheet_idx = 0").orderBy("row_idx").first()
    assert first["category"] == "War Room" and first["recipient"] == "The Honourable Governor"
    left = [(r["sheet"], r["row_or_page"]) for r in tabular.drop_near_duplicates(shaped).orderBy("sheet_idx", "row_idx").collect()]
    assert left == [("s0", "row 2"), ("s0", "row 3"), ("s0", "row 4"), ("s1", "row 3")]


def test_sheet_types(spark):
    df = spark.createDataFrame([("VIP_Letters.csv",), ("minutes.csv",), ("x.csv",)], "n string")
    assert [r[0] for r in df.select(tabular.sheet_type(F.col("n"))).collect()] == ["letter", "minutes", "tracker"]


def test_markdown(spark):
    text = "intro\n# One\nbody 1\n### deep\nmore\n## Empty\n## Two\r\nbody 2"
    df = spark.createDataFrame([("notes.md", text), ("empty.md", ""), ("none.md", None)], "source_file string, text string")
    got = {(r["source_file"], r["row_or_page"]): (r["title"], r["raw_text"]) for r in sections.markdown_sections(df).collect()}
    assert got == {
        ("notes.md", "section 0"): ("notes", "notes\nintro"),
        ("notes.md", "section 1"): ("One", "One\nbody 1\n### deep\nmore"),
        ("notes.md", "section 3"): ("Two", "Two\nbody 2"),
        ("empty.md", "page 1"): ("empty", ""),
        ("none.md", "page 1"): ("none", ""),
    }


def chunks(paragraphs, budget):
    out, open_, size = [], [], 0
    for p in paragraphs:
        open_.append(p)
        size += len(p)
        if size >= budget:
            out.append("\n".join(open_).strip())
            open_, size = [], 0
    out.append("\n".join(open_).strip())
    return [b for b in out if b]


def test_budget_chunks(spark):
    cases = [["a" * 7, "b" * 4, "c"], ["x" * 10, "y" * 10], [], ["", "", "z"], ["a", "b", "c", "d" * 20, "e"]]
    df = spark.createDataFrame([(c,) for c in cases], "p array<string>")
    assert [r[0] for r in df.select(sections.budget_chunks(F.col("p"), 10)).collect()] == [chunks(c, 10) for c in cases]
