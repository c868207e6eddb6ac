"""The segmented index: appended, replaced and removed records, merges, pruned scans, refreshes of a folder."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.embedding import HashingEmbedder
from lodestrata.functions.records import as_records
from lodestrata.operators import index as I
from lodestrata.operators import search as S
from lodestrata.plans import engine

EMBEDDER = HashingEmbedder(16)


def records(spark, rows):
    """(file, title, text) as records."""
    return as_records(spark.createDataFrame(rows, "source_file string, title string, raw_text string"))


def state(index):
    """All that a reader sees of an index, in a form that doesn't depend on its segments."""
    rows = lambda t: index.table(t).drop("doc")  # noqa: E731  numbers differ
    out = {t: sorted(map(repr, rows(t).select(*sorted(rows(t).columns)).collect())) for t in ("records", "postings", "tf", "lengths", "vectors")}
    meta = index.meta()
    return out | {"count": meta["count"], "avgdl": round(meta["avgdl"], 9), "figures": sorted(index.figures())}


def rebuilt(spark, path, rows):
    index = I.Index(spark, str(path))
    index.write(records(spark, rows), EMBEDDER)
    return state(index)


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(I, "MERGE", 2)
    index = I.Index(spark, str(tmp_path / "i"))
    now = {(f"f{i % 4}", f"t{i}"): f"some words {i} and w{i % 3}" for i in range(12)}
    index.write(records(spark, [(*k, v) for k, v in now.items()]), EMBEDDER)
    for step in range(4):
        changed = {(f"f{i % 4}", f"t{i}"): f"other text {step} {i}" for i in range(step, 14 + step, 3)}
        now |= changed
        if step == 2:  # one file goes with the same write
            now = {k: v for k, v in now.items() if k[0] != "f1"} | {k: v for k, v in changed.items() if k[0] == "f1"}
            index.write(records(spark, [(*k, v) for k, v in changed.items()]), EMBEDDER, True, lambda old: old.where("source_file = 'f1'"))
        else:
            index.write(records(spark, [(*k, v) for k, v in changed.items()]), EMBEDDER, True)
        assert state(index) == rebuilt(spark, tmp_path / f"r{step}", [(*k, v) for k, v in now.items()]), step
        assert len(index.meta()["segments"]) <= 4
    assert index.meta()["dead_rows"] == sum(s["dead"] for s in index.meta()["segments"])
    gone = index.remove(lambda old: old, EMBEDDER)
    assert gone["count"] == 0 and index.table("tf").count() == 0 and index.figures() == []
    index.write(records(spark, [("f", "t", "new words")]), EMBEDDER, True)
    assert state(index) == rebuilt(spark, tmp_path / "last", [("f", "t", "new words")])


def test_figures_beyond_the_pointer(spark, tmp_path, monkeypatch):
    index = I.Index(spark, str(tmp_path / "i"))
    index.write(records(spark, [("a", "t", "x"), ("b", "t", "y")]), EMBEDDER)
    known = sorted(index.figures())
    monkeypatch.setattr(I, "MOST_FIGURES", 1)
    index.write(records(spark, [("a", "t", "z")]), EMBEDDER, True)
    assert index.meta()["figures"] is None and sorted(index.figures()) == known


def test_two_writers(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "i"))
    index.write(records(spark, [("a", "t", "x")]), EMBEDDER)
    number = index._pointers()[-1]
    index.write(records(spark, [("b", "t", "x")]), EMBEDDER, True)
    with pytest.raises(I.Conflict):
        index._point({"segments": []}, number)
    assert index.count() == 2


def scanned(df) -> int:
    """Rows that the plan's scans gave out."""
    df.collect()
    nodes, rows = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        n = nodes.pop()
        name = n.nodeName()
        if name.startswith("Scan parquet"):
            rows += n.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            nodes.append(n.executedPlan())
        if "QueryStage" in name:
            nodes.append(n.plan())
        children = n.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows


def test_scans_read_what_is_asked_for(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(I, "ROW_GROUP", 20_000)
    index = I.Index(spark, str(tmp_path / "i"))
    rows = spark.range(6000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("source_file"), F.concat(F.lit("title"), F.col("id")).alias("title"), F.concat_ws(" ", *(F.substring(F.md5(F.concat(F.col("id"), F.lit(k))), 1, 4) for k in range(12))).alias("raw_text"))
    index.write(as_records(rows), EMBEDDER)
    tf = index.table("tf")
    tokens = [r["tok"] for r in tf.select("tok").distinct().orderBy("tok").limit(40).collect()][::10] + ["zzzz"]
    found = index.of_tokens("tf", tokens)
    found.explain("formatted")
    pushed = re.search(r"PushedFilters: (.*)", capsys.readouterr().out)[1]
    assert all(f"EqualTo(tok,{t})" in pushed for t in tokens)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tf.where(F.col("tok").isin(tokens)).collect()))
    assert scanned(found.select("id")) < tf.count() / 8
    ids = [r["id"] for r in index.table("records").select("id").orderBy(F.xxhash64("id")).limit(5).collect()]
    assert sorted(r["id"] for r in index.lookup([*ids, "nobody"]).collect()) == sorted(ids)
    assert scanned(index.lookup(ids).select("title")) < 6000
    assert index.get(ids[0]).count() == 1
    many = [r["id"] for r in index.table("records").select("id").limit(500).collect()]
    assert index.lookup(many).count() == 500


def test_literal_and_joined_tokens_agree(spark, tmp_path, monkeypatch):
    index = I.Index(spark, str(tmp_path / "i"))
    index.write(records(spark, [(f"f{i}", f"t{i}", f"alpha w{i % 3} foo_bar {'beta ' * (i % 4)}") for i in range(30)]), EMBEDDER)
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "foo_bar w2"), (2, "nothing here")], "qid int, query string")
    one = sorted(map(tuple, S.keyword_scores(queries, index).collect()))
    filtered = S.keyword_scores(queries, index, {"source_type": "unknown", "language": "und"})
    assert one == sorted(map(tuple, filtered.collect())) and {r[0] for r in one} == {0, 1}
    assert S.keyword_scores(queries, index, {"language": "mar"}).count() == 0
    monkeypatch.setattr(S, "MOST_LITERALS", 1)
    assert [r[:2] for r in one] == [r[:2] for r in sorted(map(tuple, S.keyword_scores(queries, index).collect()))]


def test_best_of_shards_are_the_best_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SHARD_TOKENS", 60)
    index = I.Index(spark, str(tmp_path / "i"))
    row = lambda i, more="": (f"f{i % 4}", f"t{i}", f"alpha w{i % 3} foo_bar {'beta ' * (i % 5)}{more}")
    index.write(records(spark, [row(i) for i in range(60)] + [("f0", "none", "")]), EMBEDDER)
    index.write(records(spark, [row(i, "renewed foo bar") for i in range(0, 60, 7)]), EMBEDDER, True)
    index.remove(lambda old: old.where("source_file = 'f1'"), EMBEDDER)
    packed = index._packed(index.meta())
    assert packed.select("shard").distinct().count() > 10 and packed.count() < index.table("postings").count()
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "foo_bar w2"), (2, "nothing here"), (3, "renewed")], "qid int, query string")
    for filters in (None, {"source_type": "unknown"}, {"language": "mar"}):
        every = S.keyword_scores(queries, index, filters).withColumn("score", F.round("score", 9))
        for k in (3, 1000):
            best = lambda rows: sorted(map(tuple, S.top_k(rows, k).select("qid", "rank", "id", "score").collect()))  # noqa: E731, B023
            assert best(S.keyword_scores(queries, index, filters, k=k)) == best(every), (filters, k)


def test_refresh_reads_only_what_changed(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "in", str(tmp_path / "i")
    (source / "sub").mkdir(parents=True)
    for name, text in {"a.md": "# A\nalpha", "b.md": "# B\nbeta", "sub/a.md": "# O\nother alpha", "x.csv": "Sr,Name\n1,Somebody here\n", "photo.png": "", "photo.ocr.txt": "seen words"}.items():
        (source / name).write_text(text)
    read, inner = [], engine.read_listed

    def listed(files, folder):
        read.append(sorted(r["name"] for r in files.select("name").collect()))
        return inner(files, folder)

    monkeypatch.setattr(engine, "read_listed", listed)
    refresh = lambda: engine.refresh_index(spark, root, str(source))
    texts = lambda: sorted(r["raw_text"] for r in engine.open_index(spark, root).table("records").collect())
    assert refresh()["count"] == len(texts()) and refresh() is None and len(read) == 1
    (source / "b.md").write_text("# B\nbeta changed")
    (source / "c.md").write_text("# C\ngamma")
    os.remove(source / "x.csv")
    assert refresh()["count"] == 5 and read[-1] == ["b.md", "c.md"]
    assert texts() == ["A\nalpha", "B\nbeta changed", "C\ngamma", "O\nother alpha", "seen words"]
    os.remove(source / "a.md")  # the other file of that name stays
    assert refresh() and read[-1] == ["a.md"] and "O\nother alpha" in texts() and "A\nalpha" not in texts()
    (source / "photo.ocr.txt").write_text("other words")
    assert refresh() and read[-1] == ["photo.ocr.txt", "photo.png"] and "other words" in texts() and "seen words" not in texts()
    (source / "bad.docx").write_bytes(b"no zip")
    assert refresh()["skipped"] == {"BadZipFile: File is not a zip file": 1}
    assert engine.search(spark, root, "gamma").hits[0]["title"] == "C" and refresh() is None


def test_bitmaps_are_the_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MOST_SEGMENTS", 2)
    index = I.Index(spark, str(tmp_path / "i"))
    made = lambda low, high: as_records(
        spark.range(low, high).select(
            F.concat(F.lit("f"), F.col("id")).alias("source_file"), F.lit("t").alias("title"), F.lit("word").alias("raw_text"), F.when(F.col("id") % 5 != 0, F.format_string("2025-%02d-01", F.col("id") % 12 + 1)).alias("date"),
            F.when(F.col("id") % 3 == 0, "eng").otherwise("mar").alias("language"), F.when(F.col("id") % 7 == 0, "Home").alias("department"),
        )
    )
    index.write(made(0, 300), EMBEDDER)
    index.write(made(280, 400), EMBEDDER, True)
    filters = [{"language": "eng"}, {"language": "eng", "department": "Home"}, {"date": ["2025-03-01", "2025-05-01"]}, {"date": "2025-02-01", "language": "mar"}, {"date": ["2025-03-01", "2025-11-01"], "language": "mar", "department": "Home", "bogus": 3}, {"language": "none"}, {"department": None}, {}]
    for step in range(3):
        for f in filters:
            only, want = index.allowed(f), {r["id"] for r in index.table("records").where(S.metadata_filter(f)).collect()}
            rows = index.table("lengths")
            assert {r["id"] for r in (only(rows) if only else rows).collect()} == want, (step, f)
        if step == 0:
            monkeypatch.setattr(I, "BROADCAST_BITMAPS", 0)
            index.write(made(395, 420), EMBEDDER, True, lambda old: old.where("department = 'Home'"))
        if step == 1:
            index.write(made(10, 30), EMBEDDER, True)
    docs = [r["doc"] for r in index.table("lengths").collect()]
    assert len(docs) == len(set(docs)) == index.count()
