"""Untidy tables for operators whose docstrings promise a result for them."""

import hashlib
import math

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestrata.llm import near_vectors, packing, quality, warc

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_near_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=5)
    rows = [(i, (base + rng.normal(size=5) * r).tolist()) for i, r in enumerate([0, 0.01, 0.02, 5, 5, 5, 0.01])]
    rows += [rows[0], rows[0], (20, rows[3][1]), (None, rows[0][1]), (21, None), (22, []), (23, [0.0] * 5), (24, [1.0, None, 2.0, 0.0, 0.0]), (25, [float("nan")] * 5), (26, [float("inf"), 1.0, 0.0, 0.0, 0.0])]
    rows += [(30, base[:4].tolist()), (31, (base[:4] * 2).tolist()), (32, [1.0]), (33, [3.0])]
    frame = spark.createDataFrame([(*r, "l", "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label string, id string, links int")

    def sound(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def linked(a, b):
        x, y = np.array(a), np.array(b)
        return len(a) == len(b) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95

    good = [r for r in rows if sound(r)]
    root = list(range(len(good)))
    pairs = [(i, j) for i in range(len(good)) for j in range(len(good)) if i != j and linked(good[i][1], good[j][1])]
    for _ in good:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j], key=lambda k: (good[k][0], k))
    want = [(good[i][0], sum(a == i for a, _ in pairs), good[root[i]][0], good[i][0] == good[root[i]][0]) for i in range(len(good))]
    want += [(r[0], 0, r[0], r[0] is not None) for r in rows if not sound(r)]
    got = near_vectors.near_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_quality_of_clashing_names(spark):
    text = {1: "good words that make a sentence about the river and its stones. ", 0: "zzz 000 ### zzz 111 $$$ "}
    rows = [(i, text[i % 2] * (3 + i % 4), "x", 0.5, 1, "en") for i in range(120)]
    rows += [rows[0], rows[0], (None, text[1], "x", 0.5, 1, None), (500, None, "x", 0.5, 1, None), (501, "", None, None, None, None), (502, text[1] * 2000, "x", 0.5, 1, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, score double, predicted int, _text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(None, 1, 0), (3, None, 0), (7, 1, 1)], "doc_id bigint, quality int, text int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.KEEP_FROM) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and quality.held_out(r["doc_id"]))
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] > 0.5 > scores[0] and scores[502] > 0.5 and abs(scores[500] - scores[501]) < 1e-6
    assert [r["score"] for r in quality.classify(docs.limit(3), labels.limit(0)).collect()] == [0.5] * 3
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_warc_of_untidy_pages(spark, tmp_path):
    big = "<p>" + "payload " * 300
    rows = [(1, None, big), (None, "http://a/%0A\n", big), (3, "", big), (4, "u", None), (4, "u", None), (None, None, "x" * 1000), (None, None, "x" * 1000), (7, "é\r\n", "small")]
    pages = spark.createDataFrame([(*r, "d", "t") for r in rows], "page_id bigint, url string, html string, payload_digest string, record_type string")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, url, len((t or "").encode()), digest(t), *(("revisit", 3) if t == big and i != 3 else ("response", None))) for i, url, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_very_long_texts_are_cut_into_pieces(spark):
    lib = Tokenizer.from_file(WORD)
    rows = [(1, "many words in one long text " * 900), (2, "short"), (3, None), (None, ""), (2, "short")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD).collect()
    n = len(lib.encode(rows[0][1], add_special_tokens=False).ids) + 1
    mine = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 1)
    assert mine == [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))] and len(mine) > 2
    assert sorted(str(r["doc_id"]) for r in got if r["doc_id"] != 1) == ["2", "2", "3", "None"] and all(r["length"] == 1 for r in got if r["doc_id"] in (3, None))
