"""Every operator on untidy tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import ann, codec, html_text, jaccard_join, near_vectors, packing, pii, quality, token_counts, warc
from lodestrata.llm.bpe import Encoder
from lodestrata.llm.components import components

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "many words in one very long text, " * 3000
TEXTS = [None, "", "   ", "one two", "Hello there, it's 2024!", "Hello there, it's 2024!", "<|endoftext|> inside", "Ünïcödé Σίσυφος 中文 😀", LONG, "x" * 5000, "a\x1cb c\x85d"]
SCHEMA = "doc_id bigint, text string, id int, score string, spans string, _text string, _id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "s", "p", "t", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", 7, "s", "p", "t", "i")], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_encoder_is_the_library():
    r = random.Random(5)
    plain, wide = "abcdefs'tmdrvel  \n\t\r\x0b\x1c\x85\xa0 ABCS'!?.,-_0123½²éÀßüÿ×µª", "Σσςİıжक्षी中文字😀​"
    texts = ["".join(r.choices(plain, k=r.randint(0, 60))) for _ in range(400)] + ["".join(r.choices(plain + wide, k=r.randint(0, 60))) for _ in range(300)]
    texts += [t or "" for t in TEXTS[:8]] + ["a" * 99, "'s 'll x'll", " \n", "<|startoftext|>a<|endoftext|>"]
    for path in (WORD, BYTE):
        enc, lib = Encoder(path, max_words=300), library(path)
        ids, counts = enc.encode_batch(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        if path == BYTE:
            assert [enc.decode_bytes(p)[0].tobytes().decode("utf-8", "replace") for p in parts] == [lib.decode(p.tolist(), skip_special_tokens=False) for p in parts]


def test_special_strings_in_linear_time():
    enc, lib = Encoder(BYTE), library(BYTE)
    text = "<|endoftext|>x" * 20_000 + "<|endoftext"
    began = time.perf_counter()
    ids, _ = enc.encode_batch([text])
    assert time.perf_counter() - began < 5 and ids.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_codec(docs, none):
    lib = library(BYTE)
    rows = codec.round_trip(docs, BYTE).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            ids = lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    back = codec.decode(codec.encode(docs, BYTE), BYTE).where("doc_id = 7").first()
    assert back["text"] == TEXTS[7] and codec.round_trip(none, BYTE).count() == 0


def test_token_counts(docs, none, tmp_path):
    lib, cache = library(WORD), f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all counts come from the cache
        for r in token_counts.count_tokens(docs, WORD, cache, limit=3).collect():
            if r["doc_id"] is not None:
                text = TEXTS[r["doc_id"]] or ""
                n = len(lib.encode(text, add_special_tokens=False).ids)
                assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 3)
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(none, WORD).count() == 0 == token_counts.count_tokens(none, WORD, cache).count()


def test_token_cache_meets_known_and_repeated_texts(spark, tmp_path, monkeypatch):
    """Each distinct text is encoded once, also with a filter so small that it holds nearly everything; nothing the second time."""
    lib = library(WORD)
    first = [(i, f"text number {i % 40} of them") for i in range(100)]
    more = [*first, *((i, f"another text {i % 70}") for i in range(100, 200)), (200, None), (None, "")]
    for bits in (2**28, 1):
        monkeypatch.setattr(token_counts, "FILTER_BITS", bits)
        cache = f"file://{tmp_path}/cache{bits}"
        frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)  # noqa: B023, E731
        assert token_counts.fill_cache(frame(first), WORD, cache) == 40
        assert token_counts.fill_cache(frame(more), WORD, cache) == 71
        assert token_counts.fill_cache(frame(more), WORD, cache) == 0
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == 111
        got = token_counts.count_tokens(frame(more), WORD, cache).collect()
        want = sorted((-1 if i is None else i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in more)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
        assert spark.read.parquet(cache).count() == 111


def test_packing(docs, none):
    lib, rows = library(WORD), packing.pack_documents(docs, WORD, capacity=64).collect()
    for r in rows:
        if r["doc_id"] is not None:
            ids = np.array([*lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")[r["start"] : r["start"] + r["length"]]
            assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, WORD).count() == 0


def test_best_fit():
    bins, at, fills = packing.best_fit(np.array([5, 5, 4, 6, 10, 1, 9]), 10)
    assert sorted(fills.tolist()) == [10, 10, 10, 10] and fills.max() <= 10
    assert all(at[i] + n <= fills[b] for i, (b, n) in enumerate(zip(bins, [5, 5, 4, 6, 10, 1, 9], strict=True)))


def test_packing_merges_over_partitions(spark):
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 50 + 1).cast("int")).alias("text")).repartition(7)
    rows = packing.pack_documents(many, WORD, capacity=64).collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * sum(r["length"] for r in rows) / 64 + 1


def test_packing_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLACK", 0.0)
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 7 % 61 + 1).cast("int")).alias("text")).repartition(40)
    by = {}
    for r in packing.pack_documents(many, WORD, capacity=64, fan_in=2).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_sets_of_one_number_are_told_apart(spark, tmp_path):
    rows = [(1, 3, 77, 5), (2, 3, 77, 5), (3, 3, 77, 9), (4, 3, 77, 11), (5, 3, 78, 1), (6, 0, 0, 0)]
    renamed = jaccard_join.namesakes(spark.createDataFrame(rows, "id int, n_shingles bigint, set bigint, second bigint"))
    assert set(renamed) == {(77, 9), (77, 11)} and len({*renamed.values(), 77, 78}) == 4
    batch = pa.RecordBatch.from_pydict({"text": ["one two three", "four", "one two three", ""]})
    [(_, _, sizes, numbers, second)] = jaccard_join._sets([batch], 5, {})
    assert numbers[0] == numbers[2] != numbers[1] and second[0] != numbers[0] and sizes.tolist() == [1, 1, 1, 0]
    [(_, _, _, again, _)] = jaccard_join._sets([batch], 5, {(int(numbers[0]), int(second[0])): 123, (int(numbers[1]), 0): 9})
    assert again.tolist() == [123, numbers[1], 123, 0]
    assert jaccard_join.namesakes(spark.createDataFrame(rows[:2], "id int, n_shingles bigint, set bigint, second bigint")) == {}
    files = spark.range(9)
    files.write.parquet(f"{tmp_path}/t")
    assert not hasattr(jaccard_join._settled(spark.read.parquet(f"{tmp_path}/t").where("id > 1")), "stored_at")
    assert hasattr(jaccard_join._settled(spark.read.parquet(f"{tmp_path}/t").repartition(3)), "stored_at")


def test_jaccard_join(spark, docs, none, monkeypatch):
    r = random.Random(11)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base if i % 2 else base[:60] + [f"v{i}_{k}" for k in range(60)])
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"e{r.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    rows += [(1000, "a b c"), (1001, "A  b\tc"), (1002, ""), (1003, None), (1004, rows[3][1])]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in root}
    # many batches and buckets, so that requests are cut
    for name, few in (("BATCH_SETS", 7), ("BATCH_SHINGLES", 900), ("BUCKET_SHINGLES", 1500)):
        monkeypatch.setattr(jaccard_join, name, few)
    assert got == {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    monkeypatch.undo()
    untidy = jaccard_join.jaccard_components(docs)
    assert {(r["doc_id"], r["component_id"]) for r in untidy.where("doc_id in (4, 5, 1)").collect()} == {(4, 4), (5, 4), (1, 1)}
    kept = jaccard_join.one_of_each(docs, untidy)
    assert kept.count() == len(TEXTS) and kept.columns == docs.columns
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_requests_of_sets_and_copies(spark, monkeypatch, tmp_path):
    """What goes to the buckets doesn't grow with sets times buckets, and equal sets of several tasks go there once."""
    text = lambda i: " ".join(f"w{i * 7 + k}x{i}" for k in range(30))
    rows = [(i, text(i)) for i in range(400)]
    docs = lambda rows, n=1: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
    sent = lambda df, buckets, *copied: [r for r in jaccard_join.packed_postings(df, 5, buckets, "doc_id", "text", {}, *copied).collect() if r["bucket"] >= 0]
    size = lambda found: sum(len(r[c]) for r in found for c in ("lone", "places", "sets", "repeated", "counts"))
    assert size(sent(docs(rows), 40)) < 1.2 * size(sent(docs(rows), 1))
    # 300 copies of 10 texts in other files, under ids of their own, null ids and ids that are repeated
    copies = [(None if i % 5 == 0 else i % 50 if i % 5 == 1 else 1000 + i, text(i % 10)) for i in range(300)]
    spark.createDataFrame(rows + copies, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    many = spark.read.parquet(f"{tmp_path}/docs")
    copied = jaccard_join.copied_sets(jaccard_join.document_sets(many, 5, "doc_id", "text"))
    assert len(copied[0]) == 10 and (np.diff(copied[0]) > 0).all()
    once = sent(many, 1, (copied[0], copied[1]))
    lone = np.concatenate([jaccard_join._unpack(r["lone"]) for r in once])
    assert len(np.unique(lone)) == 400 * 26
    least = {i: min(k for k, x in rows + copies if x == text(i) and k is not None) for i in range(10)}
    want = sorted((str(k), 26, str(least[i] if (i := int(x.split()[0].split("x")[1])) < 10 else k)) for k, x in rows + copies)
    for most in (jaccard_join.MOST_COPIED, 3):
        monkeypatch.setattr(jaccard_join, "MOST_COPIED", most)
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.jaccard_components(many).collect()) == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 90: 90, 100: 90}


def test_warc(spark, tmp_path):
    big = "<p>" + "text " * 400
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2\r\n%", big, 0), (3, None, big, 0), (4, "u", "small", 0), (5, "u", "small", 0), (6, "u", None, 0), (None, "u", big, 0), (3, None, big, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    got = sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str)
    def want(i, u, h):
        raw = (h or "").encode()
        again = h == big and i != 3
        return i, u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None
    assert got == sorted((want(*r[:3]) for r in rows), key=str)
    warc.write_archives(pages.limit(0), f"{path}0")
    assert warc.read_archives(spark, f"{path}0").count() == 0


def test_warc_frames():
    samples = [f"<html>{i} some page about {i % 7} things</html>".encode() * 40 for i in range(100)]
    writer = warc.ArchiveWriter(warc.train(samples))
    raws = [warc.page_record(i, "u", s, len(s), hashlib.sha1(s).hexdigest(), None, False, str(i)) for i, s in enumerate(samples)]
    for x in raws:
        writer.add(x)
    data = writer.content() + warc.SEPARATOR.encode()
    assert list(warc.read_frames(data)) == raws and warc.read_page(raws[5])[0] == 5
    for bad in (data[: len(data) // 2], b"\x00" * 20, data[:12]):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(bad))
    for bad in (raws[0].replace(b"WARC/1.1", b"WARC/9"), raws[0][:-3], raws[0].replace(b"some page", b"same page")):
        with pytest.raises(warc.WarcError):
            warc.read_page(bad)


def test_warc_frames_in_linear_time():
    writer = warc.ArchiveWriter(b"")
    raws = [b"r%d" % i + bytes(i % 999) for i in range(20_000)] + [b"", random.Random(1).randbytes(300_000)]
    for x in raws:
        writer.add(x)
    data, began = writer.content(), time.perf_counter()
    assert list(warc.read_frames(data)) == raws and time.perf_counter() - began < 2


def test_warc_joins_many_repeated_payloads(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"{i % 40 if i < 400 else 7:04} " * 300 if i % 2 else "small") for i in range(800)]
    pages, got = spark.createDataFrame(rows, "page_id bigint, url string, html string"), []
    for most in (warc.BROADCAST_GROUPS, 3):
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", most)
        warc.write_archives(pages, path := f"file://{tmp_path}/{most}")
        got.append(sorted(map(tuple, warc.read_archives(spark, path).collect())))
    last = {html: i for i, _, html in rows}
    assert got[0] == got[1] and [(r[0], r[5]) for r in got[0]] == [(i, last[h] if h != "small" and last[h] != i else None) for i, _, h in rows]


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header>Site</header><article><h1>Head &amp; line</h1><p>First  para <b>bold</b>
<p>Second&nbsp;para<br>more</p><form>Sign up</form><aside>Side</aside><ul><li>item one<li>item two</ul><div class="ad">Buy</div></article>
<section id="comments"><p>First comment</p></section><footer>Foot</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst para bold\nSecond para more\nitem one\nitem two"
    assert html_text.extract(HTML) == want
    no_article = HTML.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.extract(no_article) == want
    rows = [(1, "u", HTML, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>&am", "x"), (5, "u", "<p" * 9000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_main_text(pages).collect()}
    assert got[1] == (want, len(want)) and got[2] == ("", 0) and got[3] == ("", 0) and got[None] == ("&am", 3)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_html_keeps_the_whole_content_section():
    long, short = "word " * 120 + "end", "short " * 15 + "end"
    box = f"<body><div><a href=/>Home</a></div><div id=content><h1>Title</h1><p>{long}</p><div class=box><p>{short}</p></div></div></body>"
    assert html_text.extract(box) == f"Title\n{long}\n{short}"
    parts = "".join(f"<section><h2>Part {i}</h2><p>{short}</p></section>" for i in range(9))
    sections = f"<body><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><div><section><p>{long * 5}</p></section>{parts}</div></body>"
    assert html_text.extract(sections).count("\n") == 18
    assert html_text.extract(f"<body><div><a href=/>{short}</a></div><div><p>{long}</p><p><a href=/>{short}</a></p></div></body>") == f"{long}\n{short}"


def test_html_class_names_are_whole():
    text = "word " * 60 + "end"
    for page in ('<body class="has-sidebar"><p>{}</p></body>', '<article class="post no-sidebar ad-free"><p>{}</p></article>', '<div class="content with-sidebar"><p>{}</p></div>', '<body class="sidebar"><p>{}</p></body>', '<div class="notice"><p>{}</p></div>', '<div id="promo"><div class="ad">Buy</div><article><p>{}</p></article></div>', '<main role="main" class="social"><p>{}</p></main>'):
        assert html_text.extract(page.format(text)) == text, page
    for name in ("discussion", "related-work"):
        assert html_text.extract(f'<article><h2 id="{name}">Name</h2><p>{text}</p></article>') == f"Name\n{text}"
    comments = f'<section class="comments"><p>{text}</p><p>{text}</p></section>'
    assert html_text.extract(f'<article><p>{text}</p></article>{comments}<div class="ad" hidden>Buy</div>') == text


def test_html_named_sections_are_whole():
    long, short = "word " * 120 + "end", "short " * 15 + "end"
    assert html_text.extract(f"<main><h1>Title</h1><p>lead</p><article>{long}</article></main><div>{short}</div>") == f"Title\nlead\n{long}"
    assert html_text.extract(f"<body><div><article>{long}</article><article>{short}</article></div><div><a href=/>Home</a></div></body>") == f"{long}\n{short}"
    teaser = f"<body><div><article><a href=/>Read this</a></article></div><div><h1>Title</h1><p>{long}</p><p>{short}</p></div></body>"
    assert html_text.extract(teaser) == f"Title\n{long}\n{short}"


def made_page(r, kind, paragraphs):
    """(html, text): a page put together from blocks, and what is content in it."""
    word = lambda n: " ".join(r.choice(["river", "stone", "café", "walk", "&amp;", "light", "seven", "under"]) for _ in range(n))
    shown = lambda x: x.replace("&amp;", "&")
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{i}>{word(2)}</a></li>" for i in range(n)) + "</ul>"
    body, want = [], []
    for i in range(paragraphs):
        text = word(r.randint(25, 90))
        body.append(r.choice([f"<p>{text}</p>", f"<p class='p{i}'>  {text}\n</p>", f"<blockquote><p>{text}</p></blockquote>", f"<p>{text} <br/> <b>{word(1)}</b></p>"]))
        want.append(" ".join(shown(re.sub(r"<[^>]+>", " ", body[-1])).split()))
        if r.random() < 0.3:
            short = word(2)
            body.append(f"<h3>{short}</h3>")
            want.append(shown(short))
        if r.random() < 0.2:
            body.append(r.choice([f"<div class='ad'>{word(9)}</div>", f"<form><p>{word(4)}</p><button>{word(1)}</button></form>", f"<aside>{word(12)}</aside>", "<script>if (a<b) {x='<p>'}</script>"]))
    inner = "\n".join(body)
    content = {"article": f"<article>{inner}</article>", "main": f"<main><div>{inner}</div></main>", "div": f"<div id=c1>{inner}</div>", "nested": f"<div><div class=x><section>{inner}</section></div></div>"}[kind]
    top, side, foot = f"<div class=x9>{links(8)}</div>", f"<div class=s7>{links(6)}</div>", f"<footer><p>{word(8)}</p></footer>"
    return f"<html><head><title>{word(3)}</title></head><body class='has-sidebar'><header>{word(2)}</header><nav>{links(3)}</nav>{top}{content}{side}{foot}</body></html>", "\n".join(want)


def test_html_of_made_pages():
    r = random.Random(21)
    for kind in ("article", "main", "div", "nested"):
        for k in range(60):
            html, want = made_page(r, kind, r.randint(2, 12))
            assert html_text.extract(html) == want, (kind, k)
    html, want = made_page(r, "div", 4000)
    assert len(want) > 500_000 and html_text.extract(html) == want


def test_html_clusters_decide(monkeypatch):
    """Without the smoothed ratios, every line a cluster, pages whose markup names no content keep what lies beside it."""
    r = random.Random(22)
    pages = [made_page(r, kind, r.randint(3, 9)) for kind in ("div", "nested") for _ in range(20)]
    plain = "<body><div>Home page</div><div>{}</div><div>All rights kept</div></body>"
    text = "word " * 60 + "end"
    pages += [(plain.format(f"<p>{text}</p><p>short</p><p>{text}</p>"), f"{text}\nshort\n{text}")]
    assert all(html_text.extract(html) == want for html, want in pages)
    monkeypatch.setattr(html_text, "_clustered", lambda lines: ([True] * len(lines),) * 2)
    assert html_text.extract(pages[-1][0]) != pages[-1][1]
    monkeypatch.setattr(html_text, "_clustered", lambda lines: ([k == 0 for k in range(len(lines))],) * 2)
    assert not any(html_text.extract(html) == want for html, want in pages)


def test_smoothing_is_brute_force():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        x = r.uniform(0, 90, n)
        reach = range(-6, 7)
        want = []
        for i in range(n):
            near = [(np.exp(-0.5 * (d / html_text.SIGMA) ** 2), x[i + d]) for d in reach if 0 <= i + d < n]
            want.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        assert np.allclose(html_text.smoothed(x), want)
        lines = [html_text.Line("y" * int(v), 1, False, False, 0, 0, 0, 0) for v in x]
        smooth = html_text.smoothed(np.floor(x))
        least = min(smooth.max(), max(smooth.std(), 1e-9))
        own = np.floor(x)
        dense = max(least, min(own.std(), html_text.DENSE))
        assert html_text._clustered(lines) == ([v >= least for v in smooth], [v >= least and w >= dense for v, w in zip(smooth, own, strict=True)])


def test_html_never_fails():
    r = random.Random(8)
    bits = ["<", ">", "<![", "<!--", "-->", "<!", "</", "<p", "<div class='ad'>", "</div>", "&", "&#", ";", "text", "<![CDATA[", "]]>", "<script>", "</script", "'", '"', "=", "<article>", "<?", " "]
    for _ in range(2000):
        html_text.extract("".join(r.choices(bits, k=r.randint(0, 30))))


def plain_by_regex(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_plain_is_the_patterns():
    r = random.Random(2)
    for alphabet in ("ab@@..0123 -+(%9", "00411 -+"):
        for _ in range(4000):
            t = "".join(r.choices(alphabet, k=r.randint(0, 50)))
            assert pii.plain_spans(t) == plain_by_regex(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_disguised(docs, none):
    cases = {
        "mail john.doe (at) example (dot) com now": ("email", "john.doe (at) example (dot) com"), "to john at example dot com please": ("email", "john at example dot com"), "аdmin@exаmple.com": ("email", "аdmin@exаmple.com"),
        "call plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"), "one two seven dot zero dot zero dot one": ("ip", "one two seven dot zero dot zero dot one"),
        "１９２.168.0.1": ("ip", "１９２.168.0.1"), "look at example.com": None, "I was at home dot then": None, "six of one": None,
    }
    for text, want in cases.items():
        got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))]
        assert got == ([want] if want else []), text
    rows = pii.digest(pii.find_pii(docs, keep=("text", "score"))).collect()
    assert len(rows) == len(TEXTS) + 2 and {r["spans"] for r in rows} == {""}
    df = docs.sparkSession.createDataFrame([(1, "a@b.co and +1 (603) 555-8791, 1.2.3.4 x")], "doc_id bigint, text string")
    found = pii.find_pii(df, keep=("text",))
    assert found.select(pii.mask(F.col("text"), F.col("spans"))).first()[0] == "[EMAIL] and [PHONE], [IP] x"
    assert pii.digest(found).first()["spans"] == "email:0:6,ip:30:37,phone:11:28" and pii.digest(pii.find_pii(none)).count() == 0


def test_pii_disguises_alone():
    whole = {
        "email": ["john_at_example_dot_com", "a.b-at-mail-dot-example-dot-org", "bob [@] example.com", "bob(@)example[.]com", "𝐛𝐨𝐛@example.com", "bob@xyz [dot] com", "john at example [dot] com", "john at example dot com", "juan arroba ejemplo punto com", "hans at beispiel punkt de", "jean at exemple point fr", "jean@exemple point fr", "john @ example . com", "max klammeraffe example punkt de", "jean arobase example point fr", "john&#64;example.com", "john&#x40;example&period;com", "ann [klammeraffe] mail.example"],
        "phone": ["+٤٩ ٣٠ ١٢٣٤٥٦٧", "+1 𝟔𝟎𝟑 555 8791", "plus one five five five oh two oh four five six seven", "plus one double five five oh two triple four six", "+49 one seven one 234567"],
        "card": ["4111 one one one one 1111 1111", "four one double one 1111 1111 1111"],
        "ip": ["192[.]168[.]0[.]1", "१९२.१६८.0.१", "10[dot]0[dot]0[dot]1", "192 dot 168 dot 0 dot 1", "127 dot zero dot zero dot one", "192 punto 168 punto uno punto 1", "one nine two dot 168 dot 0.1", "192 . 168 . 0 . 1"],
    }
    for kind, cases in whole.items():
        for case in cases:
            text = f"see {case}, then more"
            assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))] == [(kind, case)], text
    text = "john at example dot com point mary at example dot org"
    assert [text[a:b] for _, a, b in pii.disguised_spans(text, [])] == ["john at example dot com", "mary at example dot org"]
    for text in ("look at this point in time", "we were at that point online", "look at example.com", "300 dot 168 dot 0 dot 1", "1 dot 2 dot 3", "meet @ home . it was late", "one of 2019 and two of 2020", "R&amp;D &#13; double room", "1 . 2 . 3"):
        assert pii.disguised_spans(text, []) == [], text


def test_pii_spelled_over_lines_and_mixed():
    for case in ("plus one\n     five\n     five\n     five\n     one\n     two\n     three\n     four", "plus one 5 five 5 five 1 two 3 four 5"):
        text = f"call {case} now"
        assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.disguised_spans(text, [])] == [("phone", case)], text


def test_pii_looks_lose_nothing():
    r = random.Random(9)
    bits = ["one", "two", "oh", "five", "Seven", "5", "2", "12", " ", " ", "  ", "\n", ",", "-", ".", " dot ", " point ", "plus ", "+", "_", "x", "at"]
    for _ in range(6000):
        text = "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(3, 24)))
        if pii._spelled(text):
            assert pii.TWO_DIGITS.search(f" {text.lower()}"), text


def test_pii_digest_is_brute_force(spark):
    r = random.Random(6)
    parts = ["a.b@c.de ", "x@y.z.w,", "1.2.3.4", "300.1.2.3 ", "4111 1111 1111 1111 ", "4111-1111-1111-1112", "+1 (603) 555-8791", "+49 30 ", "…é😀 ", "word ", "\n", "."]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "w " * 50_000 + "a@b.co")]
    got = {x["doc_id"]: x for x in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    for i, text in rows:
        base = sorted(plain_by_regex(text or ""))
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(k == n for k, *_ in base) for n in range(4)]
        assert set(said.split(",")) <= set(got[i]["spans"].split(",")) | {""}


def test_quality(spark, docs, none):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "river", "was", "calm", "and", "wide"]) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["the***", "buy!!", "###", "$$$", "now%%%"]) for _ in range(60))
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id bigint, quality int")
    got = quality.classify(df, labels).collect()
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x["predicted"] == int(x["doc_id"] % 3 != 0) for x in held) >= 0.95 * len(held)
    scored = quality.classify(docs, labels.limit(0)).collect()
    assert len(scored) == len(TEXTS) + 2 and all(0 <= x["score"] <= 1 for x in scored)
    assert quality.classify(none, labels).count() == 0


def plain_score(net, text):
    """The network's probability, window by window."""
    raw, w = text or b"\0", {k: v.astype(np.float64) for k, v in net.w.items()}
    padded, chunks = raw + bytes(quality.WIDTH - 1), []
    for a in range(0, len(raw), quality.CHUNK):
        windows = [w["embed"][list(padded[i : i + quality.WIDTH])].reshape(-1) for i in range(a, min(len(raw), a + quality.CHUNK))]
        chunks.append(np.maximum((np.array(windows) @ w["filters"]).max(0) + w["bias"], 0))
    z = np.mean(chunks, 0) @ w["mix"][: quality.FILTERS] + np.max(chunks, 0) @ w["mix"][quality.FILTERS :] + w["offset"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_brute_force(spark):
    r = random.Random(3)
    batch = [b"", b"x", "Ünïcödé 中文".encode(), *(bytes(r.choices(range(256), k=n)) for n in (7, 8, 255, 256, 257, 511, 3000))]
    net = quality.ByteConvNet.fresh(5)
    assert np.abs(net.scores(batch) - [plain_score(net, x) for x in batch]).max() < 1e-5
    rows = [(i, x.decode("latin-1")) for i, x in enumerate(batch)] + [(99, None)]
    got = {x["doc_id"]: x["score"] for x in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"), net).collect()}
    assert all(abs(got[i] - plain_score(net, (t or "").encode())) < 1e-5 for i, t in rows)


def test_training_chunks():
    text = bytes(i % 251 for i in range(100_000))
    drawn = quality.training_chunks(text)
    assert len(drawn) == quality.EPOCHS * quality.TRAIN_CHUNKS and all(x in text and len(x) <= quality.CHUNK + quality.WIDTH - 1 for x in drawn)
    assert quality.training_chunks(b"ab") == [b"ab"]
    assert len(quality.training_chunks(b"")) == 1 and len(quality.training_chunks(text[:1000])) == 4


def test_labels_that_disagree_teach_nothing(spark):
    rows = [(i, "good words here" if i % 2 else "### $$$ !!!") for i in range(60)]
    docs_ = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    odd = labels.union(labels.selectExpr("doc_id", "1 - quality"))
    nets = [quality.train(docs_, x) for x in (labels, odd)]
    assert len(set(nets[0].scores([b"good words here", b"### $$$ !!!"]).round(3))) == 2
    assert nets[1].scores([b"good words here", b"### $$$ !!!"]).round(6).tolist() == [0.5, 0.5]


def test_whole_text_is_scored():
    net = quality.ByteConvNet.fresh()
    text = (b"plain words " * 100_000)[:999_983] + b"###$$$!!!"
    assert net.scores([text])[0] != net.scores([text[:-9]])[0]
    assert abs(net.scores([b"", text, b"x"])[1] - net.scores([text])[0]) < 1e-6


VECTORS = "vec_id bigint, embedding array<float>, label int, id int"


def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[100:140] = x[100] + 0.05 * r.normal(size=(40, 16))
    x[200:206] = x[200]
    rows = [(i, [float(v) for v in row], 0, 1) for i, row in enumerate(x.astype(np.float32))]
    odd = [(900, None, 0, 1), (901, [0.0] * 16, 0, 1), (902, [float("nan")] + [1.0] * 15, 0, 1), (903, [None] + [1.0] * 15, 0, 1), (904, [], 0, 1), (905, [float("inf")] * 16, 0, 1)]
    return spark.createDataFrame(rows + odd, VECTORS), np.array([row[1] for row in rows], np.float64)


def test_near_vectors(spark):
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (low == root).all():
            break
        root = low
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()}
    assert all(got[i] == (near[i].sum(), root[i], root[i] == i) for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_travel_in_groups(spark, monkeypatch):
    """Many tiles in few groups: the same links, also across groups, and no more shuffled rows than tiles times groups."""
    monkeypatch.setattr(near_vectors, "TILE", 8)
    monkeypatch.setattr(near_vectors, "GROUPS", 3)
    monkeypatch.setattr(near_vectors, "LEADING", (0.5, 1.0))
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(1).tolist()
    tiles = near_vectors.stored(df.where("vec_id < 900").select(F.col("vec_id").alias("id"), F.lit(1).cast("bigint").alias("copies"), F.col("embedding").cast("array<double>").alias("vec")), "t")
    found = near_vectors._linked(tiles, 0.95)
    assert found.groupBy("id").count().agg(F.max("count")).first()[0] <= 3


def test_nearest(spark):
    df, x = vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 5, recall=1.0).collect():  # measured on all queries, so exact
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        assert [v for _, v in sorted(found)] == want.tolist()
    small = {r["vec_id"] for r in ann.nearest(df.where("vec_id < 3"), F.col("id") == 0, 5).collect()}
    assert small == {1, 2} and ann.nearest(df.limit(0), F.lit(True)).count() == 0
    repeated = df.union(df.where("vec_id < 40")).union(df.sparkSession.createDataFrame([(None, [1.0] * 16, 0, 1), (950, [1.0] * 3, 0, 1), (960, [2.0, 0.0, 1.0], 0, 1)], VECTORS))
    again = {}
    for r in ann.nearest(repeated, F.col("id") % 20 == 0, 5, recall=1.0).collect():
        again.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: sorted(v) for q, v in again.items()} == {**{q: sorted(v) for q, v in got.items()}, 960: [(1, 950)]}
    keys = ann.hilbert_keys(np.array([[a, b] for a in range(8) for b in range(8)]), 3)
    cells = [divmod(int(k), 8) for k in np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(64)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(cells, cells[1:], strict=False))


def test_nearest_takes_several_curves(spark):
    r = np.random.default_rng(12)
    centres = r.normal(size=(60, 16))
    kinds = {"unstructured": r.normal(size=(3000, 16)), "clustered": centres[r.integers(0, 60, 3000)] + 0.2 * r.normal(size=(3000, 16)), "long and short": r.normal(size=(3000, 16)) * r.uniform(0.5, 2, (3000, 1))}
    reach = {}
    for kind, x in kinds.items():
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
        seen = []
        measure = ann.window_reach
        try:
            ann.window_reach = lambda places, near, curves, n, size, recall: seen.append((n, size)) or seen.append(measure(places, near, curves, n, size, recall)) or seen[-1]
            got = {(a["query_id"], a["vec_id"]) for a in ann.nearest(df, F.col("id") % 10 == 0, 10, block=32, sample=40).collect()}
        finally:
            ann.window_reach = measure
        reach[kind] = seen[-1]
        x = x.astype(np.float64)
        scores = x[::10] @ x.T
        scores[np.arange(300), np.arange(0, 3000, 10)] = -np.inf
        want = {(10 * q, int(i)) for q, row in enumerate(scores) for i in np.argsort(-row)[:10]}
        assert len(got & want) >= 0.9 * len(want), kind
        assert 2 * reach[kind] + 1 < 94, kind  # no curve's window holds the whole table
    assert reach["clustered"] < 0.6 * reach["unstructured"]


def test_windows_reach_what_they_say():
    for blocks in (1, 2, 5, 12):
        for own in range(blocks):
            for reach in range(blocks):
                first = max(0, min(own - reach, blocks - 1 - 2 * reach))
                window = range(first, min(blocks - 1, first + 2 * reach) + 1)
                assert all((ann._reach_of(own, other, blocks) <= reach) == (other in window) for other in range(blocks))


def components_by_force(sets):
    """Smallest id reachable by links, from a dict of shingle sets."""
    root = {i: i for i in sets}
    ids = sorted(sets)
    while True:
        low = dict(root)
        for k, x in enumerate(ids):
            for y in ids[k + 1 :]:
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    low[x] = low[y] = min(low[x], low[y])
        if low == root:
            return root
        root = low


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels all documents pass; of equal ones the first stays, and one of the repeated rows
    assert sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}) == [i for i in range(len(TEXTS)) if i != 5]
    masked = corpus_pipeline.mask_personal_data(spark, docs, "").collect()
    assert len(masked) == len(TEXTS) + 2 and corpus_pipeline.mask_personal_data(spark, docs, "").columns == docs.columns


def test_pipeline_is_brute_force(spark, none, tmp_path):
    import corpus_pipeline

    r = random.Random(14)
    words = [f"{a}{b}" for a in ("ri", "sto", "la", "me", "wa") for b in ("ver", "ne", "mp", "lk", "ter", "n")]
    prose = lambda: [r.choice(words) for _ in range(r.randint(20, 60))]
    junk = lambda: " ".join(r.choice(["$$$", "buy!!!", "@@##", "%%%%", "click***"]) for _ in range(40))
    rows, labels = [], []
    for i in range(0, 240, 2):
        text = prose()
        rows.append((i, " ".join(text)))
        text[r.randrange(len(text))] = "changed"
        near = " ".join(text) if i % 3 else junk()
        rows.append((i + 1, near + (" mail a.b@c.org or +1 (603) 555-8791" if i % 4 == 0 else "")))
        labels += [(i, 1), (i + 1, int(bool(i % 3)))]
    rows += [(900, ""), (901, None), (902, " ".join(prose() * 400))]
    docs_ = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    docs_.write.parquet(f"{tmp_path}/documents.parquet")
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int")
    truth.write.parquet(f"{tmp_path}/labels.parquet")
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"]))
    net, texts = quality.train(docs_, truth), dict(rows)
    good = {i: shingles(t) for i, t in rows if plain_score(net, (t or "").encode()) >= quality.KEEP_FROM}
    assert {i for i, t in rows if t and "$$$" in t}.isdisjoint(good) and len(good) > 150
    kept = [i for i, root in components_by_force(good).items() if i == root]
    assert sorted(got) == sorted(kept) and len(kept) < len(good)
    lib = library(WORD)
    for i in kept:
        text = texts[i] or ""
        for kind, a, b in sorted(plain_by_regex(text), key=lambda x: -x[1]):
            text = f"{text[:a]}[{pii.KINDS[kind].upper()}]{text[b:]}"
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want = [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
        assert sorted(got[i]) == want, i
    empty = tmp_path / "empty"
    docs_.limit(0).write.parquet(f"{empty}/documents.parquet")
    truth.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
