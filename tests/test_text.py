import re

from conftest import value
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import embedding as E
from lodestrata.functions import records as R
from lodestrata.functions import tagging as G
from lodestrata.functions import text as T



def test_tokens(spark):
    assert value(spark, T.tokens(F.col("text")), "Water-supply 12, पाणी। x_y") == ["water", "supply", "12", "पाणी।", "x_y"]
    assert value(spark, T.tokens(F.col("text")), None) == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aé_1² क्षी।\n-'", max_size=20), min_size=1, max_size=30))
def test_tokens_match_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(T.tokens(F.col("text")).alias("v")).collect()
    assert [r["v"] for r in rows] == [[w.lower() for w in re.findall(r"[\wऀ-ॿ]+", t)] for t in texts]


def test_content_terms(spark):
    got = value(spark, T.content_terms(F.col("text")), "Show me all the letters to the President in 2025")
    assert got == ["president"]


def test_expand_terms(spark):
    got = value(spark, T.expand_terms(F.col("text")), "Letter to the President about water supply")
    assert "राष्ट्रपती" in got and "पत्र" in got and "water supply" in got and "president" not in got
    assert got == sorted(got)
    assert value(spark, T.expand_terms(F.col("text")), None) == []
    assert value(spark, T.with_aliases(F.col("text")), "") == ""


def test_languages(spark):
    for text, want in {"the cabinet met": "eng", "मुख्यमंत्री यांची बैठक": "mar", "राष्ट्रपति को पत्र में": "hin", "cabinet बैठक meeting झाली": "mixed", "123 !": "und", "": "und", None: "und"}.items():
        assert value(spark, T.detect_language(F.col("text")), text) == want, text


def test_dates(spark):
    cases = {
        "dated 14-06-2025 at": "2025-06-14", "on 2025/03/04": "2025-03-04", "19 April 2025": "2025-04-19", "Sept. 3, 2024": "2024-09-03", "none": None, "2025-02-31": "2025-02-31",
        "2025-13-40 then 14-06-2025": None, "12 apples 2025": None, "की14-06-2025": "2025-06-14", "१४-०६-२०२५": "2025-06-14", "x14-06-2025": None, "1899-01-01": None, None: None,
    }
    for text, want in cases.items():
        assert value(spark, G.parse_date(F.col("text")), text) == want, text


def test_tags(spark):
    assert value(spark, G.infer_department(F.col("text")), "CMO/OUT/2025/0142") == "Chief Minister's Office"
    assert value(spark, G.infer_department(F.col("text")), "Gadchiroli") == "General Administration"
    assert value(spark, G.infer_department(F.col("text")), "") is None
    assert value(spark, G.infer_category(F.col("text")), "cabinet approved the scheme") == "Cabinet Decisions"
    assert value(spark, G.infer_category(F.col("text")), "वॉर रूम आढावा") == "War Room"
    assert value(spark, G.infer_category(F.col("text")), None) == "Uncategorised"
    assert value(spark, G.extract_locations(F.col("text")), "from New Delhi to Mumbai") == ["Mumbai", "New Delhi", "Delhi"]
    assert value(spark, G.extract_entities(F.col("text")), "met Shri Anil Rao, then Shri Anil Rao and Hon'ble President") == ["Shri Anil Rao", "Hon'ble President"]


def test_record(spark):
    row = spark.createDataFrame([("f.csv", None, "row 2", "T")], "a string, b string, c string, d string")
    cols = [F.col(c) for c in "abcd"]
    got = row.select(R.record_id(*cols).alias("id"), R.provenance(*cols[:3]).alias("p")).first()
    import hashlib

    assert got["id"] == hashlib.sha1(b"f.csv|None|row 2|T").hexdigest()[:16]
    assert got["p"] == "f.csv · row 2"


def test_tag_fills_only_what_is_empty(spark):
    rows = spark.createDataFrame([("Letter to Hon'ble President", "dated 2025-02-11 Mumbai cabinet", "a.txt", "letter"), ("x", "cabinet", "b.txt", "deck")], "title string, raw_text string, source_file string, source_type string")
    a, b = G.tag(R.as_records(rows)).orderBy("source_file").collect()
    assert (a["date"], a["location"], a["category"], a["language"]) == ("2025-02-11", ["Mumbai"], "Uncategorised", "eng")
    assert a["entities"] == ["Hon'ble President"] and b["category"] == "Cabinet Decisions"


def test_snippet(spark):
    long = "word " * 60 + "target here " + "tail " * 60
    got = value(spark, T.snippet(F.col("text"), F.lit("t"), F.lit("TARGET")), long)
    assert got.startswith("…") and got.endswith("…") and "target here" in got and len(got) == 222
    assert value(spark, T.snippet(F.col("text"), F.lit("title"), F.lit("x")), "  ") == "title"
    assert value(spark, T.snippet(F.col("text"), F.lit("t"), F.lit("zzz")), "short") == "short"


def test_index_tokens(spark):
    assert value(spark, T.index_tokens(F.col("text")), "Café foo_bar राष्ट्रपती") == ["cafe", "foo", "bar", "र", "ष", "ट", "रपत"]


def test_embedders(spark):
    texts = ["quantum technology centre", "quantum technology center pune", "water supply metro corridor", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for e in (E.HashingEmbedder(256), E.NativeHashingEmbedder(256)):
        v = {r["id"]: [float(x) for x in r["vec"]] for r in e.embed(df, "text").collect()}
        cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))  # noqa: B023, E731
        assert abs(cos(0, 0) - 1) < 1e-5 and cos(0, 1) > cos(0, 2) and cos(3, 3) == 0
    native = E.NativeHashingEmbedder(64)
    one = {r["id"]: r["vec"] for r in native.embed(df, "text").collect()}
    sparse = {i: [0.0] * 64 for i in one}
    for r in native.sparse(df, "id", "text").collect():
        sparse[r["id"]][r["slot"]] = r["weight"]
    for two in (sparse, {r["id"]: r["vec"] for r in E.HashingEmbedder(64, digest="md5").embed(df, "text").collect()}):
        assert all(abs(a - b) < 1e-6 for i in one for a, b in zip(one[i], two[i], strict=True))
    assert E.get_embedder("auto").name == "hashing-ngram-v1"


def test_hashing_vectors_against_a_loop(spark):
    import hashlib
    import math

    texts = ["", None, "One two two, THREE", "पुणे शहर पुणे", "a" * 40 + " b_c", "x"]
    for dim, low, high, kind in ((768, 3, 5, "blake2b"), (50, 2, 3, "md5")):
        got = E.hashing_vectors(texts, dim, low, high, kind)
        for text, row in zip(texts, got, strict=True):
            want = [0.0] * dim
            for token in re.findall(r"[\w\u0900-\u097F]+", (text or "").lower()):
                padded = f"^{token}$"
                for f in [f"w:{token}", *(f"g:{padded[i : i + n]}" for n in range(low, high + 1) for i in range(len(padded) - n + 1))]:
                    h = hashlib.blake2b(f.encode(), digest_size=8).digest() if kind == "blake2b" else hashlib.md5(f.encode()).digest()
                    want[int.from_bytes(h[:6], "big") % dim] += 1 if h[6] % 2 else -1
            norm = math.sqrt(sum(x * x for x in want)) or 1.0
            assert max(abs(a - b / norm) for a, b in zip(row, want, strict=True)) < 1e-12
    assert E.HashingEmbedder(64).name != E.HashingEmbedder(128).name != E.HashingEmbedder().name == "hashing-ngram-v1"


def test_vector_topk(spark):
    from lodestrata.operators import search as S

    vectors = [(i, [float(i % 5), 1.0, -float(i % 3)]) for i in range(40)] + [(50, None), (51, [1.0, None, 2.0]), (52, [2.0]), (53, [1.0, 1.0, 1.0, 9.0])]
    queries = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
    v, q = spark.createDataFrame(vectors, "id int, vec array<double>").repartition(3), spark.createDataFrame(queries, "qid int, qvec array<double>")
    want = []
    for qid, a in queries[:3]:
        scores = sorted((-round(sum(x * y for x, y in zip(a, b)), 9), i) for i, b in vectors if b and None not in b)
        want += [(qid, i, -s, k) for k, (s, i) in enumerate(scores[:7], 1)]
    for block in (4096, 1):
        S.QUERY_BLOCK, kept = block, S.QUERY_BLOCK
        assert sorted(map(tuple, S.vector_topk(q, v, 7).select("qid", "id", "score", "rank").collect())) == sorted(want)
        S.QUERY_BLOCK = kept
    assert S.vector_topk(q.limit(0), v, 7).count() == S.vector_topk(q, v.limit(0), 7).count() == 0
