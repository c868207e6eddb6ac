"""Each registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_terms_of_several_fragments(spark, tmp_path):
    texts = ["foo_bar one", "bar foo two", "राष्ट्रपति three", "other", "words", "here"]
    docs = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "foo_bar"), (1, "राष्ट्रपति")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("bm25_batch", "bm25_field_weighted"):
        assert {(r["qid"], r["id"]) for r in QUERIES[name](spark, str(tmp_path)).collect() if r["score"] > 0.1} == {(0, 0), (1, 2)}, name
    hybrid = QUERIES["hybrid_search_rrf"](spark, str(tmp_path)).collect()
    assert {(r["qid"], r["id"]) for r in hybrid if "keyword#1" in r["why"]} == {(0, 0), (1, 2)}


def cell(v):
    return "None" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = con.execute(ORACLES[name]).fetchdf()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda df: sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))
        assert rows(got) == rows(want)


def test_phrases_as_matrices_equal_joins(spark, monkeypatch, tmp_path):
    """The same ranks from matrices of phrases, in slices of a few rows, as from joined rows; no row for each record and
    query leaves a task."""
    from lodestrata.operators import index as I
    from lodestrata.operators import search as S
    from lodestrata.plans import queries as Q

    words = ["alpha", "beta", "gamma", "e-mail", "x-ray-y", "mail", "e", "ray"]
    rows = [(k, " ".join(words[(k * 7 + i * i) % len(words)] for i in range(k % 23)), "de", f"src{k % 3}", 0) for k in range(300)] + [(300, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.createDataFrame([(0, "e-mail alpha"), (1, "x-ray-y ray beta"), (2, "unknown"), (3, "alpha beta gamma mail")], "qid bigint, query string")
    ranked = lambda: sorted(map(tuple, Q._ranked(Q._keyword(spark, str(tmp_path), asked, I.WEIGHTS), 5).collect()))
    monkeypatch.setattr(S, "CELLS", 50)
    got = ranked()
    assert Q._keyword(spark, str(tmp_path), asked, I.WEIGHTS).groupBy("qid").count().agg({"count": "max"}).first()[0] <= Q.POOL * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(Q, "FEW_FRAGMENTS", 0)
    assert got == ranked() and {r[0] for r in got} == {0, 1, 3}


def test_small_tables_with_hard_rows_are_dealt_out(spark, tmp_path):
    """A table in one file is not one task where each row takes long."""
    from lodestrata.plans import inputs as N
    from lodestrata.plans import queries as Q

    spark.range(100).selectExpr("id as p_partkey", "'a name' as p_name", "'a type' as p_type", "'b' as p_brand", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(100).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for df in (Q.explicit_category(spark, str(tmp_path)), N.tag_texts(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
