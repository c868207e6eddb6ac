"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ann, codec, collocations, conversations, decontaminate, html_text, jaccard_join, near_vectors, packing, pii, quality, sql, token_counts, warc

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call fills a new cache; the counts then come from what it appended."""
    docs, cache = table(spark, sf_dir, "documents"), scratch_path(spark, "token_counts")
    token_counts.fill_cache(docs, WORD_BPE, cache)
    return token_counts.count_tokens(docs, WORD_BPE, cache)


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_hilbert_ann, op2_best_fit_packing, op3_bpe_codec, op4_ngram_jaccard, op5_warc_archive, op6_html_main_text, op7_near_vectors,
    op8_quality_cnn, op9_token_counts, op10_pii_spans, op11_phrase_collocations, op12_decontamination, op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: Components by following links from every row.
_WALK = "r AS (SELECT id, id AS root FROM node UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)"

OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (x.n + y.n - count(*))),
node AS (SELECT doc_id AS id FROM documents), {_WALK}
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.id"""

OP5_SQL = f"""
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id <> latest THEN latest END AS refers_to FROM l"""

OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
node AS (SELECT vec_id AS id FROM embeddings), {_WALK}
SELECT c.id AS vec_id, (SELECT count(*) FROM p WHERE p.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c"""


def oracle_sql() -> dict[str, str]:
    """For those that SQL can say; the others are tested against brute force, the library or a round trip."""
    return {
        "op4_ngram_jaccard": OP4_SQL, "op5_warc_archive": OP5_SQL, "op7_near_vectors": OP7_SQL,
        "op11_phrase_collocations": sql.OP11_SQL, "op12_decontamination": sql.OP12_SQL, "op13_conversation_repair": sql.OP13_SQL,
    }
