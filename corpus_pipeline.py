"""Filtering a corpus in four stages, each by one operator of lodestrata.llm, over all documents the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again for the next stage. All but the last return the columns of documents.

In every stage null and empty texts and null ids are rows like others, equal texts are treated alike, repeated rows stay
repeated where nothing below says otherwise, an empty table gives an empty table, and columns beyond doc_id and text pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import jaccard_join, packing, pii, quality
from lodestrata.llm.queries import WORD_BPE, table
from lodestrata.session import stored

def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, so that no operator's columns clash with them."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(docs[c] for c in docs.columns if c not in ("doc_id", "text"))).alias("_row"))


def _columns(docs: DataFrame, changed: dict[str, Column]) -> list[Column]:
    return [changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("_row")[c]).alias(c) for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network predicts label 1 for; it is trained on the labels table and the documents
    of this stage. Without documents of both labels it scores the share of label 1 for all, so all stay or all go. Null
    and empty texts are scored as one zero byte."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(_with_row(docs), net, keep=("text", "_row"))
    return scored.where(F.col("score") >= quality.KEEP_FROM).select(*_columns(docs, {}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id; documents without words all stay. Of rows
    with one id one stays; rows with a null id stay unless their component has an id."""
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_components(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each identifier is replaced by its kind in brackets; n_chars is the new length, null where the text is null."""
    found = pii.find_pii(_with_row(docs), keep=("text", "_row"))
    text = F.when(F.col("text").isNotNull(), pii.mask(F.col("text"), F.col("spans")))
    return found.select(*_columns(docs, {"text": text, "n_chars": F.length(text).cast("bigint")}))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids; a null or empty text is its closing id alone."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", mask_personal_data), ("packing", pack)]

#: A trained network and BPE are beyond SQL; tests/llm holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
