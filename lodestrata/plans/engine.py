"""The library's entry points: build an index, search it, answer from it."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embedding import get_embedder, query_vector
from ..functions.tagging import tag
from ..operators import search as S
from ..operators.index import Index
from ..session import stored
from ..sources.files import ingest_with_outcomes, listing, read_listed
from ..streaming.watch import manifest_diff


@dataclass
class SearchResult:
    query: str
    hits: list[Row]
    answer: str | None = None


def open_index(spark: SparkSession, root: str) -> Index:
    return Index(spark, root)


def _summary(index: Index, meta: dict) -> dict:
    counts: dict[str, dict[str, int]] = {"by_language": {}, "by_category": {}, "by_source_type": {}, "by_department": {}}
    for kind, value, n in index.figures():
        counts[f"by_{kind}"][value] = n
    return {"indexed": meta["indexed"], "count": meta["count"], "embedder": meta["embedder"], "db": index.root, **counts}


def build_index(spark: SparkSession, root: str, source: str, embedder: str = "auto", reset: bool = True, strict_compat: bool = False, hint: str | None = None) -> dict:
    """Ingests a file or folder, tags it and writes it as a segment. ``indexed`` counts the rows given, ``count`` and the
    by_* figures the whole index, ``skipped`` the files that couldn't be read, by reason. With reset the index also
    remembers the files' manifest, which refresh_index() goes by."""
    index, files = open_index(spark, root), stored(listing(spark, source), "listing")
    records, outcomes = ingest_with_outcomes(read_listed(files, source), strict_compat)
    meta = index.write(tag(records, hint), get_embedder(embedder), append=not reset, files=files if reset else None)
    return _summary(index, meta) | {"skipped": _skipped(outcomes)}


#: Reasons that a build's figures name, the most frequent first.
MOST_REASONS = 100


def _skipped(outcomes: DataFrame) -> dict[str, int]:
    counts = outcomes.where("reason IS NOT NULL").groupBy("reason").count().orderBy(F.desc("count"), "reason")
    return {r["reason"]: r["count"] for r in counts.limit(MOST_REASONS).collect()}


def family(name: Column) -> Column:
    """What ties files together: a name without its extension, so that a text sidecar goes with its image, and files of
    one name in several folders, whose records' ids can be the same, go together."""
    return F.regexp_replace(F.lower(name), r"(\.ocr)?\.[^.]*$", "")


def refresh_index(spark: SparkSession, root: str, source: str, embedder: str = "auto", strict_compat: bool = False, hint: str | None = None) -> dict | None:
    """Brings an index up to date with its source: only files that were added or changed, and those of the same family
    (see family()), are parsed again; records of these and of removed files are dead from then on. Returns the figures,
    or None if nothing has changed. An index without a manifest is built."""
    index = open_index(spark, root)
    before = index.files() if index.exists() else None
    if before is None:
        return build_index(spark, root, source, embedder, True, strict_compat, hint)
    now = stored(listing(spark, source), "listing")
    name = F.element_at(F.split("path", "/"), -1)
    touched = stored(manifest_diff(before, now).select(family(name).alias("family")).distinct(), "touched")
    if touched.isEmpty():
        return None
    files = now.withColumn("family", family(F.col("name"))).join(touched, "family", "left_semi").drop("family")
    records, outcomes = ingest_with_outcomes(read_listed(files, source), strict_compat)
    pick = lambda old: old.withColumn("family", family(F.col("source_file"))).join(touched, "family", "left_semi")
    meta = index.write(tag(records, hint), get_embedder(embedder), True, pick, now)
    return _summary(index, meta) | {"skipped": _skipped(outcomes)}


def build_index_drive(spark: SparkSession, root: str, connect: Callable[[], object], folder: str, embedder: str = "auto", recursive: bool = True, reset: bool = False) -> dict:
    """As build_index, for a drive folder; connect makes a client, as sources.drive.connection does."""
    from ..session import scratch_path
    from ..sources.drive import drive_files, ingest_drive

    index = open_index(spark, root)
    drive_files(spark, connect, folder, recursive).write.parquet(path := scratch_path(spark, "drive"))  # each file is downloaded once
    records = tag(ingest_drive(spark.read.parquet(path)))
    return {**_summary(index, index.write(records, get_embedder(embedder), append=not reset)), "folder_id": folder}


def follow_drive(spark: SparkSession, root: str, connect: Callable[[], object], folder: str, checkpoint: str, embedder: str = "auto", recursive: bool = True, available_now: bool = True):
    """Keeps an index up to date with a drive folder by a stream of its changes: only changed files are downloaded, and
    records of changed and removed ones are dead from then on. Returns the running query."""
    from ..session import scratch_path
    from ..sources.drive import drive_stream, ingest_drive

    index, chosen = open_index(spark, root), get_embedder(embedder)

    def each(files: DataFrame, _: int) -> None:
        files.write.parquet(path := scratch_path(spark, "drive"))  # each file is downloaded once
        files = spark.read.schema(files.schema).parquet(path)
        if files.isEmpty():
            return
        touched = files.select(F.col("origin_id").alias("_origin")).distinct()
        pick = lambda old: old.withColumn("_origin", F.col("extra.origin_id")).join(touched, "_origin", "left_semi")
        records = tag(ingest_drive(files.where("NOT removed").drop("removed")))
        index.write(records, chosen, index.exists(), pick if index.exists() else None)

    writer = drive_stream(spark, connect, folder, recursive).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 seconds")).start()


def ranked_legs(index: Index, query: str, embedder: str, filters: Mapping | None, pool: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, keyword leg, vector leg) for one query."""
    spark, meta = index.spark, index.meta()
    chosen = get_embedder(embedder)
    if chosen.name != meta["embedder"]:
        raise ValueError(f"the index holds vectors of {meta['embedder']}, not {chosen.name}")
    queries = spark.createDataFrame([(0, query)], "qid int, query string")
    expanded = queries.select(T.with_aliases(F.col("query"), " ")).first()[0]
    qvec = spark.createDataFrame([(0, query_vector(spark, chosen, expanded))], "qid int, qvec array<double>")
    keyword = S.top_k(S.keyword_scores(queries, index, filters, k=pool), pool)
    vectors, only = index.table("vectors"), index.allowed(filters)
    return queries, keyword, S.vector_topk(qvec, only(vectors) if only else vectors, pool, 12)


def search(spark: SparkSession, root: str, query: str, limit: int = S.LIMIT, filters: Mapping | None = None, pool: int = S.POOL, answer: bool = False, embedder: str = "auto", mode: str | None = None, llm: Callable[[str, list[Row]], str | None] | None = None) -> SearchResult:
    """The best records for one query, with sources. An index that was never written has none."""
    index = open_index(spark, root)
    if not index.exists():
        return SearchResult(query, [], summarise(query, [], mode, llm) if answer else None)
    queries, keyword, vector = ranked_legs(index, query, embedder, filters, pool)
    found = S.hits(S.fuse(keyword, vector, limit), index.table("records"), queries).orderBy("rank").collect()
    return SearchResult(query, found, summarise(query, found, mode, llm) if answer else None)


def summarise(query: str, found: list[Row], mode: str | None = None, llm: Callable[[str, list[Row]], str | None] | None = None) -> str:
    """extractive (the default): top hit and counts. llm: what the callable says of the first five hits; whatever goes
    wrong there falls back to extractive."""
    if not found:
        return S.NO_ANSWER
    if (mode or os.environ.get("LODESTRATA_ANSWER_MODE", "extractive")) == "llm":
        try:
            if text := (llm or local_llm)(query, found[:5]):
                return text
        except Exception:  # a model is never needed for an answer
            pass
    n = len(found)
    more = S.ANSWER_MORE.format(n=n - 1) if n > 1 else ""
    return S.ANSWER_TOP.format(title=found[0]["title"].strip(), provenance=found[0]["provenance"]) + more + S.ANSWER_END.format(n=n)


def local_llm(query: str, found: list[Row]) -> str | None:
    """A local model at LODESTRATA_LOCAL_LLM; None where there is none."""
    path = os.environ.get("LODESTRATA_LOCAL_LLM")
    if not path:
        return None
    from llama_cpp import Llama

    lines = "\n".join(f"* {h['title']} ({h['provenance']}): {h['snippet']}" for h in found)
    prompt = f"Answer in two sentences at most, from these records only.\n{lines}\n\nQ: {query}\nA:"
    out = Llama(model_path=path, n_ctx=2048, verbose=False)(prompt, max_tokens=120, temperature=0.2, stop=["\n\n"])
    return out["choices"][0]["text"].strip() or None
