"""The registered queries of the engine's own operators, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import lexicon
from ..functions import records as R
from ..functions import tagging as G
from ..functions import text as T
from ..operators import index as I
from ..operators import search as S
from ..operators import sections, tabular
from ..session import scratch_path, stored
from ..sources import tables
from ..sources.files import GRID, ingest, ingest_with_outcomes, parsed, xlsx_grid
from ..streaming.watch import follow_snapshots, manifest_diff, stream_table
from . import inputs as N
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parameters that fit the test tables, whose words are invented.
LEXICON = (("the", "la", "der"), ("and", "et", "und", "y"), ("of the", "de la", "von der"), ("in", "dans", "en la"))
FRENCH, GERMAN = ("le", "la", "et", "un", "une", "des", "du", "que", "qui", "est"), ("der", "die", "das", "und", "ein", "ist", "mit", "von", "nicht", "für")
SCRIPT = r"[\x{00C0}-\x{00FF}]"
CATEGORIES = {"economy": ("ECONOMY",), "compact": ("SMALL", "MEDIUM"), "large": ("LARGE",), "special": ("PROMO",)}
DEPARTMENTS = ("Rereth", "Und Ver", "Ciones", "Home", "Leaux")
PLACES = ("The", "Und", "Les", "Tion", "Que", "Schtz")
SNIPPET_QUERY = "what is the schtz of leaux"
#: Dimension of the flagship's hashing vectors, the embedders' default.
DIM = 768
POOL, LIMIT = S.POOL, S.LIMIT


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- records ----


@query("SELECT doc_id, substr(sha1(concat(source, '|', lang, '|doc ', doc_id, '|', substr(split_part(text, chr(10), 1), 1, 120))), 1, 16) AS id FROM documents")
def record_id_sha1(spark, sf_dir):
    return N.document_records(spark, sf_dir).select(F.substring("row_or_page", 5, 20).cast("bigint").alias("doc_id"), "id")


@query("SELECT doc_id, concat(source, ' · sheet ''', lang, ''' · doc ', doc_id) AS provenance FROM documents")
def provenance(spark, sf_dir):
    d = N.document_records(spark, sf_dir)
    return d.select(F.substring("row_or_page", 5, 20).cast("bigint").alias("doc_id"), R.provenance(F.col("source_file"), F.col("sheet"), F.col("row_or_page")).alias("provenance"))


@query("SELECT doc_id, md5(concat_ws(chr(10), nullif(substr(split_part(text, chr(10), 1), 1, 120), ''), nullif(text, ''), lang, source)) AS search_md5 FROM documents")
def search_text(spark, sf_dir):
    d = N.table(spark, sf_dir, "documents")
    text = R.search_text(N.first_line(F.col("text")), F.col("text"), F.lit(""), F.array("lang", F.lit("")), F.array("source"))
    return d.select("doc_id", F.md5(text).alias("search_md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}') AS js FROM events")
def json_roundtrip(spark, sf_dir):
    e = N.table(spark, sf_dir, "events").withColumn("js", R.to_json("event_id", "event_type"))
    back = R.from_json(F.col("js"), "event_id bigint")["event_id"]
    return e.select(back.alias("event_id"), R.from_json(F.col("props"), "k bigint")["k"].alias("k"), "js")


@query(O.UPSERT)
def upsert_latest(spark, sf_dir):
    d = N.table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.md5("text").alias("digest"), F.lit(0).alias("ordinal"))
    new = d.where(F.col("lang") != "en").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("digest"), F.lit(1).alias("ordinal"))
    return I.upsert(old, new, "doc_id").select("doc_id", "digest")


# ---- tags ----


@query(O.DATES)
def date_parse_mixed(spark, sf_dir):
    return N.order_texts(spark, sf_dir).select("o_orderkey", G.parse_date(F.col("txt")).alias("iso"))


@query(O.LANGUAGE)
def detect_language(spark, sf_dir):
    d = N.texts(spark, sf_dir, "documents")
    return d.select("doc_id", T.detect_language(F.col("text"), ("fra", FRENCH), ("deu", GERMAN), SCRIPT, "lat", 0.05).alias("language"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'economy' WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'medium') THEN 'compact' WHEN contains(lower(p_type), 'large') THEN 'large' WHEN contains(lower(p_type), 'promo') THEN 'special' ELSE 'Uncategorised' END AS category FROM part")
def infer_category(spark, sf_dir):
    return N.table(spark, sf_dir, "part").select("p_partkey", G.infer_category(F.col("p_type"), hints=CATEGORIES).alias("category"))


@query("SELECT doc_id, CASE WHEN contains(t, 'rereth') THEN 'Rereth' WHEN contains(t, 'und ver') THEN 'Und Ver' WHEN contains(t, 'ciones') THEN 'Ciones' WHEN contains(t, 'home') THEN 'Home' WHEN contains(t, 'leaux') THEN 'Leaux' WHEN contains(t, 'gad') OR contains(t, 'general administration') THEN 'General Administration' WHEN contains(t, 'cmo') THEN 'Chief Minister''s Office' END AS department FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def infer_department(spark, sf_dir):
    return N.texts(spark, sf_dir, "documents").select("doc_id", G.infer_department(F.col("text"), DEPARTMENTS).alias("department"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(repr(p) for p in PLACES)}], lambda p: contains(text, p)), '|') AS places FROM documents")
def gazetteer_locations(spark, sf_dir):
    return N.texts(spark, sf_dir, "documents").select("doc_id", F.array_join(G.extract_locations(F.col("text"), PLACES), "|").alias("places"))


@query(O.ENTITIES)
def extract_entities(spark, sf_dir):
    c = N.table(spark, sf_dir, "customer")
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    text = F.when(kind == 0, F.concat(F.lit("Letter from Shri Ab"), k, F.lit("ton of "), "c_mktsegment", F.lit(" to Hon'ble President Anna O'Neil-Smith. Dr. Jones met")))
    text = text.when(kind == 1, F.concat(F.lit("met Dr. Jones and Smt. Ab"), k, F.lit(" Rao today, xDr. No, Mr"))).when(kind == 2, F.concat(F.lit("the Secretary Finance"), k, F.lit(" and Prime Minister  Two\nSpaces; Honble Ab")))
    text = text.when(kind == 3, "shri lower Name").when(kind == 4, F.concat(F.lit("Mr Ab"), k, F.lit(" Mr Ab"), k, F.lit(" Ms Zed. Governor of X, (Dr Ad)")))
    text = text.otherwise(F.concat(F.lit("Minister Ab"), k, F.lit(" , Minister Ab"), k, F.lit(" , Chief Minister")))
    return c.select("c_custkey", F.array_join(G.extract_entities(text), "|").alias("entities"))


# ---- texts ----


@query(r"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_tokens, md5(array_to_string(x, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_\x{0900}-\x{097F}]+'), lambda t: lower(t)) AS x FROM documents)")
def tokenize(spark, sf_dir):
    x = T.tokens(F.col("text"))
    return N.texts(spark, sf_dir, "documents").select("doc_id", F.size(x).cast("bigint").alias("n_tokens"), F.md5(F.array_join(x, " ")).alias("tokens_md5"))


@query(O.CONTENT_TERMS)
def content_terms(spark, sf_dir):
    x = T.content_terms(F.col("text"))
    return N.texts(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(x).cast("bigint").alias("n_terms"), F.md5(F.array_join(x, " ")).alias("terms_md5"))


@query(O.EXPAND)
def expand_terms(spark, sf_dir):
    return N.texts(spark, sf_dir, "documents").select("doc_id", F.array_join(T.expand_terms(F.col("text"), LEXICON), "|").alias("aliases"))


@query(O.SNIPPET)
def snippet(spark, sf_dir):
    d = N.texts(spark, sf_dir, "documents")
    return d.select("doc_id", T.snippet(F.col("text"), F.lit("untitled"), F.lit(SNIPPET_QUERY), 220, LEXICON).alias("snippet"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN k IS NULL AND v IS NULL THEN '—' ELSE concat_ws('+', 'keyword#' || k, 'semantic#' || v) END AS why FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) END AS k, CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber + 1 AS VARCHAR) END AS v FROM lineitem)")
def match_why(spark, sf_dir):
    n = F.col("l_linenumber")
    return N.table(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("bigint").alias("line"), S.why(F.when(F.col("l_linestatus") == "O", n), F.when(F.col("l_returnflag") != "N", n + 1)).alias("why"))


# ---- sheets and sections ----


@query(O.HEADER_DETECT)
def header_detect(spark, sf_dir):
    return tabular.header_scores(N.customer_grid(spark, sf_dir)).select("source_file", F.col("row_idx").cast("bigint").alias("row_idx"), F.round("score", 6).alias("score"))


@query(O.HEADER_PICK)
def header_pick(spark, sf_dir):
    return tabular.detect_headers(N.customer_grid(spark, sf_dir)).select("source_file", F.col("header_idx").cast("bigint").alias("header_idx"))


@query(O.HEADER_DEDUPE)
def header_dedupe(spark, sf_dir):
    kind, segment = F.col("c_custkey") % 3, F.col("c_mktsegment")
    cells = F.when(kind == 0, F.array(F.lit("x"), F.lit("  "), segment, F.lit(" x"), F.concat(segment, F.lit(" ")), F.lit("x")))
    cells = cells.when(kind == 1, F.array(F.lit(""), "c_name", F.lit(""), "c_name")).otherwise(F.array(segment, F.lit("AUTOMOBILE"), F.lit("col4"), F.lit(" "), F.concat(F.lit(" "), segment)))
    return N.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tabular.dedupe_headers(cells), "|").alias("headers"))


@query(O.SHAPE_ROWS)
def shape_rows(spark, sf_dir):
    s = tabular.shape_rows(N.customer_grid(spark, sf_dir))
    return s.select("source_file", "row_or_page", "title", "raw_text", "category", "recipient", "source_type")


@query(O.EXPLICIT)
def explicit_category(spark, sf_dir):
    p = N.texts(spark, sf_dir, "part")
    pair = lambda h, v: F.struct(F.lit(h).alias("h"), v.alias("v"))
    pairs = F.array(pair("Part name", F.col("p_name")), pair("Type", F.col("p_type")), pair("Sub-Category", F.when(F.col("p_size") > 25, F.lit(" war ROOM ")).otherwise(F.col("p_brand"))))
    title = tabular.pick_title(F.transform(pairs, lambda q: F.struct(F.when(q["h"] == "Part name", F.when(F.col("p_size") > 10, "Part name").otherwise("Part")).otherwise(q["h"]).alias("h"), q["v"].alias("v"))))
    return p.select("p_partkey", tabular.explicit_category(pairs).alias("category"), title.alias("title"))


@query(O.NEAR_DUP)
def near_dup_rows(spark, sf_dir):
    s = tabular.drop_near_duplicates(tabular.shape_rows(N.customer_grid(spark, sf_dir, 2)))
    return s.select("source_file", "sheet", "row_or_page", "raw_text")


@query(O.MARKDOWN)
def markdown_sections(spark, sf_dir):
    b = N.table(spark, sf_dir, "benchmark")
    item = F.col("item_id").cast("string")
    text = F.concat(F.lit("# item "), item, F.lit("\n\n## part\n"), "text", F.lit("\n### sub\ntail\n##\n# \n#  two words \nend"))
    files = b.select(F.concat(F.lit("deck_"), item, F.lit(".md")).alias("source_file"), text.alias("text"))
    return sections.markdown_sections(files)


@query(O.CHUNKS)
def char_budget_chunks(spark, sf_dir):
    d = N.texts(spark, sf_dir, "documents")
    chunks = sections.budget_chunks(F.split("text", "\n"))
    return d.select("doc_id", F.posexplode(chunks).alias("part", "body")).select("doc_id", F.col("part").cast("bigint").alias("part"), F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body_md5"))


# ---- vectors ----


@query(O.NGRAMS)
def ngram_features(spark, sf_dir):
    b = N.table(spark, sf_dir, "benchmark").select("item_id", F.explode(E.features(F.col("text"))).alias("f"))
    return b.groupBy("item_id", "f").agg(F.count("*").alias("n"))


@query(O.HASHING)
def hashing_embed_md5(spark, sf_dir):
    b = N.table(spark, sf_dir, "benchmark")
    return E.NativeHashingEmbedder(768).sparse(b, "item_id", "text").select("item_id", F.col("slot").cast("bigint").alias("slot"), F.round("weight", 6).alias("weight"))


@query()
def hashing_embed_blake2b(spark, sf_dir):
    b = N.table(spark, sf_dir, "benchmark")
    return E.HashingEmbedder().embed(b, "text").select("item_id", F.posexplode("vec").alias("slot", "weight")).where("weight != 0")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings)")
def l2_normalise(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return N.table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get(E.l2_normalise(v), F.lit(0)), 6).alias("first"))


def _cosine(spark, sf_dir, allowed=None) -> DataFrame:
    e = N.table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    vectors = (e.where(allowed) if allowed is not None else e).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return S.vector_topk(queries, vectors, POOL).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(O.cosine())
def cosine_topk(spark, sf_dir):
    return _cosine(spark, sf_dir)


@query(O.cosine("WHERE label IN (1, 3)"))
def cosine_topk_filtered(spark, sf_dir):
    return _cosine(spark, sf_dir, F.col("label").isin(1, 3))


# ---- keyword index ----


#: Distinct tokens of all queries up to which texts are searched for them in place.
FEW_TOKENS = 20_000


#: Fragments of queries, and phrases times queries, up to which all queries are one matrix in each task.
FEW_FRAGMENTS, FEW_CELLS = 200_000, 8_000_000


def _keyword(spark, sf_dir, queries: DataFrame, weights: dict[str, float], fragments: DataFrame | None = None, only: S.Only = None) -> DataFrame:
    """(qid, id, score), of each query at least the POOL best."""
    fields = N.texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), N.first_line(F.col("text")).alias("title"), F.col("source").alias("recipient"), F.col("lang").alias("keys"), F.col("text").alias("body")).select("id", *weights)
    cut = I.tokenised(fields, tuple(weights))
    parts = stored(S.query_fragments(S.query_terms(queries)) if fragments is None else fragments, "fragments")
    known = parts.select("tok", "n").distinct().limit(FEW_TOKENS + 1).collect()
    # each text is cut into tokens once; what a query holds of them, and all lengths, are read from the stored table
    if len(known) <= FEW_TOKENS:
        cut = stored(I.held_tokens(cut, sorted({r["tok"] for r in known}), any(r["n"] > 1 for r in known)), "tokens")
        post = cut.select("id", "len", F.explode("found").alias("x")).select("id", "len", "x.*")
    else:
        cut = stored(cut, "tokens")
        post = I.postings_of(cut)
    corpus = cut.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avgdl")).first()
    multi, few = None, len(known) <= FEW_TOKENS
    asked = parts.limit(FEW_FRAGMENTS + 1).collect() if few else []
    if asked and len(asked) <= FEW_FRAGMENTS and len({(r["phrase"]) for r in asked}) * len({r["qid"] for r in asked}) <= FEW_CELLS:
        return S.phrase_scores(cut, S.Phrases(asked, weights), corpus["n_docs"], corpus["avgdl"], POOL, only)
    if not few or any(r["n"] > 1 for r in known):
        multi = S.phrase_frequencies(S._small(parts), post, weights).join(cut.select("id", "len"), "id")
    tf = I.term_frequencies(post, weights)
    if not few:
        tf = tf.join(parts.where("n = 1").select("tok").distinct(), "tok", "left_semi")
    return S.token_scores(tf, parts, multi, corpus["n_docs"], corpus["avgdl"], only, few)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    top = S.top_k(scored.withColumn("score", F.round("score", 9)), k)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(O.bm25("SELECT CAST(0 AS BIGINT) AS qid, 'show me the thing of erntention leaux schtz' AS query"))
def bm25_single(spark, sf_dir):
    q = spark.createDataFrame([(0, "show me the thing of erntention leaux schtz")], "qid bigint, query string")
    return _ranked(_keyword(spark, sf_dir, q, {"body": 1.0}), POOL)


@query(O.bm25("SELECT item_id AS qid, text AS query FROM benchmark"))
def bm25_batch(spark, sf_dir):
    q = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _ranked(_keyword(spark, sf_dir, q, {"body": 1.0}), POOL)


@query(O.bm25("SELECT item_id AS qid, text || ' src3 src7 de fr' AS query FROM benchmark", fields=True))
def bm25_field_weighted(spark, sf_dir):
    q = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" src3 src7 de fr")).alias("query"))
    return _ranked(_keyword(spark, sf_dir, q, I.WEIGHTS), POOL)


PHRASES = ("of the", "in the", "de la", "le un", "und der")


@query(O.phrases(PHRASES))
def phrase_match(spark, sf_dir):
    terms = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "qid bigint, term string")
    return _ranked(_keyword(spark, sf_dir, None, {"body": 1.0}, S.query_fragments(terms)), POOL)


@query(O.bm25_filtered("SELECT item_id AS qid, text AS query FROM benchmark", "lang = 'de'"))
def bm25_filtered(spark, sf_dir):
    """Filtered before the top-k; document frequencies, counts and lengths are those of all documents."""
    d = N.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    q = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _ranked(_keyword(spark, sf_dir, q, {"body": 1.0}, only=S.among(d.where(S.metadata_filter({"language": "de"})))), POOL)


# ---- files and tags ----


@query(O.INGEST_CSV)
def ingest_csv(spark, sf_dir):
    """CSV files through dispatch, reader, header detection and row shaping to records."""
    return ingest(N.grid_files(N.customer_grid(spark, sf_dir))).select("source_file", "sheet", "row_or_page", "title", "raw_text", "category", "recipient", "source_type")


@query(O.INGEST_TEXTS)
def ingest_texts(spark, sf_dir):
    """Markdown, scans' texts, unknown kinds and minutes through dispatch and readers to records."""
    return ingest(N.text_files(spark, sf_dir)).select("source_file", "row_or_page", "title", F.md5("raw_text").alias("text_md5"), "source_type")


@query(O.INGEST_XLSX)
def ingest_xlsx(spark, sf_dir):
    """Workbooks of two sheets, the second one a near copy, through dispatch, reader and row shaping to records."""
    return ingest(N.workbooks(N.customer_grid(spark, sf_dir, 2)), kinds={"xlsx"}).select("source_file", "sheet", "row_or_page", "raw_text")


@query(O.ingest_office())
def ingest_office(spark, sf_dir):
    """Word processor files with a heading and decks with notes, through dispatch and readers to records."""
    records = ingest(N.office_documents(spark, sf_dir), kinds={"docx", "pptx"})
    return records.select("source_file", "title", "row_or_page", "source_type", F.md5("raw_text").alias("text_md5"))


@query(O.OUTCOMES)
def ingest_outcomes(spark, sf_dir):
    """What became of files that are read, empty, broken or of a format whose library is missing."""
    _, outcomes = ingest_with_outcomes(N.unreadable_files(spark, sf_dir), kinds={"deck", "docx", "xlsx", "pptx", "pdf", "csv"})
    return outcomes.select("path", "outcome", "reason")


@query(O.indexed("SELECT item_id AS qid, text AS query FROM benchmark", "source <> 'src7'", "text || CASE WHEN lang = 'de' THEN ' renewed schtz' ELSE '' END"))
def index_incremental(spark, sf_dir):
    """An index of all documents, then new texts for one language's and one source removed, each as a segment beside the
    first one; its searches are those of an index that was built anew."""
    index, records, embedder = I.Index(spark, scratch_path(spark, "segments")), N.document_records(spark, sf_dir), E.HashingEmbedder(32)
    index.write(records, embedder)
    index.write(records.where("sheet = 'de'").withColumn("raw_text", F.concat("raw_text", F.lit(" renewed schtz"))), embedder, append=True)
    index.remove(lambda old: old.where("source_file = 'src7'"), embedder)
    queries = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _ranked(S.keyword_scores(queries, index, k=POOL), POOL)


@query(O.READ_SHEET)
def sql_read_sheet(spark, sf_dir):
    """CSV files read by a table function of SQL."""
    tables.register(spark)
    N.grid_files(N.customer_grid(spark, sf_dir)).createOrReplaceTempView("lodestrata_files")
    return spark.sql("SELECT f.name AS source_file, t.sheet, CAST(t.row_idx AS BIGINT) AS row_idx, array_join(t.cells, '|') AS cells FROM lodestrata_files f, LATERAL read_sheet(f.name, f.content) t")


@query(O.XLSX_CELLS)
def xlsx_cell_formats(spark, sf_dir):
    """Numbers, dates, truth values and texts of workbooks as the texts that records hold."""
    grid = parsed(N.order_workbooks(spark, sf_dir), xlsx_grid, GRID)
    return grid.select("source_file", F.col("row_idx").cast("bigint").alias("row_idx"), F.array_join("cells", "|").alias("cells"))


@query(O.SIDECARS)
def scan_sidecars(spark, sf_dir):
    """Images with the text of the sidecar beside them; a sidecar without its image is a scan of its own."""
    records = ingest(N.scanned_files(spark, sf_dir), kinds={"scan"})
    return records.select("source_file", "title", F.md5("raw_text").alias("text_md5"), "row_or_page")


@query(O.LEXICON_SYNONYMS)
def lexicon_synonyms(spark, sf_dir):
    """Synonyms from a lexicon that is a table, by an automaton."""
    d = lexicon.synonyms(N.texts(spark, sf_dir, "documents"), "text", N.lexicon(spark, sf_dir))
    return d.select("doc_id", F.array_join("aliases", "|").alias("aliases"))


@query(O.LEXICON_LABELS)
def lexicon_labels(spark, sf_dir):
    """Categories and places from tables of triggers and names, by automata."""
    terms = N.lexicon(spark, sf_dir)
    hints = terms.select(F.col("term").alias("trigger"), F.concat(F.lit("c"), F.col("concept").cast("string")).alias("category"), "rank")
    d = lexicon.category(N.texts(spark, sf_dir, "documents"), "text", hints)
    d = lexicon.places(d, "text", terms.select(F.col("term").alias("place"), "rank").distinct())
    return d.select("doc_id", "category", F.array_join("places", "|").alias("places"))


@query(O.indexed("SELECT item_id AS qid, text AS query FROM benchmark", "true", "text", "id IN (SELECT id FROM x WHERE lang = 'de' AND source BETWEEN 'src2' AND 'src5')"))
def index_filtered(spark, sf_dir):
    """Searches in an index under two filters, which are bitmaps of its records; corpus figures are those of all."""
    index, records = I.Index(spark, scratch_path(spark, "filtered")), N.document_records(spark, sf_dir)
    index.write(records.withColumns({"language": F.col("sheet"), "date": F.col("source_file")}), E.HashingEmbedder(8))
    queries = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _ranked(S.keyword_scores(queries, index, {"language": "de", "date": ["src2", "src5"], "unknown": 1}, k=POOL), POOL)


@query(O.LOOKUP)
def index_lookup(spark, sf_dir):
    """Records of stated ids from an index."""
    index, records = I.Index(spark, scratch_path(spark, "lookup")), N.document_records(spark, sf_dir)
    index.write(records, E.HashingEmbedder(8))
    number = F.substring("row_or_page", 5, 20).cast("bigint")
    ids = [r["id"] for r in records.where(number % 50 == 0).select("id").collect()]
    return index.lookup(ids).select(number.alias("doc_id"), "id", "title", F.md5("raw_text").alias("text_md5"))


@query(O.index_vectors(64, POOL))
def index_vector_search(spark, sf_dir):
    """Vector searches in an index, under a filter that comes before the ranks."""
    index, embedder = I.Index(spark, scratch_path(spark, "vectors")), E.HashingEmbedder(64, digest="md5")
    index.write(N.document_records(spark, sf_dir), embedder)
    records = index.table("records", S.metadata_filter({"source_type": "report"})).where("sheet = 'fr'")
    queries = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = embedder.embed(queries, "text", "qvec", "double").select("qid", "qvec")
    vectors = index.table("vectors").drop("doc").join(records.select("id", F.substring("row_or_page", 5, 20).cast("bigint").alias("doc")), "id").select(F.col("doc").alias("id"), "vec")
    return S.vector_topk(asked, vectors, POOL).select("qid", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(O.tags())
def tag_records(spark, sf_dir):
    t = G.tag(N.tag_texts(spark, sf_dir))
    return t.select(F.col("row_or_page").cast("bigint").alias("c_custkey"), "date", "language", "department", "category", F.array_join("location", "|").alias("places"), F.array_join("entities", "|").alias("entities"), "alias_text")


@query(O.field_aliases())
def field_and_query_aliases(spark, sf_dir):
    t = N.tag_texts(spark, sf_dir).withColumn("id", F.col("row_or_page"))
    fields = I.index_fields(t).join(t.select("id", F.col("recipient").alias("topic")), "id")
    return fields.select(F.col("id").cast("bigint").alias("c_custkey"), "recipient", T.with_aliases(F.col("topic"), " ").alias("query"))


# ---- filters and figures ----


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def metadata_filter_eq(spark, sf_dir):
    d = N.table(spark, sf_dir, "documents").withColumnsRenamed({"lang": "language", "source": "category"})
    return d.where(S.metadata_filter({"language": "de", "category": "src3", "unknown": "x", "department": None})).select("doc_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-03-01' AND '1997-09-30'")
def metadata_filter_range(spark, sf_dir):
    o = N.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return o.where(S.metadata_filter({"date": ["1996-03-01", "1997-09-30"]}))


@query(O.STATS)
def stats_grouping_sets(spark, sf_dir):
    d = N.table(spark, sf_dir, "documents")
    length = F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, "middle")
    return I.stats(d.select(F.col("lang").alias("language"), F.col("source").alias("category"), F.lit("report").alias("source_type"), length.alias("department")))


@query(O.MANIFEST)
def manifest_changes(spark, sf_dir):
    return manifest_diff(*N.manifests(spark, sf_dir))


@query(O.MANIFEST)
def manifest_stream(spark, sf_dir):
    """The same changes from snapshots that arrive one after the other, by a stream with a state of each group of paths."""
    base = scratch_path(spark, "snapshots")
    for k, m in enumerate(N.manifests(spark, sf_dir)):
        at = F.timestamp_seconds(F.lit(1_700_000_000 + 60 * k))
        m.select(at.alias("at"), "path", "size", "mtime").write.mode("append").parquet(f"{base}/in")
        follow_snapshots(spark, f"{base}/in", f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").where(F.unix_timestamp("at") > 1_700_000_000).select("path", "change")


@query("SELECT doc_id, source, n_chars FROM documents")
def stream_ingest_available_now(spark, sf_dir):
    base = scratch_path(spark, "stream")
    docs = N.table(spark, sf_dir, "documents")
    docs.select("doc_id", "source", "n_chars").write.parquet(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        stream_table(spark, f"{base}/in", docs.select("doc_id", "source", "n_chars").schema, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out")


# ---- fusion ----


def _order_legs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two rankings of each customer's orders: by price, of those above 50,000 only, so that the rankings differ in what
    they hold, and by date, of all."""
    o = N.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice", F.unix_timestamp("o_orderdate").cast("double").alias("t"))
    return S.top_k(o.where("o_totalprice > 50000").withColumn("score", F.col("o_totalprice")), 5), S.top_k(o.withColumn("score", F.col("t")), 5)


@query(O.RRF)
def rrf_fusion(spark, sf_dir):
    """Two rankings of each customer's orders fused; an order of 50,000 or less is in the ranking by date only."""
    f = S.fuse(*_order_legs(spark, sf_dir), 5)
    return f.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), S.why(F.col("keyword_rank"), F.col("vector_rank")).alias("why"))


def _hybrid(spark, sf_dir) -> DataFrame:
    queries = N.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    keyword = S.top_k(_keyword(spark, sf_dir, queries, {"body": 1.0}).withColumn("score", F.round("score", 9)), POOL)
    docs = N.texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hashing = E.HashingEmbedder(DIM, digest="md5")
    asked = hashing.embed(queries, "query", "qvec", "double").select("qid", "qvec")
    vector = S.vector_topk(asked, hashing.embed(docs, "text", "vec", "double").select("id", "vec"), POOL)
    return S.fuse(keyword, vector, LIMIT)


@query(O.hybrid(DIM, POOL, LIMIT))
def hybrid_search_rrf(spark, sf_dir):
    """The flagship: every benchmark text as a query against all documents, both legs, fused."""
    return _hybrid(spark, sf_dir).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), S.why(F.col("keyword_rank"), F.col("vector_rank")).alias("why"))


@query(O.ANSWER)
def extractive_answer(spark, sf_dir):
    """An answer for each customer from the orders that both rankings of rrf_fusion give."""
    f = S.fuse(*_order_legs(spark, sf_dir), 5)
    o = N.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("orders · row "), F.col("o_orderkey").cast("string")).alias("provenance"))
    customers = N.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"))
    return S.extractive_answers(f.join(o, "id"), customers)
