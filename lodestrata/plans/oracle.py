"""DuckDB SQL for the longer queries. It is written from the operators' rules, not from their Spark plans."""

from __future__ import annotations

UPSERT = """
WITH x AS (
  SELECT doc_id, md5(text) AS digest, 0 AS o FROM documents
  UNION ALL SELECT doc_id, md5(text || '!'), 1 FROM documents WHERE lang <> 'en')
SELECT doc_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC) AS r FROM x) WHERE r = 1"""

DATES = r"""
WITH t AS (
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN 'placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' by phone'
    WHEN 1 THEN 'placed on ' || strftime(o_orderdate, '%Y/%m/%d') || ' by phone'
    WHEN 2 THEN 'placed on ' || strftime(o_orderdate, '%d-%m-%Y') || ' by phone'
    WHEN 3 THEN 'placed on ' || strftime(o_orderdate, '%d.%m.%Y') || ' by phone'
    WHEN 4 THEN 'placed on ' || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ' %B %Y') || ' by phone'
    WHEN 5 THEN 'placed on ' || strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y') || ' by phone'
    WHEN 6 THEN '2025-13-40 then 14-06-2025' ELSE '12 apples 2025' END AS txt FROM orders),
g AS (
  SELECT o_orderkey, txt,
    regexp_extract(txt, '\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b', ['y', 'm', 'd']) AS a,
    regexp_extract(txt, '\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b', ['d', 'm', 'y']) AS b,
    regexp_extract(txt, '\b(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})\b', ['d', 'm', 'y']) AS c,
    regexp_extract(txt, '\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b', ['m', 'd', 'y']) AS e FROM t),
p AS (
  SELECT o_orderkey, CASE WHEN a.y <> '' THEN a.y WHEN b.y <> '' THEN b.y WHEN c.y <> '' THEN c.y ELSE e.y END AS y,
    CASE WHEN a.y <> '' THEN a.m WHEN b.y <> '' THEN b.m ELSE
      CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(CASE WHEN c.y <> '' THEN c.m ELSE e.m END, 1, 3))) AS VARCHAR) END AS m,
    CASE WHEN a.y <> '' THEN a.d WHEN b.y <> '' THEN b.d WHEN c.y <> '' THEN c.d ELSE e.d END AS d,
    (a.y = '' AND b.y = '' AND c.m = 'apples') AS odd FROM g)
SELECT o_orderkey, CASE WHEN NOT odd AND TRY_CAST(m AS INT) BETWEEN 1 AND 12 AND TRY_CAST(d AS INT) BETWEEN 1 AND 31 AND TRY_CAST(y AS INT) BETWEEN 1900 AND 2100
  THEN printf('%04d-%02d-%02d', CAST(y AS INT), CAST(m AS INT), CAST(d AS INT)) END AS iso FROM p"""

LANGUAGE = r"""
WITH x AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '[\x{00C0}-\x{00FF}]')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS b,
    list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_\x{0900}-\x{097F}]+')) AS w FROM documents)
SELECT doc_id, CASE WHEN trim(text) = '' OR a + b = 0 THEN 'und'
  WHEN a > 0.05 * (a + b) AND b > 0.05 * (a + b) THEN 'mixed'
  WHEN a > 0.05 * (a + b) THEN CASE WHEN len(list_intersect(w, ['der','die','das','und','ein','ist','mit','von','nicht','für'])) > len(list_intersect(w, ['le','la','et','un','une','des','du','que','qui','est'])) THEN 'deu' ELSE 'fra' END
  ELSE 'lat' END AS language FROM x"""

ENTITY_TEXT = """CASE c_custkey % 6
    WHEN 0 THEN concat('Letter from Shri Ab', c_custkey, 'ton of ', c_mktsegment, ' to Hon''ble President Anna O''Neil-Smith. Dr. Jones met')
    WHEN 1 THEN concat('met Dr. Jones and Smt. Ab', c_custkey, ' Rao today, xDr. No, Mr')
    WHEN 2 THEN concat('the Secretary Finance', c_custkey, ' and Prime Minister  Two', chr(10), 'Spaces; Honble Ab')
    WHEN 3 THEN 'shri lower Name'
    WHEN 4 THEN concat('Mr Ab', c_custkey, ' Mr Ab', c_custkey, ' Ms Zed. Governor of X, (Dr Ad)')
    ELSE concat('Minister Ab', c_custkey, ' , Minister Ab', c_custkey, ' , Chief Minister') END"""
_TITLES = "Hon'?ble|Shri|Smt\\.?|Dr\\.?|Mr\\.?|Ms\\.?|President|Governor|Prime Minister|Chief Minister|Minister|Secretary".replace("'", "''")
# a name goes on over a dot and white space to the next capital, so a doctor belongs to the name before
ENTITIES = rf"""
WITH t AS (SELECT c_custkey, {ENTITY_TEXT} AS t FROM customer),
e AS (SELECT c_custkey, regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_])((?:{_TITLES})\s+[A-Z][\p{{L}}\p{{N}}_.''-]+(?:\s+[A-Z][\p{{L}}\p{{N}}_.''-]+)*)', 1) AS l FROM t)
SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS entities FROM e"""

STOP = "'the','a','an','to','in','on','of','for','and','or','is','are','was','were','be','with','at','by','from','as','that','this','show','me','all','everything','about','what','which','who','list','give','find','get','letter','letters','regarding','request','please','व','आणि','मध्ये','साठी','आहे','यांना','का','की','के','में','और','को','है','पत्र'"
CONTENT_TERMS = rf"""
SELECT conv_id, turn, CAST(len(x) AS BIGINT) AS n_terms, md5(array_to_string(x, ' ')) AS terms_md5 FROM (
  SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+'), lambda t: lower(t)),
    lambda t: length(t) >= 2 AND NOT list_contains([{STOP}], t) AND NOT regexp_full_match(t, '[\p{{Nd}}]+')) AS x FROM conversations)"""

_GROUPS = (("the", "la", "der"), ("and", "et", "und", "y"), ("of the", "de la", "von der"), ("in", "dans", "en la"))


def _aliases(text: str, tokens: str, groups: tuple[tuple[str, ...], ...] = _GROUPS) -> str:
    """A list of all synonyms that a text calls for, those that are its own tokens left out, in code point order."""
    parts = []
    for group in groups:
        members = "[" + ", ".join(f"'{m}'" for m in group) + "]"
        called = " OR ".join(f"contains(lower({text}), '{m}')" if " " in m else f"list_contains({tokens}, '{m}')" for m in group)
        parts.append(f"CASE WHEN {called} THEN {members} ELSE [] END")
    return f"list_sort(list_filter(list_distinct(flatten([{', '.join(parts)}])), lambda m: NOT list_contains({tokens}, m)))"


EXPAND = rf"""
SELECT doc_id, array_to_string({_aliases('text', 'w')}, '|') AS aliases FROM (
  SELECT doc_id, text, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+'), lambda t: lower(t)) AS w FROM documents)"""

SNIPPET = r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
y AS (SELECT doc_id, t, list_min(list_filter(list_transform(['what','is','the','schtz','of','leaux','la','der'], lambda q: instr(lower(t), q)), lambda p: p > 0)) AS p FROM x),
z AS (SELECT *, greatest(0, p - 1 - 73) AS s FROM y)
SELECT doc_id, CASE WHEN t = '' THEN 'untitled' WHEN p IS NULL THEN substr(t, 1, 220) || CASE WHEN length(t) > 220 THEN '…' ELSE '' END
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 220) || CASE WHEN s + 220 < length(t) THEN '…' ELSE '' END END AS snippet FROM z"""

_PERSON = """CASE WHEN c_custkey % 13 = 0 THEN ['', '', '', '', '', ''] ELSE [CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE {name} END,
    CASE WHEN c_custkey % 5 = 0 THEN ' war ROOM ' ELSE c_mktsegment END, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('Account  of ', c_custkey // 3) END,
    CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN '1/2/2024' ELSE '' END] END"""
# the grid as inputs.customer_grid describes it
_GRID = f"""
c AS (SELECT *, concat(CASE c_nationkey % 3 WHEN 0 THEN 'register' WHEN 1 THEN 'minutes' ELSE 'sheet' END, '_', c_nationkey, '.csv') AS source_file, CAST(c_nationkey AS INT) AS n FROM customer),
top AS (SELECT source_file, i AS row_idx, CASE WHEN i = n % 5 THEN ['Sr', ' Name ', 'Type', CASE WHEN n % 2 = 0 THEN 'Name' ELSE 'Subject' END, '', 'Date']
    WHEN (i + n) % 3 = 0 THEN ['Customer list', '', '', '', '', ''] WHEN (i + n) % 3 = 1 THEN ['', '', '', '', '', ''] ELSE ['2024', '15.03', ' 7 ', '', '', ''] END AS cells
  FROM (SELECT source_file, n, unnest(range(n % 5 + 1)) AS i FROM (SELECT DISTINCT source_file, n FROM c))),
first AS (SELECT source_file, n % 5 + row_number() OVER (PARTITION BY source_file ORDER BY c_custkey) AS row_idx, {_PERSON.format(name="c_name")} AS cells FROM c),
second AS (SELECT source_file, n % 5 + row_number() OVER (PARTITION BY source_file ORDER BY c_custkey) AS row_idx,
    {_PERSON.format(name="CASE WHEN c_custkey % 10 = 0 THEN concat('  ', lower(replace(c_name, '#', ' # '))) ELSE upper(c_name) END")} AS cells FROM c WHERE c_custkey % 2 = 0),
g AS (SELECT source_file, 0 AS sheet_idx, 'first' AS sheet, CAST(row_idx AS BIGINT) AS row_idx, cells FROM (SELECT * FROM top UNION ALL SELECT * FROM first)
  UNION ALL SELECT source_file, 1, 'second', CAST(row_idx AS BIGINT), cells FROM (SELECT * FROM top UNION ALL SELECT * FROM second))"""
# the score of each of the first six rows: filled cells, those that look like labels, rows of about the same size among the next four
_SCORED = f"""{_GRID},
f AS (SELECT *, list_filter(list_transform(cells, lambda x: trim(x)), lambda x: x <> '') AS filled, len(cells) AS width FROM g),
near AS (SELECT *, lead(len(filled), 1) OVER o AS n1, lead(len(filled), 2) OVER o AS n2, lead(len(filled), 3) OVER o AS n3, lead(len(filled), 4) OVER o AS n4 FROM f WINDOW o AS (PARTITION BY source_file, sheet_idx ORDER BY row_idx)),
scored AS (SELECT *, CASE WHEN len(filled) < 2 THEN 0.0 ELSE len(filled) / width * 0.4
    + len(list_filter(filled, lambda x: length(x) <= 40 AND NOT regexp_full_match(regexp_replace(x, '[.-]', '', 'g'), '[0-9]+'))) / len(filled) * 0.4
    + len(list_filter([n1, n2, n3, n4], lambda x: x IS NOT NULL AND abs(x - len(filled)) <= 1)) / greatest(1, len(list_filter([n1, n2, n3, n4], lambda x: x IS NOT NULL))) * 0.2 END AS score
  FROM near WHERE row_idx < 6)"""
_PICKED = f"{_SCORED}, heads AS (SELECT source_file, sheet_idx, min(row_idx) AS header_idx FROM (SELECT *, max(score) OVER (PARTITION BY source_file, sheet_idx) AS best FROM scored) WHERE score = best GROUP BY 1, 2)"
HEADER_DETECT = f"WITH {_SCORED} SELECT source_file, row_idx, round(score, 6) AS score FROM scored WHERE sheet_idx = 0"
HEADER_PICK = f"WITH {_PICKED} SELECT source_file, header_idx FROM heads WHERE sheet_idx = 0"


def _deduped(cells: str) -> str:
    """Names of a header row: blanks by their place, repeats by how often the name stands before."""
    names = f"list_transform({cells}, lambda x, i: CASE WHEN trim(x) = '' THEN concat('col', i) ELSE trim(x) END)"
    return f"list_transform({names}, lambda x, i: CASE WHEN len(list_filter({names}[1 : i - 1], lambda y: y = x)) > 0 THEN concat(x, '_', len(list_filter({names}[1 : i - 1], lambda y: y = x))) ELSE x END)"


HEADER_CELLS = "CASE c_custkey % 3 WHEN 0 THEN ['x', '  ', c_mktsegment, ' x', concat(c_mktsegment, ' '), 'x'] WHEN 1 THEN ['', c_name, '', c_name] ELSE [c_mktsegment, 'AUTOMOBILE', 'col4', ' ', concat(' ', c_mktsegment)] END"
HEADER_DEDUPE = f"SELECT c_custkey, array_to_string({_deduped('cells')}, '|') AS headers FROM (SELECT c_custkey, {HEADER_CELLS} AS cells FROM customer)"


def _shaped() -> str:
    """Rows below their header with the pairs of header and filled cell."""
    return f"""{_PICKED}, named AS (SELECT source_file, sheet_idx, header_idx, {_deduped('cells')} AS names FROM g JOIN heads USING (source_file, sheet_idx) WHERE row_idx = header_idx),
shaped AS (SELECT source_file, sheet_idx, sheet, row_idx, list_filter(list_transform(names, lambda x, i: {{'h': x, 'v': trim(cells[i])}}), lambda p: p.v <> '') AS pairs FROM g JOIN named USING (source_file, sheet_idx) WHERE row_idx > header_idx),
rows_ AS (SELECT *, 'row ' || (row_idx + 1) AS row_or_page, array_to_string(list_transform(pairs, lambda p: concat(p.h, ': ', p.v)), chr(10)) AS raw_text FROM shaped WHERE len(pairs) > 0)"""


def _hinted(pairs: str, hints: tuple[str, ...]) -> str:
    return f"list_filter({pairs}, lambda p: {' OR '.join(f"contains(lower(p.h), '{h}')" for h in hints)})"


def _shape_rows() -> str:
    from ..functions import vocab as V

    titles = ", ".join(f"{_hinted('pairs', (h,))}[1].v" for h in V.TITLE_COLUMNS)
    plain = "list_filter(pairs, lambda p: length(p.v) > 3 AND NOT regexp_full_match(p.v, '[0-9]+') AND NOT regexp_full_match(p.v, '\\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\\s*'))[1].v"
    names = " ".join(f"WHEN '{t.lower().replace(chr(39), chr(39) * 2)}' THEN '{t}'" for t in V.TAXONOMY)
    category = f"list_filter(list_transform({_hinted('pairs', V.CATEGORY_COLUMNS)}, lambda p: CASE lower(trim(p.v)) {names} END), lambda x: x IS NOT NULL)[1]"
    return f"""
WITH {_shaped()}
SELECT source_file, row_or_page, coalesce({titles}, {plain}, pairs[1].v) AS title, raw_text, coalesce({category}, '{V.UNCATEGORISED}') AS category,
  array_to_string(list_transform({_hinted('pairs', V.RECIPIENT_COLUMNS)}, lambda p: p.v), '  ') AS recipient,
  CASE WHEN contains(source_file, 'register') THEN 'letter' WHEN contains(source_file, 'minute') THEN 'minutes' ELSE 'tracker' END AS source_type
FROM rows_ WHERE sheet_idx = 0"""


SHAPE_ROWS = _shape_rows()

EXPLICIT = """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'War Room' END AS category, CASE WHEN p_size > 10 THEN p_name
  WHEN length(p_name) > 3 THEN p_name ELSE p_type END AS title FROM part"""

NEAR_DUP = rf"""
WITH {_shaped()},
keyed AS (SELECT *, list_sort(list_filter(list_transform(pairs, lambda p: lower(trim(regexp_replace(p.v, '\s+', ' ', 'g')))), lambda v: length(v) >= 10)) AS content FROM rows_)
SELECT source_file, sheet, row_or_page, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY source_file, content ORDER BY sheet_idx, row_idx) AS place FROM keyed) WHERE place = 1 OR len(content) = 0"""

# from one group's end to the next: the first line whose running length is the budget beyond the end before
CHUNKS = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list(p ORDER BY i) AS p, list(s ORDER BY i) AS s FROM (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS s FROM l) GROUP BY 1),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM c
  UNION ALL SELECT r.doc_id, b, coalesce(CAST(list_position(list_transform(s, lambda x: x >= coalesce(s[b], 0) + 1500), true) AS BIGINT), CAST(len(p) AS BIGINT)) FROM r JOIN c USING (doc_id) WHERE b < len(p)),
bodies AS (SELECT doc_id, a, regexp_replace(array_to_string(p[a + 1 : b], chr(10)), '^\\s+|\\s+$', '', 'g') AS body FROM r JOIN c USING (doc_id) WHERE b > a)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS part, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS body_md5 FROM bodies WHERE body <> ''"""

MARKDOWN = r"""
SELECT 'deck_' || item_id || '.md' AS source_file, 'part' AS title, trim('part' || chr(10) || trim(text || chr(10) || '### sub' || chr(10) || 'tail' || chr(10) || '##')) AS raw_text, 'section 2' AS row_or_page FROM benchmark
UNION ALL
SELECT 'deck_' || item_id || '.md', 'two words', 'two words ' || chr(10) || 'end', 'section 4' FROM benchmark"""

_TOK = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+'), lambda t: lower(t))"
_GRAMS = "list_concat(['w:' || t], flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(t) + 2 >= n THEN list_transform(range(1, length(t) + 4 - n), lambda i: 'g:' || substr('^' || t || '$', i, n)) ELSE [] END)))"

NGRAMS = f"""
WITH w AS (SELECT item_id, unnest({_TOK.format('lower(text)')}) AS t FROM benchmark),
f AS (SELECT item_id, unnest({_GRAMS}) AS f FROM w)
SELECT item_id, f, count(*) AS n FROM f GROUP BY 1, 2"""


def _slots(dim: int) -> str:
    return f"CAST(('0x' || substr(md5(f), 1, 12))::UBIGINT % {dim} AS BIGINT)"


_SIGN = "CASE WHEN ('0x' || substr(md5(f), 13, 2))::UBIGINT % 2 = 1 THEN 1 ELSE -1 END"

HASHING = f"""
WITH w AS (SELECT item_id, unnest({_TOK.format('lower(text)')}) AS t FROM benchmark),
f AS (SELECT item_id, unnest({_GRAMS}) AS f FROM w),
s AS (SELECT item_id, {_slots(768)} AS slot, sum({_SIGN}) AS v FROM f GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
SELECT item_id, slot, round(v / norm, 6) AS weight FROM s JOIN n USING (item_id) WHERE v <> 0"""


def cosine(where: str = "") -> str:
    return f"""
WITH q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings {where}),
s AS (SELECT qid, id, round(list_dot_product(a, b), 9) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 30"""


def index_tokens(text: str) -> str:
    return rf"list_transform(regexp_extract_all(strip_accents({text}), '[\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: lower(t))"


_BM25 = """
df AS (SELECT qid, phrase, count(*) AS n FROM f GROUP BY 1, 2),
corpus AS (SELECT count(*) AS docs, avg(len) AS avgdl FROM lens),
sc AS (SELECT f.qid, f.id, round(sum(greatest_idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) AS score
  FROM f JOIN (SELECT qid, phrase, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS greatest_idf FROM df, corpus) USING (qid, phrase)
  JOIN lens USING (id), corpus GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)"""


def _terms(queries: str) -> str:
    """Phrases of each query as the index cuts them; terms that are no content only count where there is nothing else."""
    content = rf"list_filter(w, lambda t: length(t) >= 2 AND NOT list_contains([{STOP}], t) AND NOT regexp_full_match(t, '[\p{{Nd}}]+'))"
    return f"""
q0 AS ({queries}), q1 AS (SELECT qid, {_TOK.format('query')} AS w, lower(query) AS lq FROM q0),
q2 AS (SELECT qid, list_distinct(list_concat({content}, {_lexicon('lq', 'w')})) AS ts, list_distinct(list_filter(w, lambda t: length(t) >= 2)) AS every FROM q1),
q3 AS (SELECT qid, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE every END) AS phrase FROM q2),
t AS (SELECT qid, phrase, {index_tokens('phrase')} AS toks FROM q3)"""


def _lexicon(text: str, tokens: str) -> str:
    """Synonyms of the default lexicon's terms in a text."""
    from ..functions.vocab import LEXICON

    parts = []
    for group in LEXICON:
        members = "[" + ", ".join(f"'{m}'" for m in group) + "]"
        called = " OR ".join(f"contains({text}, '{m}')" if " " in m else f"list_contains({tokens}, '{m}')" for m in group)
        parts.append(f"CASE WHEN {called} THEN {members} ELSE [] END")
    return f"list_filter(list_distinct(flatten([{', '.join(parts)}])), lambda m: length(m) >= 2 AND NOT list_contains({tokens}, m))"


def _corpus(fields: bool) -> str:
    body = f"SELECT doc_id AS id, 1.0 AS w, {index_tokens('text')} AS toks FROM documents"
    if not fields:
        return body
    line = "substr(split_part(text, chr(10), 1), 1, 120)"
    other = [(line, 6.0), ("source", 16.0), ("lang", 8.0)]
    return " UNION ALL ".join([body, *(f"SELECT doc_id, {w}, {index_tokens(c)} FROM documents" for c, w in other)])


def _keyword(queries: str, fields: bool) -> str:
    return f"""{_terms(queries)},
c AS ({_corpus(fields)}), lens AS (SELECT id, sum(len(toks)) AS len FROM c GROUP BY 1),
p AS (SELECT id, w, unnest(toks) AS tok FROM c),
f AS (SELECT qid, phrase, id, sum(w) AS f FROM p JOIN (SELECT qid, phrase, toks[1] AS tok FROM t WHERE len(toks) = 1) USING (tok) GROUP BY 1, 2, 3),{_BM25}"""


def bm25(queries: str, fields: bool = False) -> str:
    return f"WITH {_keyword(queries, fields)} SELECT qid, rank, id, round(score, 6) AS score FROM kw WHERE rank <= 30"


def indexed(queries: str, kept: str, text: str, where: str = "true") -> str:
    """Searches in an index of documents as records: of those that ``kept`` holds for, with ``text`` as theirs; hits are
    those that ``where`` holds for."""
    fields = [("title || chr(10) || text", 1.0), ("title", 6.0), ("source", 16.0), ("lang", 8.0)]
    corpus = " UNION ALL ".join(f"SELECT id, {w} AS w, {index_tokens(c)} AS toks FROM x" for c, w in fields)
    return f"""
WITH {_terms(queries)},
x AS (SELECT substr(sha1(concat(source, '|', lang, '|doc ', doc_id, '|', title)), 1, 16) AS id, title, source, lang, {text} AS text FROM (SELECT *, substr(split_part(text, chr(10), 1), 1, 120) AS title FROM documents) WHERE {kept}),
c AS ({corpus}), lens AS (SELECT id, sum(len(toks)) AS len FROM c GROUP BY 1),
p AS (SELECT id, w, unnest(toks) AS tok FROM c),
f AS (SELECT qid, phrase, id, sum(w) AS f FROM p JOIN (SELECT qid, phrase, toks[1] AS tok FROM t WHERE len(toks) = 1) USING (tok) GROUP BY 1, 2, 3),{_BM25}
, kept AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE {where})
SELECT qid, rank, id, round(score, 6) AS score FROM kept WHERE rank <= 30"""


def phrases(texts: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(texts))
    return f"""
WITH v AS (SELECT CAST(a AS BIGINT) AS qid, b AS phrase FROM (VALUES {values}) AS x(a, b)),
c AS ({_corpus(False)}), lens AS (SELECT id, len(toks) AS len FROM c),
two AS (SELECT qid, phrase, split_part(phrase, ' ', 1) AS t1, split_part(phrase, ' ', 2) AS t2 FROM v),
f AS (SELECT qid, phrase, id, CAST(len(list_filter(range(1, len(toks)), lambda i: toks[i] = t1 AND toks[i + 1] = t2)) AS DOUBLE) AS f FROM c, two
  WHERE len(list_filter(range(1, len(toks)), lambda i: toks[i] = t1 AND toks[i + 1] = t2)) > 0),{_BM25}
SELECT qid, rank, id, round(score, 6) AS score FROM kw WHERE rank <= 30"""


def bm25_filtered(queries: str, where: str) -> str:
    """Figures are those of all documents; the filter comes before the ranks."""
    return f"""WITH {_keyword(queries, False)}, kept AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE id IN (SELECT doc_id FROM documents WHERE {where}))
SELECT qid, rank, id, round(score, 6) AS score FROM kept WHERE rank <= 30"""


# ---- files and tags ----

INGEST_CSV = SHAPE_ROWS.replace("SELECT source_file, row_or_page, coalesce(", "SELECT source_file, regexp_replace(source_file, '\\.csv$', '') AS sheet, row_or_page, coalesce(", 1)

_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
INGEST_TEXTS = f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS kind, CASE WHEN doc_id % 4 IN (0, 3) THEN replace(coalesce(text, ''), '#', '+') ELSE coalesce(text, '') END AS t FROM documents),
b AS (SELECT *, {_strip(f"regexp_replace(t, '{_BREAK}', chr(10), 'g')")} AS body, list_filter(list_transform(regexp_split_to_array(t, '{_BREAK}'), lambda x: {_strip('x')}), lambda x: x <> '')[1] AS line FROM d)
SELECT CASE kind WHEN 0 THEN concat('plan_', doc_id, '.md') WHEN 1 THEN concat('scan_', doc_id, '.txt') WHEN 2 THEN concat('log_', doc_id, '.bin') ELSE concat('meeting_', doc_id, '.txt') END AS source_file,
  CASE WHEN kind = 2 THEN NULL WHEN kind = 1 OR body = '' THEN 'page 1' WHEN kind = 0 THEN 'section 1' ELSE 'section 0' END AS row_or_page,
  CASE WHEN kind = 0 AND body = '' THEN concat('plan_', doc_id) WHEN kind = 0 THEN concat('T', doc_id) WHEN kind = 1 THEN substr(line, 1, 120) WHEN kind = 2 THEN concat('log_', doc_id, '.bin') ELSE concat('meeting_', doc_id) END AS title,
  md5(CASE WHEN kind = 0 AND body = '' THEN concat('# T', doc_id, chr(10), t) WHEN kind = 0 THEN concat('T', doc_id, chr(10), body) WHEN kind = 3 AND body <> '' THEN concat('meeting_', doc_id, chr(10), body) ELSE t END) AS text_md5,
  CASE kind WHEN 0 THEN 'deck' WHEN 1 THEN 'scan' WHEN 2 THEN 'unknown' ELSE 'minutes' END AS source_type
FROM b WHERE kind <> 1 OR body <> ''"""


READ_SHEET = f"WITH {_GRID} SELECT source_file, sheet_name AS sheet, row_idx, array_to_string(cells, '|') AS cells FROM (SELECT *, regexp_replace(source_file, '\\.csv$', '') AS sheet_name FROM g WHERE sheet_idx = 0)"

XLSX_CELLS = """
SELECT concat('orders_', o_custkey % 50, '.xlsx') AS source_file, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS row_idx,
  concat_ws('|', o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(o_totalprice AS VARCHAR) END,
    strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 12:00' ELSE '' END, CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END, o_orderstatus) AS cells FROM orders"""

SIDECARS = f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS kind, coalesce(text, '') AS t, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_BREAK}'), lambda x: {_strip('x')}), lambda x: x <> '')[1] AS line FROM documents)
SELECT concat('photo_', doc_id, CASE kind WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.ocr.txt' END) AS source_file, substr(line, 1, 120) AS title, md5(t) AS text_md5, 'page 1' AS row_or_page FROM d WHERE kind <> 2 AND {_strip('t')} <> ''"""

_LEX = f"lex AS (SELECT DISTINCT term, item_id AS concept, item_id AS rank FROM (SELECT item_id, unnest([w[1], w[2], w[3] || ' ' || w[4]]) AS term FROM (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark)) WHERE term IS NOT NULL)"
LEXICON_SYNONYMS = f"""
WITH {_LEX}, pairs AS (SELECT DISTINCT a.term, b.term AS alias FROM lex a JOIN lex b USING (concept)),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_distinct({_TOK.format("coalesce(text, '')")}) AS own FROM documents),
hit AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(own) AS term FROM d) JOIN (SELECT DISTINCT term FROM lex WHERE NOT contains(term, ' ')) USING (term)
  UNION SELECT doc_id, term FROM d, (SELECT DISTINCT term FROM lex WHERE contains(term, ' ')) WHERE contains(low, term)),
al AS (SELECT doc_id, list_sort(list(DISTINCT alias)) AS a FROM hit JOIN pairs USING (term) JOIN d USING (doc_id) WHERE NOT list_contains(own, alias) GROUP BY 1)
SELECT doc_id, coalesce(array_to_string(a, '|'), '') AS aliases FROM d LEFT JOIN al USING (doc_id)"""
LEXICON_LABELS = f"""
WITH {_LEX}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, arg_min('c' || concept, rank) AS category FROM d, lex WHERE contains(lower(text), term) GROUP BY 1),
p AS (SELECT doc_id, list(term ORDER BY lpad(CAST(rank AS VARCHAR), 19, '0') || ' ' || term) AS places FROM d, lex WHERE contains(text, term) GROUP BY 1)
SELECT doc_id, coalesce(category, 'Uncategorised') AS category, coalesce(array_to_string(places, '|'), '') AS places FROM d LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)"""

LOOKUP = "SELECT doc_id, substr(sha1(concat(source, '|', lang, '|doc ', doc_id, '|', title)), 1, 16) AS id, title, md5(text) AS text_md5 FROM (SELECT *, substr(split_part(text, chr(10), 1), 1, 120) AS title FROM documents) WHERE doc_id % 50 = 0"


def index_vectors(dim: int, pool: int) -> str:
    """Vector searches in an index under a filter: vectors of title and text, in single precision, of one language's records."""
    docs = "SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 120) || chr(10) || text AS text FROM documents WHERE lang = 'fr'"
    return f"""
WITH {_vectors("qv", "SELECT item_id AS id, text FROM benchmark", dim)}, {_vectors("dv", docs, dim)},
dots AS (SELECT a.id AS qid, b.id AS id, sum(a.v * CAST(CAST(b.v AS FLOAT) AS DOUBLE)) AS s FROM qv_v a JOIN dv_v b USING (slot) GROUP BY 1, 2),
vs AS (SELECT q.item_id AS qid, d.doc_id AS id, round(coalesce(s, 0), 9) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.qid = q.item_id AND dots.id = d.doc_id WHERE d.lang = 'fr'),
v AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= {pool})
SELECT qid, rank, round(score, 6) AS score FROM v"""


INGEST_XLSX = f"SELECT replace(source_file, '.csv', '.xlsx') AS source_file, sheet, row_or_page, raw_text FROM ({NEAR_DUP})"


def ingest_office() -> str:
    from .inputs import NO_XML

    lines = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{NO_XML}', ' ', 'g'), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS kind, {lines} AS x FROM documents),
s AS (SELECT concat('deck_', doc_id, '.pptx') AS source_file, concat('T', doc_id) AS title, concat_ws(chr(10), concat('T', doc_id), nullif(array_to_string(x, chr(10)), ''), CASE WHEN kind = 1 THEN concat('Notes: n', doc_id) END) AS body, 'slide 1' AS row_or_page, 'deck' AS source_type, x FROM d WHERE doc_id % 2 = 1
  UNION ALL SELECT concat('text_', doc_id, '.docx'), concat('H', doc_id), concat('H', doc_id, chr(10), array_to_string(x, chr(10))), 'section 1', 'report', x FROM d WHERE kind = 0 AND len(x) > 0
  UNION ALL SELECT concat('letter_', doc_id, '.docx'), concat('letter_', doc_id), concat('letter_', doc_id, chr(10), x[1]), 'section 0', 'letter', x FROM d WHERE kind = 2 AND len(x) > 0
  UNION ALL SELECT concat('letter_', doc_id, '.docx'), concat('H', doc_id), concat('H', doc_id, chr(10), array_to_string(x[2:], chr(10))), 'section 1', 'letter', x FROM d WHERE kind = 2 AND len(x) > 1)
SELECT source_file, title, row_or_page, source_type, md5(body) AS text_md5 FROM s"""


OUTCOMES = """
SELECT concat('a_', doc_id, ['.md', '.docx', '.xlsx', '.pptx', '.pdf', '.csv'][doc_id % 6 + 1]) AS path, CASE doc_id % 6 WHEN 0 THEN 'read' WHEN 4 THEN 'skipped' WHEN 5 THEN 'empty' ELSE 'failed' END AS outcome,
  CASE doc_id % 6 WHEN 4 THEN 'pymupdf is not installed' WHEN 0 THEN NULL WHEN 5 THEN NULL ELSE 'BadZipFile: File is not a zip file' END AS reason FROM documents"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _notes() -> str:
    """The records of inputs.tag_texts: title, text, and both as the tags see them."""
    from .inputs import TAG_PHRASES

    picked = ", ".join(f"[{', '.join(map(_sql, x))}][c_custkey % {len(x)} + 1]" for x in TAG_PHRASES)
    return f"""
n AS (SELECT c_custkey, concat('note ', c_custkey, chr(10), concat_ws(' ', {picked}, 'with Shri Ab' || c_custkey)) AS t, [{', '.join(map(_sql, TAG_PHRASES[0]))}][c_custkey % 5 + 1] AS topic, c_custkey % 3 = 0 AS letter FROM customer),
w AS (SELECT *, lower(t) AS low, list_distinct({_TOK.format('t')}) AS own, lower(topic) AS topic_low, list_distinct({_TOK.format('topic')}) AS topic_own FROM n)"""


def _first_held(low: str, choices: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, {_sql(a)}) THEN {_sql(b)}" for a, b in choices) + " END"


def tags() -> str:
    from ..functions import vocab as V

    triggers = [(t.lower(), c) for c, ts in V.CATEGORY_HINTS.items() for t in ts]
    departments = [*((d.lower(), d) for d in V.DEPARTMENTS), *V.DEPARTMENT_SHORTHANDS]
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    marked = lambda words: f"len(list_filter([{', '.join(map(_sql, words))}], lambda x: list_contains(words, x)))"
    return rf"""
WITH {_notes()},
x AS (SELECT *, regexp_extract(t, '\b(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})\b', ['y', 'm', 'd']) AS a, regexp_extract(t, '\b(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})\b', ['d', 'm', 'y']) AS b,
  regexp_extract(t, '\b(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})\b', ['d', 'm', 'y']) AS c, regexp_extract(t, '\b([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b', ['m', 'd', 'y']) AS e,
  len(regexp_extract_all(t, '[\x{{0900}}-\x{{097F}}]')) AS dn, len(regexp_extract_all(t, '[A-Za-z]')) AS ln, list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+')) AS words FROM w),
y AS (SELECT *, CASE WHEN a.y <> '' THEN a.y WHEN b.y <> '' THEN b.y WHEN c.y <> '' THEN c.y ELSE e.y END AS yy,
  CASE WHEN a.y <> '' THEN a.m WHEN b.y <> '' THEN b.m WHEN c.y <> '' THEN CAST(list_position({months}, lower(substr(c.m, 1, 3))) AS VARCHAR) ELSE CAST(list_position({months}, lower(substr(e.m, 1, 3))) AS VARCHAR) END AS mm,
  CASE WHEN a.y <> '' THEN a.d WHEN b.y <> '' THEN b.d WHEN c.y <> '' THEN c.d ELSE e.d END AS dd FROM x)
SELECT c_custkey, CASE WHEN TRY_CAST(yy AS INT) BETWEEN 1900 AND 2100 AND TRY_CAST(mm AS INT) BETWEEN 1 AND 12 AND TRY_CAST(dd AS INT) BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', CAST(yy AS INT), CAST(mm AS INT), CAST(dd AS INT)) END AS date,
  CASE WHEN dn > 0.15 * (dn + ln) AND ln > 0.15 * (dn + ln) THEN 'mixed' WHEN dn > 0.15 * (dn + ln) THEN CASE WHEN {marked(V.HINDI_MARKERS)} > {marked(V.MARATHI_MARKERS)} THEN 'hin' ELSE 'mar' END ELSE 'eng' END AS language,
  {_first_held('low', departments)} AS department, CASE WHEN letter THEN '{V.UNCATEGORISED}' ELSE coalesce({_first_held('low', triggers)}, '{V.UNCATEGORISED}') END AS category,
  array_to_string(list_filter([{', '.join(map(_sql, V.PLACES))}], lambda p: contains(t, p)), '|') AS places,
  array_to_string(regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_])((?:{_TITLES})\s+[A-Z][\p{{L}}\p{{N}}_.''-]+(?:\s+[A-Z][\p{{L}}\p{{N}}_.''-]+)*)', 1), '|') AS entities,
  array_to_string({_aliases('low', 'own', V.LEXICON)}, ' ') AS alias_text FROM y"""


def field_aliases() -> str:
    """Aliases of a field after two spaces, of a query after one."""
    from ..functions import vocab as V

    listed = f"array_to_string({_aliases('topic_low', 'topic_own', V.LEXICON)}, ' ')"
    return f"WITH {_notes()}, z AS (SELECT c_custkey, topic, {listed} AS al FROM w) SELECT c_custkey, CASE WHEN al = '' THEN topic ELSE concat(topic, '  ', al) END AS recipient, CASE WHEN al = '' THEN topic ELSE concat(topic, ' ', al) END AS query FROM z"


STATS = """
WITH d AS (SELECT lang, source, 'report' AS st, CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN 'middle' END AS dep FROM documents)
SELECT CASE WHEN grouping(lang) = 0 THEN 'language' WHEN grouping(source) = 0 THEN 'category' WHEN grouping(st) = 0 THEN 'source_type' ELSE 'department' END AS kind,
  coalesce(lang, source, st, dep) AS value, count(*) AS n
FROM d GROUP BY GROUPING SETS ((lang), (source), (st), (dep)) HAVING coalesce(lang, source, st, dep) IS NOT NULL"""

MANIFEST = """
WITH p AS (SELECT page_id, url || '#' || page_id AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages)
SELECT path, change FROM (SELECT path, CASE WHEN page_id % 7 = 0 AND page_id % 5 <> 0 THEN 'added' WHEN page_id % 5 = 0 AND page_id % 7 <> 0 THEN 'removed'
  WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 3 = 0 THEN 'changed' END AS change FROM p) WHERE change IS NOT NULL"""

_LEGS = """
o AS (SELECT o_custkey AS qid, o_orderkey AS id, o_totalprice AS p, o_orderdate AS d FROM orders),
k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY p DESC, id) AS kr FROM o WHERE p > 50000 QUALIFY kr <= 5),
v AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d DESC, id) AS vr FROM o QUALIFY vr <= 5),"""


def _fused(limit: int) -> str:
    return f"""
b AS (SELECT coalesce(k.qid, v.qid) AS qid, coalesce(k.id, v.id) AS id, kr, vr, coalesce(2.0 / (60 + kr), 0) + coalesce(1.0 / (60 + vr), 0) AS score FROM k FULL JOIN v ON k.qid = v.qid AND k.id = v.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kr ASC NULLS LAST, vr ASC) AS rank FROM b QUALIFY rank <= {limit})"""


_WHY = "concat_ws('+', 'keyword#' || kr, 'semantic#' || vr) AS why"
RRF = f"WITH {_LEGS}{_fused(5)} SELECT qid, rank, id, round(score, 6) AS score, {_WHY} FROM r"

ANSWER = f"""
WITH {_LEGS}{_fused(5)},
a AS (SELECT qid, count(*) AS n, min_by(id, rank) AS id FROM r GROUP BY qid)
SELECT c_custkey AS qid, CASE WHEN n IS NULL THEN 'No records matched this query.' ELSE concat('Top match: ', o_orderpriority, ' [orders · row ', id, '].',
  CASE WHEN n > 1 THEN concat(' ', n - 1, ' further related record(s) also matched.') ELSE '' END, ' Returned ', n, ' record(s) with sources; review the citations below.') END AS answer
FROM customer LEFT JOIN a ON c_custkey = qid LEFT JOIN orders ON o_orderkey = id"""


def _vectors(name: str, source: str, dim: int) -> str:
    return f"""
{name}_w AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOK.format('lower(text)')}) AS t FROM ({source})) GROUP BY 1, 2),
{name}_f AS (SELECT t, {_slots(dim)} AS slot, sum({_SIGN}) AS v FROM (SELECT t, unnest({_GRAMS}) AS f FROM (SELECT DISTINCT t FROM {name}_w)) GROUP BY 1, 2),
{name}_s AS (SELECT id, slot, CAST(sum(n * v) AS DOUBLE) AS v FROM {name}_w JOIN {name}_f USING (t) GROUP BY 1, 2),
{name}_v AS (SELECT id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {name}_s WHERE v <> 0)"""


def hybrid(dim: int, pool: int, limit: int) -> str:
    """A document without any vector has cosine 0 with all queries."""
    return f"""
WITH {_keyword("SELECT item_id AS qid, text AS query FROM benchmark", False)},
{_vectors("qv", "SELECT item_id AS id, text FROM benchmark", dim)}, {_vectors("dv", "SELECT doc_id AS id, text FROM documents", dim)},
dots AS (SELECT a.id AS qid, b.id AS id, sum(a.v * b.v) AS s FROM qv_v a JOIN dv_v b USING (slot) GROUP BY 1, 2),
vs AS (SELECT q.item_id AS qid, d.doc_id AS id, round(coalesce(s, 0), 9) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.qid = q.item_id AND dots.id = d.doc_id),
k AS (SELECT qid, id, rank AS kr FROM kw WHERE rank <= {pool}),
v AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS vr FROM vs QUALIFY vr <= {pool}),{_fused(limit)}
SELECT qid, rank, id, round(score, 6) AS score, {_WHY} FROM r"""
