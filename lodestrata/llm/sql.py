"""DuckDB SQL for the rows of collocations, decontamination and conversation repair."""

from __future__ import annotations

from . import collocations, conversations, decontaminate

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM g WHERE k > 1 AND f >= {collocations.LEAST}),
cut AS (SELECT c.lang, c.g, c.a, j, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
  JOIN g l ON l.lang = c.lang AND l.g = array_to_string(c.w[1 : j], ' ') JOIN g r ON r.lang = c.lang AND r.g = array_to_string(c.w[j + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
own AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = b.lang AND 100 * d.a >= 100 * b.a AND d.g <> b.g AND contains(' ' || d.g || ' ', ' ' || b.g || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score FROM own
QUALIFY rank <= {collocations.TOP}"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s : s + {decontaminate.WIDTH - 1}], ' ') AS g, least(len(w), {decontaminate.WIDTH}) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {decontaminate.WIDTH - 2}))) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT DISTINCT row, s, m, g FROM (SELECT row, s, m, array_to_string(w[s : s + m - 1], ' ') AS g
  FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)) WHERE g IN (SELECT g FROM win)),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + m)) AS p FROM o) GROUP BY 1),
x AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM o JOIN win USING (g)) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN x USING (row)"""


def _struct(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 't': {lines}}}"


def _edit(state: int) -> str:
    """The best of Delete, Keep and Rerole from a state, by cost, then letters."""
    more = f"CASE WHEN fault = 't' THEN {conversations.TRUNCATED} ELSE 0 END"
    free = "fault NOT IN ('b', 'd')"
    keep = {0: "WHEN {f} AND x = 's' THEN {k1} WHEN {f} AND x = 'u' THEN {k2}", 1: "WHEN {f} AND x = 'u' THEN {k2}", 2: "WHEN {f} AND x = 'a' THEN {k3}", 3: "WHEN {f} AND x = 'u' THEN {k2}"}[state]
    kept = {f"k{t}": _struct(f"{more} + s{t}.c", f"'K' || s{t}.a", f"list_prepend(role || ':' || text, s{t}.t)") for t in (1, 2, 3)}
    to = conversations.NEXT[state]
    rerole = _struct(f"{conversations.REROLE} + {more} + s{to}.c", f"'R' || s{to}.a", f"list_prepend('{conversations.ROLE[to]}:' || text, s{to}.t)")
    delete = _struct(f"{conversations.DELETE} + s{state}.c", f"'D' || s{state}.a", f"s{state}.t")
    return f"list_min([{delete}, CASE {keep.format(f=free, **kept)} END, CASE WHEN {free} THEN {rerole} END]) AS s{state}"


def _insert(state: int) -> str:
    to = conversations.NEXT[state]
    inserted = _struct(f"{conversations.INSERT} + s{to}.c", f"'I' || s{to}.a", f"list_prepend('{conversations.ROLE[to]}:', s{to}.t)")
    return f"list_min([s{state}, {inserted}]) AS s{state}"


def _step() -> str:
    out = "SELECT o.conv, o.i, " + ", ".join(map(_edit, range(4))) + " FROM r JOIN o ON o.conv IS NOT DISTINCT FROM r.conv AND o.i = r.i - 1"
    for _ in range(3):
        out = "SELECT conv, i, " + ", ".join(map(_insert, range(4))) + f" FROM ({out})"
    return out


_END, _EMPTY = _struct("0", "''", "CAST([] AS VARCHAR[])"), "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

OP13_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
b AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM b, tab),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, role[1] AS x, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM n),
r AS (SELECT conv, max(i) + 1 AS i, {_END} AS s0, {_struct("10", "'II'", "['user:', 'assistant:']")} AS s1, {_struct("5", "'I'", "['assistant:']")} AS s2, {_END} AS s3 FROM o GROUP BY 1 UNION ALL {_step()}),
f AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
  coalesce(sha256(array_to_string(s0.t, chr(10))), '{_EMPTY}') AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv IS NOT DISTINCT FROM c.conv_id AND r.i = 1"""
