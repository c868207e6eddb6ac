"""Phrases, decontamination and conversation repair against brute force, on untidy tables and with tiny shards and parts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from lodestrata.llm import collocations, conversations, decontaminate
from lodestrata.llm.fm_index import FMIndex, suffix_order

DOCS = "doc_id bigint, text string, lang string, shard string, words string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- phrases ----


def brute_phrases(docs, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    wanted = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in wanted.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[lang, p[i : i + k]] == a}
    out = []
    for (lang, p), a in wanted.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p), left, right))
    out.sort(key=lambda r: (r[0], r[1], r[2], r[3].encode()))
    rows, seen = [], Counter()
    for lang, score, a, phrase, left, right in out:
        seen[lang] += 1
        if seen[lang] <= top:
            rows.append((lang, seen[lang], phrase, -a, left, right, n[lang], -score))
    return rows


def phrase_docs(rng):
    words = ["the", "of", "Straße", "x", "İ", "naïve", "\x0b", "b\x00c", "ÉTÉ"]
    fixed = "one two THREE four five six seven"
    out = []
    for k in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", " "]) for _ in range(rng.randrange(60)))
        text += fixed if k % 3 == 0 else ""
        out.append((k, text, rng.choice(["en", "de", None]), "s", "w"))
    return [*out, out[0], out[0], (None, None, "en", None, None), (99, "", None, None, None), (100, "the the the the the the the", "fr", None, None)]


def test_bitmaps_extend_phrases(monkeypatch):
    """Shifted and ANDed bitmaps, batch by batch, against counting; carries into the next block too."""
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 5, 700).astype(np.int32)
    f = [Counter(tuple(tokens[i : i + k].tolist()) for i in range(len(tokens) - k + 1) if tokens[i : i + k].all()) for k in range(6)]
    for step in (10**6, 40):
        monkeypatch.setattr(collocations, "STEP", step)
        maps, got = collocations._Bitmaps(tokens), [Counter() for _ in range(6)]
        for nodes in maps.roots():
            for k in range(2, 6):
                *nodes, counts = maps.extend(*nodes, None)
                got[k].update(dict(zip(map(tuple, nodes[0].tolist()), counts.tolist(), strict=True)))
        assert got[2:] == f[2:]
        pairs = np.array([1 * maps.width + 2, 2 * maps.width + 2])
        found = Counter()
        for nodes in maps.roots():
            for _ in range(2):
                *nodes, counts = maps.extend(*nodes, pairs)
            found.update(dict(zip(map(tuple, nodes[0].tolist()), counts.tolist(), strict=True)))
        assert found == Counter({p: n for p, n in f[3].items() if p in ((1, 2, 2), (2, 2, 2))})
    assert not list(collocations._Bitmaps(np.zeros(50, np.int32)).roots())


@pytest.mark.parametrize("shard", [50, 10**6])
def test_collocations(spark, shard):
    docs = phrase_docs(random.Random(7))
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    for least, longest, top in ((5, 5, 7), (2, 3, 1000), (3, 2, 1000)):
        got = collocations.collocations(frame, least, longest, top, shard).collect()
        assert sorted(map(tuple, got)) == sorted(brute_phrases(docs, least, longest, top)), (least, longest)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS), 1).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a", None, None, None)], DOCS), 1).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12 + 7, 3 * 10**13 + 1, 10**12 + 9, 2 * 10**12 + 3), (100, 100, 10**9, 10**10)], "a bigint, n bigint, l bigint, r bigint")
    got = [r[0] for r in rows.select(collocations._score(rows.a, rows.n, rows.l, rows.r)).collect()]
    assert got == [1000 * (10**12 + 7) * (3 * 10**13 + 1) // ((10**12 + 9) * (2 * 10**12 + 3)), 0]


# ---- decontamination ----


def test_suffix_order_and_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(0, 30, rng.integers(1, 8))
        words = rng.integers(1, rng.integers(2, 9), sizes.sum()).astype(np.uint64)
        index = FMIndex.build(words, sizes)
        text, at = [], 0
        for n in sizes.tolist():
            text += [*words[at : at + n].tolist(), 0]
            at += n
        ends = iter(range(-len(sizes), 0))
        ranked = [next(ends) if w == 0 else w for w in text]
        assert suffix_order(np.searchsorted(np.unique(np.r_[np.uint64(0), words]), np.array(text, np.uint64))).tolist() == sorted(range(len(text)), key=lambda i: ranked[i:])
        phrases = {tuple(rng.integers(1, 9, rng.integers(1, 5)).tolist()) for _ in range(20)}
        phrases |= {tuple(text[i : i + 4]) for i in range(len(text) - 4) if 0 not in text[i : i + 4]}
        phrases = sorted(phrases)
        flat, lengths = np.zeros((len(phrases), 4), np.uint64), np.array(list(map(len, phrases)))
        for k, p in enumerate(phrases):
            flat[k, : len(p)] = p
        found = {k: sorted(index.locate(np.arange(lo, hi)).tolist()) for k, lo, hi in zip(*(x.tolist() for x in index.search(flat, lengths)), strict=True)}
        for k, p in enumerate(phrases):
            assert found.get(k, []) == [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(docs, items, width):
    tests = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            tests.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w = item_words(text)
        hit, found = set(), set()
        for m in {len(t) for t in tests}:
            for i in range(len(w) - m + 1):
                if own := tests.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contaminated_docs(rng):
    words = ["alpha", "Beta", "γ", "d4", "été", "five"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", "_"]) for _ in range(n))
    passages = [say(25) for _ in range(6)]
    items = [*enumerate(passages), (10, "alpha beta"), (11, "γ"), (12, ""), (13, None), (None, "five five five"), (0, say(12)), (20, passages[0]), (1, "zzz"), (9, say(10))]
    docs = [(k, say(rng.randrange(50)) + (rng.choice(passages).upper() if k % 4 == 0 else "") + say(3), "en", "s", "w") for k in range(40)]
    docs += [docs[0], docs[4], (None, passages[1], None, None, None), (77, None, None, None, None), (78, "", None, None, None), (79, "!!! ...", None, None, None), (80, say(3000) + passages[2], None, None, None)]
    return docs, items


@pytest.mark.parametrize("shard, block", [(60, 7), (10**6, 10**6)])
def test_decontaminate(spark, shard, block):
    docs, items = contaminated_docs(random.Random(5))
    frame, tests = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build_index(frame, shard)
    for width in (10, 3):
        found = decontaminate.search(index, decontaminate.windows(tests, width), width, block)
        assert sorted(map(tuple, decontaminate.digest(found).collect()), key=repr) == brute_contamination(docs, items, width)
        assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) and r["items"] == sorted(r["items"]) for r in found.collect())


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep this: the QUICK brown-fox, and this.", None, None, None), (2, None, None, None, None), (3, "nothing", None, None, None)], DOCS)
    items = spark.createDataFrame([(1, "the quick brown fox")], "item_id bigint, text string")
    found = decontaminate.decontaminate(docs, items)
    rows = docs.join(found.select("doc_id", "spans"), "doc_id").select("doc_id", decontaminate.without_spans(docs.text, found.spans).alias("t")).collect()
    assert dict(map(tuple, rows)) == {1: "Keep this: , and this.", 2: None, 3: "nothing"}


def test_decontaminate_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    empty = hashlib.sha256().hexdigest()
    assert list(map(tuple, decontaminate.digest(decontaminate.decontaminate(some, items)).collect())) == [(1, 2, 0, 0, empty, False)]
    assert list(map(tuple, decontaminate.digest(decontaminate.decontaminate(some.limit(0).union(some.selectExpr("doc_id", "CAST(null AS string)", "lang", "shard", "words")), spark.createDataFrame([(1, "a")], items.schema))).collect())) == [(1, 0, 0, 0, empty, False)]


# ---- conversations ----


def brute_repair(rows):
    """Best edits by searching forwards over all of them, with whole strings."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text, *_ in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
        faults, seen = [], set()
        for _, role, text in turns:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, turns=tuple(turns), faults=tuple(faults)):
            options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
            target = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[target]
            if i < len(turns):
                _, role, text = turns[i]
                add = lambda cost, letter, line, to: options.append((lambda r: (r[0] + cost, letter + r[1], line + r[2]))(best(i + 1, to)))
                add(2, "D", (), state)
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    if role[:1] == target or role[:1] == "s" and state == "":
                        add(more, "K", (f"{role}:{text}",), role[:1])
                    add(1 + more, "R", (f"{name}:{text}",), target)
            depth = best.depth.get((i, state), 0)
            return min(options + inserted(i, state, target, name, best), key=lambda r: r[:2]) if depth == 0 else min(options, default=(10**9, "", ()))

        def inserted(i, state, target, name, best):
            out = []
            for chain in (((target, name),), ((target, name), ({"u": "a", "a": "u"}[target], {"user": "assistant", "assistant": "user"}[name]))):
                to = chain[-1][0]
                best.depth[i, to] = 1
                r = best.__wrapped__(i, to)
                best.depth[i, to] = 0
                out.append((r[0] + 5 * len(chain), "I" * len(chain) + r[1], tuple(f"{n}:" for _, n in chain) + r[2]))
            return out

        best.depth = {}
        cost, audit, lines = best(0, "")
        known = [t[0] for t in turns if t[0] is not None]
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, cost string, part string"


def conversation_rows(rng):
    rows = []
    texts = ["Yes.", "No!", "cut off", "", " \t", "Same words?", "what 。", None, "a.\n"]
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"Turn {turn} of {conv}.", f"Turn {turn}."]), "c", "p"))
    for turn in range(300):
        rows.append((1000, turn, rng.choice(["user", "assistant"]), f"{rng.choice(texts[:6])}{turn % 40}{rng.choice(['.', ''])}", None, None))
    rows += [(2000, t, "user", "x.", None, None) for t in range(40) if zlib.crc32(f"2000:{t}".encode()) % 20 == 0]  # all dropped
    return rows + rows[:20] + [(3000, None, "assistant", "Only nulls.", None, None)]


@pytest.mark.parametrize("part", [300, 10**6])
def test_repair(spark, part):
    rows = conversation_rows(random.Random(11))
    expected = brute_repair(rows)
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(frame, part).collect()}
    assert got.keys() == expected.keys()
    assert [(k, got[k], expected[k]) for k in got if got[k] != expected[k]] == []


def test_repair_in_many_tasks(spark):
    """With more tasks than conversations most of them lie in several."""
    rows = conversation_rows(random.Random(12))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_repair(rows)


def test_repair_nothing(spark):
    assert conversations.repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0
