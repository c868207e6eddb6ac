"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation is empty or has an optional system turn first, then pairs of a user and an assistant turn. The
cheapest edits are found by dynamic programming: backwards over the turns, the cost to go from each state of that
grammar; then forwards, at each turn the edit with the least letter among those that keep to that cost.

Conversations are range-partitioned with their turns, so a very long one spreads over many tasks. What a task holds whole
is repaired there. Of a conversation that may go on in another task, each part becomes a 4 x 4 table of costs from state
to state; such tables are multiplied over a conversation's parts, backwards, which gives every part the costs to go from
its end; each part is then walked from all four states at once, and the walks are joined up forwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import ship_package, stored

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a user or assistant turn leads to from each state: the one target of Rerole and Insert.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40
BLANK, DUPLICATE, CUT = "b", "d", "t"
ALTERNATE = {"su", "ua", "au"}
#: Bytes that one part of a conversation has at most, but for its last turn.
PART = 8_000_000

Costs = tuple[int, ...]


# ---- dynamic programming ----

# A turn is known by its code: s, u, a or - for its role, and its fault or a space.


def _code(role: str, fault: str) -> str:
    return (role[0] if role[:1] in AFTER else "-") + fault


def _edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """Delete, Keep and Rerole of a turn: (letter, cost, next state), letters ascending."""
    out = [("D", DELETE, state)]
    if code[1] not in (BLANK, DUPLICATE):
        more = TRUNCATED if code[1] == CUT else 0
        if state in AFTER.get(code[0], ()):
            out.append(("K", more, AFTER[code[0]][state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _relaxed(costs: list[int]) -> Costs:
    """The costs where turns may be inserted before the next edit."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _split(costs: Costs) -> tuple[Costs, int]:
    """Costs less their minimum, and that minimum."""
    least = min(costs)
    return tuple(FAR if c >= FAR // 2 else c - least for c in costs), least


@lru_cache(1 << 16)
def _back(code: str, after: Costs) -> tuple[Costs, int]:
    """Costs to go from before a turn, less their minimum, and that minimum. Costs that differ by a constant are one key,
    so there are few."""
    return _split(_relaxed([min(c + after[t] for _, c, t in _edits(code, s)) for s in range(4)]))


@lru_cache(1 << 16)
def _forth(code: str, after: Costs, state: int) -> tuple[str, int]:
    """The letters up to and with a turn's own edit, and the state behind it."""
    before, least = _back(code, after)
    letters = ""
    while True:
        tight = [(x, t) for x, c, t in _edits(code, state) if c + after[t] == before[state] + least]
        insert = INSERT + before[NEXT[state]] == before[state]
        if tight and (tight[0][0] < "I" or not insert):
            return letters + tight[0][0], tight[0][1]
        letters, state = letters + "I", NEXT[state]


#: Costs to go from the end of a conversation.
LAST = _relaxed([0, FAR, FAR, 0])


def costs_to_go(codes: list[str], after: Costs = LAST) -> tuple[list[Costs], Costs]:
    """The costs behind each turn, less their minimum, and the whole costs before the first turn."""
    now, total = _split(after)
    behind = []
    for code in reversed(codes):
        behind.append(now)
        now, least = _back(code, now)
        total += least
    return behind[::-1], tuple(FAR if c == FAR else c + total for c in now)


def walk(codes: list[str], behind: list[Costs], state: int = START) -> tuple[list[str], int]:
    """The letters of each turn, with those of turns inserted before it, and the last state."""
    out = []
    for code, after in zip(codes, behind, strict=True):
        letters, state = _forth(code, after, state)
        out.append(letters)
    return out, state


def tail(state: int) -> str:
    """Insertions behind the last turn."""
    letters = ""
    while LAST[state]:
        letters, state = letters + "I", NEXT[state]
    return letters


class _Rebuilt:
    """The digest and the edits of a conversation, turn by turn."""

    def __init__(self):
        self.sha, self.state, self.sep, self.audit = hashlib.sha256(), START, "", []

    def add(self, letters: str, role: str = "", text: str = "") -> None:
        self.audit.append(letters)
        for x in letters:
            if x == "D":
                continue
            self.state = AFTER[role[0]][self.state] if x == "K" else NEXT[self.state]
            name, said = role if x == "K" else ROLE[self.state], "" if x == "I" else text
            self.sha.update(f"{self.sep}{name}:{said}".encode())
            self.sep = "\n"

    def ended(self) -> dict:
        self.add(tail(self.state))
        return {"audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


# ---- turns ----


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32 of ``conv:turn`` modulo 20 does to a row: 0 drops it, 1
    empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. A null
    role or text is one space, also a null id or turn in that key."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(conv.alias("conv"), turn.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _fault(text: str) -> str:
    """BLANK, CUT or a space; reads the text from its end."""
    for c in reversed(text):
        if c not in " \t\n\x0b\x0c\r":
            return " " if c in ".!?" else CUT
    return BLANK


def _counted(codes: list[str]) -> dict:
    faults = [c[1] for c in codes]
    illegal = sum(a[0] + b[0] not in ALTERNATE for a, b in zip(codes[:-1], codes[1:], strict=True))
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": illegal}


def _different(turns: list) -> list:
    """The different turns; they come in order."""
    return [t for t, _ in groupby(turns) if t is not None]


def _gaps(first: int | None, last: int | None, different: int) -> int:
    return last - first + 1 - different if different else 0


def _whole(rows: list[dict]) -> dict:
    """The result for a conversation that is here whole."""
    codes = [_code(r["role"], r["fault"]) for r in rows]
    behind, before = costs_to_go(codes)
    rebuilt = _Rebuilt()
    for letters, r in zip(walk(codes, behind)[0], rows, strict=True):
        rebuilt.add(letters, r["role"], r["text"])
    known = _different([r["turn"] for r in rows])
    return {"conv": rows[0]["conv"], "gaps": _gaps(known[0], known[-1], len(known)) if known else 0, **_counted(codes), "cost": before[START], **rebuilt.ended()}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
OPEN = "turn bigint, role string, text string, part bigint, at bigint, fault string, digest binary"


def _parts(turns: Iterator[dict], size: int) -> Iterator[list[dict]]:
    """A conversation's turns in lists of bounded size, with their faults and, unless seen in the list before, digests."""
    held, seen, used = [], set(), 0
    for r in turns:
        key = hashlib.blake2b(repr((r["conv"], r["role"], r["text"])).encode(), digest_size=16).digest()
        r["fault"] = _fault(r["text"])
        if r["fault"] != BLANK and key in seen:
            r["fault"] = DUPLICATE
        r["digest"] = key if r["fault"] not in (BLANK, DUPLICATE) else None
        seen.add(key)
        held.append(r)
        used += len(r["text"]) + 200
        if used >= size:
            yield held
            held, seen, used = [], set(), 0
    if held:
        yield held


def _first_pass(schema: pa.Schema, size: int):
    """Conversations that begin and end inside a task become results. The turns of its first and last one, which other
    tasks may hold more of, and of those longer than ``size`` go on, in numbered parts."""

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                yield from b.slice(k, 500).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, out, used = TaskContext.get().partitionId() << 32, [], [], 0
        for k, (_, turns) in enumerate(groupby(turns_of(batches), key=lambda r: r["conv"])):
            if waiting:
                out.append(_whole(waiting))
            lists = _parts(turns, size)
            waiting, more = next(lists), next(lists, None)
            if not k or more:
                for rows in chain([waiting], [more] if more else [], lists):
                    out += [{**r, "part": part, "at": at} for at, r in enumerate(rows)]
                    part += 1
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                waiting = []
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        out += [{**r, "part": part, "at": at} for at, r in enumerate(waiting)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# ---- conversations in parts ----

PARTS = "part bigint, codes string, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, costs array<bigint>"


def _part(turns: pa.Table, late: pa.Table) -> pa.Table:
    """What a part's neighbours need of it: counts, and the costs from each state before it to each state behind it."""
    rows = turns.sort_by("at").to_pylist()
    again = set(late.column("digest").to_pylist())
    codes = [_code(r["role"], DUPLICATE if r["digest"] in again else r["fault"]) for r in rows]
    known = _different([r["turn"] for r in rows])
    costs = [costs_to_go(codes, tuple(0 if t == s else FAR for t in range(4)))[1] for s in range(4)]
    row = {"conv": rows[0]["conv"], "part": rows[0]["part"], "codes": "".join(codes), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(known)}
    row |= _counted(codes) | {"costs": [costs[t][s] for s in range(4) for t in range(4)]}
    return pa.Table.from_pylist([row], pa.schema([turns.schema.field("conv"), *PART_FIELDS]))


PART_FIELDS = [pa.field(n, {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[k]) for n, k in (c.split() for c in PARTS.split(", "))]


def _backwards(parts: pa.Table) -> pa.Table:
    """The costs to go from the end of each part of a conversation; with the first part, the whole conversation's figures."""
    rows, after = parts.sort_by("part").to_pylist(), LAST
    out = []
    for r in reversed(rows):
        out.append({"conv": r["conv"], "part": r["part"], "after": list(after)})
        after = tuple(min(r["costs"][4 * s + t] + after[t] for t in range(4)) for s in range(4))
    known = [r for r in rows if r["turns"]]
    shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known[:-1], known[1:], strict=True))
    figures = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    figures["illegal"] += sum(a["codes"][-2] + b["codes"][0] not in ALTERNATE for a, b in zip(rows[:-1], rows[1:], strict=True))
    gaps = _gaps(known[0]["first_turn"], known[-1]["last_turn"], sum(r["turns"] for r in known) - shared) if known else 0
    out[-1] |= {"gaps": gaps, **figures, "cost": after[START]}
    return pa.Table.from_pylist(out, pa.schema([parts.schema.field("conv"), ("part", pa.int64()), ("after", pa.list_(pa.int64())), *((n, pa.int64()) for n in NAMES[:6])]))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part walked from all four states: the letters of its turns, and the state behind it."""
    for b in batches:
        letters, ends = [], []
        for codes, after in zip(b.column("codes").to_pylist(), b.column("after").to_pylist(), strict=True):
            codes = [codes[k : k + 2] for k in range(0, len(codes), 2)]
            behind, _ = costs_to_go(codes, tuple(after))
            found = [walk(codes, behind, s) for s in range(4)]
            letters.append([",".join(x) for x, _ in found])
            ends.append([s for _, s in found])
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int64()))], ["conv", "part", "letters", "ends"])


def _forwards(parts: pa.Table) -> pa.Table:
    """The state before each part of a conversation."""
    rows = parts.sort_by("part")
    state, states = START, []
    for ends in rows.column("ends").to_pylist():
        states.append(state)
        state = ends[state]
    return pa.table({"part": rows.column("part"), "state": pa.array(states, pa.int64())})


def _rebuild(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns with their letters, in order, to the edits and digest of each conversation; one turn at a time."""
        rows = (r for b in batches for k in range(0, b.num_rows, 500) for r in b.slice(k, 500).to_pylist())
        for conv, turns in groupby(rows, key=lambda r: r["conv"]):
            rebuilt = _Rebuilt()
            for r in turns:
                rebuilt.add(r["letters"], r["role"], r["text"])
            yield pa.RecordBatch.from_pylist([{"conv": conv, **rebuilt.ended()}], schema)

    return run


def _of_parts(opened: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that are held in parts."""
    # a turn said before: in the same part that is known; of others, each part's first one meets those of earlier parts
    fresh = opened.where("digest IS NOT NULL").select("digest", "part")
    least = stored(fresh.groupBy("digest").agg(F.min("part").alias("least")), "first_said")
    late = stored(fresh.join(least, "digest").where("part > least").select("part", "digest"), "said_again")
    spoken = opened.select("conv", "part", "at", "turn", "role", "fault", "digest")
    parts = stored(spoken.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(_part, f"conv {kind}, {PARTS}"), "conversation_parts")
    after = stored(parts.groupBy("conv").applyInArrow(_backwards, f"conv {kind}, part bigint, after array<bigint>, " + ", ".join(f"{n} bigint" for n in NAMES[:6])), "costs_to_go")
    walked = parts.select("conv", "part", "codes").join(after.select("part", "after"), "part").select("conv", "part", "codes", "after")
    walked = stored(walked.mapInArrow(_walks, f"conv {kind}, part bigint, letters array<string>, ends array<bigint>"), "walks")
    states = walked.select("conv", "part", "ends").groupBy("conv").applyInArrow(_forwards, "part bigint, state bigint")
    edits = walked.select("part", "letters").join(states, "part").select("part", F.posexplode(F.split(F.get("letters", F.col("state").cast("int")), ",")).alias("at", "letters"))
    turns = opened.select("conv", "part", "at", "role", "text").join(edits, ["part", "at"]).select("conv", "part", "at", "role", "text", "letters")
    turns = turns.repartition("conv").sortWithinPartitions("conv", "part", "at")
    schema = pa.schema([("conv", to_arrow_type(opened.schema["conv"].dataType)), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    rebuilt = turns.mapInArrow(_rebuild(schema), f"conv {kind}, audit string, repaired_sha256 string")
    figures = after.where("cost IS NOT NULL")
    return figures.alias("f").join(rebuilt.alias("r"), F.col("f.conv").eqNullSafe(F.col("r.conv"))).select("f.conv", *NAMES[:6], *NAMES[6:])


def repair(turns: DataFrame, part_size: int = PART, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of turns, after
    damaged().

    Turns come by number, nulls first, those with one number by role and text; a repeated row is a duplicate turn. A null
    id is a conversation like others. A role without s, u or a as its first letter, an empty one too, is never kept and
    always illegal. Other columns are not read; an empty table gives an empty table.
    """
    spark = turns.sparkSession
    ship_package(spark)
    rows = damaged(turns, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, {RESULT}, {OPEN}"
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    first = stored(dealt.mapInArrow(_first_pass(fields, part_size), schema), "conversations")
    done = first.where("part IS NULL").select("conv", *NAMES)
    found = done.union(_of_parts(first.where("part IS NOT NULL").select("conv", *(c.split()[0] for c in OPEN.split(", "))), kind.simpleString()))
    all_ = turns.select(F.col(conv_col).alias("id")).distinct()
    none = {**dict.fromkeys(NAMES[:6], 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return all_.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(F.col("id").alias(conv_col), *(F.coalesce(n, F.lit(v)).alias(n) for n, v in none.items()))
