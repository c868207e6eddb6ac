"""Exact n-gram Jaccard self-join by prefix lists with set-relation skipping.

1. Every document's set of word shingles becomes 64-bit numbers; equal sets are one set from here on.
2. Which shingles do other sets hold too? Sets of a task form packed batches; a batch asks the buckets (ranges of shingle
   numbers) and gets one packed answer from each. Common shingles were counted within the batch before, so a bucket
   holds one entry of each batch for them. One shuffle of the corpus's packed numbers; the answers hold shared ones only.
3. The batch puts its answers together. Two sets that link share percent of the larger one at least, so a set with fewer
   shared shingles goes, before there is any row for a set. The others are the index: their shared shingles from rare to
   common (frequency, then number), and the length of the prefix in which two sets that link share a shingle.
4. Index-level skipping: lists of the index are cut into blocks by set size. From its size and its position in the list a
   set knows the largest set that it can still link to there, and looks into no block beyond.
5. Answer-level skipping: first each list's sets are compared with its leaders. The overlaps of two sets with a common
   leader bound their own overlap from both sides; where that settles the answer it is derived, and only what stays open
   is computed from the sets. A set linked to a leader is in its component, and pairs within one are never looked at.
   Rounds take more pairs of each list and component pair, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, ship_package, stored
from .batches import pieces, texts
from .components import components
from .shingles import mix, set_numbers, shingle_sets

#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 75
WIDTH = 5
#: Sets that one packed batch of postings holds at most (their places in it are 16-bit numbers), and shingles.
BATCH_SETS, BATCH_SHINGLES = 60_000, 2_000_000
#: Shingles of all documents that one bucket gets about, whatever the number of shuffle partitions.
BUCKET_SHINGLES = 2_000_000
#: Entries of each component that a round takes in each block of a list; after the last step it takes all.
STEPS = (1, 16, 256, 4096, 65_536, 2**20)
#: A round goes as far in STEPS as it has at most so many pairs for each entry of the open lists; one step in any case.
ALL_PAIRS = 16
#: Pairs that are few: the numbers of their sets, 8 bytes each, go to every task.
FEW_PAIRS = 500_000
#: Shingles of each set whose lists the first round takes, with one leader; leaders of all lists in the second one.
HEAD, LEADERS = 4, 16


#: Sets that have the number of another set, by number and second number, and the number that they get instead.
Renamed = dict[tuple[int, int], int]
#: Most such sets; 2**65 / n**2 makes them a handful for 10**11 sets.
MOST_RENAMED = 100_000


def _sets(batches: Iterator[pa.RecordBatch], width: int, renamed: Renamed) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, shingles, sizes, numbers, second numbers)."""
    doubtful = np.array(sorted({a for a, _ in renamed}), np.int64)
    for b in pieces(batches, "text"):
        shingles, sizes = shingle_sets([x.encode() for x in texts(b.column("text"))], width)
        numbers, second = set_numbers(shingles, sizes), set_numbers(shingles, sizes, 61)
        for k in np.flatnonzero(np.isin(numbers, doubtful)).tolist() if len(doubtful) else ():
            numbers[k] = renamed.get((int(numbers[k]), int(second[k])), numbers[k])
        yield b, shingles, sizes, numbers, second


def document_sets(docs: DataFrame, width: int, id_col: str, text_col: str, renamed: Renamed = {}) -> DataFrame:  # noqa: B006
    """(id, n_shingles, set, second) for each row of docs: a set is known by 64 bits, and by 128 with the second number."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, sizes, numbers, second in _sets(batches, width, renamed):
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (sizes, numbers, second))], ["id", "n_shingles", "set", "second"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, set bigint, second bigint")


def namesakes(sets: DataFrame) -> Renamed:
    """Different sets with one number: all but the one with the least second number get another number, which its second
    number makes. Sets that share both numbers are equal but for a probability of about n * n / 2**129."""
    both = sets.where("n_shingles > 0").groupBy("set").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo < hi")
    if both.isEmpty():
        return {}
    found = sets.join(both.select("set", "lo"), "set").where("second > lo").select("set", "second").distinct().limit(MOST_RENAMED + 1).collect()
    if len(found) > MOST_RENAMED:
        raise ValueError("too many sets share their numbers")
    return {(r["set"], r["second"]): int(mix(np.array([r["second"]], np.int64).view(np.uint64) ^ np.uint64(r["set"] % 2**64)).view(np.int64)[0]) for r in found}


#: Sets with several rows: their numbers in ascending order, and of each the key of the row that stands for all.
Copied = tuple[np.ndarray, np.ndarray]
NO_COPIES: Copied = (np.zeros(0, np.int64), np.zeros(0, np.int64))
#: Most such sets that every task is told, 16 bytes each. Copies of other sets count as sets of their own until the index.
MOST_COPIED = 2_000_000


def copied_sets(sets: DataFrame) -> Copied:
    """Of document_sets(): the sets with several rows, each with the least key (a hash of the id) of its rows."""
    many = sets.where("n_shingles > 0").groupBy("set").agg(F.min(F.xxhash64("id")).alias("key"), F.count("*").alias("rows")).where("rows > 1")
    found = many.select("set", "key").limit(MOST_COPIED).toArrow()
    numbers, keys = (found.column(c).to_numpy() for c in ("set", "key"))
    order = np.argsort(numbers)
    return numbers[order], keys[order]


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: of the high bytes only what they tell is left. First the number of bytes."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return raw.size.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw.size else b""


def _full(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences."""
    return _squeezed(np.diff(np.concatenate([np.zeros(1, np.uint64), values])).astype("<u8"))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_full(data, "<u8"))


REQUESTS = "bucket bigint, batch bigint, lone binary, places binary, sets binary, repeated binary, counts binary"


def packed_postings(docs: DataFrame, width: int, buckets: int, id_col: str, text_col: str, renamed: Renamed = {}, copied: Copied = NO_COPIES) -> DataFrame:  # noqa: B006
    """REQUESTS: what the buckets have to know of each batch of sets, and what the batches keep.

    A bucket gets the shingles of its range of numbers: those that one set of the batch holds (lone) with the set's
    place in the batch; those that several hold (repeated) with their number only. Nothing of a set itself goes to the
    buckets, so that requests don't grow with sets times buckets: of copied sets only the row with the key is sent.
    Bucket -1 - batch, which nothing else has, is the batch's own row: all sets and sizes, and the places of the repeated
    shingles. So a common shingle is one entry of each batch, however many sets hold it.
    """
    rows = docs.select(F.xxhash64(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_sets = n_shingles = n_batches = 0
        task = TaskContext.get().partitionId() << 32
        edges = (np.arange(buckets + 1, dtype=object) * 2**64 // buckets)[1:-1].astype(np.uint64)

        def flush() -> pa.RecordBatch:
            shingles = np.concatenate([s for s, _, _ in held])
            sizes, numbers = np.concatenate([z for _, z, _ in held]), np.concatenate([x for _, _, x in held])
            place = np.repeat(np.arange(len(sizes)).astype("<u2"), sizes)
            order = np.argsort(shingles, kind="stable")
            shingles, place = shingles[order], place[order]
            first = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
            count = np.diff(np.r_[first, len(shingles)])
            alone = count == 1
            lone, lone_place, repeated, counts = shingles[first[alone]], place[first[alone]], shingles[first[~alone]], count[~alone].astype("<u4")
            cut_lone, cut_repeated = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (lone, repeated))
            batch = task + n_batches
            out = [(-1 - batch, batch, b"", _squeezed(place[np.repeat(~alone, count)]), numbers.astype("<i8").tobytes() + sizes.astype("<i8").tobytes(), _pack(repeated), _squeezed(counts))]
            for k in range(buckets):
                (a, b), (c, d) = cut_lone[k : k + 2], cut_repeated[k : k + 2]
                if a < b or c < d:
                    out.append((k, batch, _pack(lone[a:b]), _squeezed(lone_place[a:b]), b"", _pack(repeated[c:d]), _squeezed(counts[c:d])))
            names = [x.split()[0] for x in REQUESTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.binary()) for i in range(len(names))], names)

        for b, shingles, sizes, numbers, _ in _sets(batches, width, renamed):
            fresh, own = np.zeros(len(sizes), bool), sizes > 0
            if len(copied[0]):  # another row stands for the set
                at = np.minimum(np.searchsorted(copied[0], numbers), len(copied[0]) - 1)
                own &= (copied[0][at] != numbers) | (copied[1][at] == b.column("key").to_numpy())
            for i, (x, mine) in enumerate(zip(numbers.tolist(), own.tolist(), strict=True)):
                if mine and x not in seen:  # this task has sent an equal set already
                    seen.add(x)
                    fresh[i] = True
            if not fresh.any():
                continue
            shingles = shingles[np.repeat(fresh, sizes)]
            sizes, numbers = sizes[fresh], numbers[fresh]
            if held and (n_sets + len(sizes) > BATCH_SETS or n_shingles + len(shingles) > BATCH_SHINGLES):
                yield flush()
                held, n_sets, n_shingles, n_batches = [], 0, 0, n_batches + 1
            held.append((shingles, sizes, numbers))
            n_sets, n_shingles = n_sets + len(sizes), n_shingles + len(shingles)
        if held:
            yield flush()

    return rows.mapInArrow(run, REQUESTS)


ANSWERS = "batch bigint, bucket bigint, shingles binary, df binary, places binary, sets binary, repeated binary, counts binary"


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket, for each batch: its lone shingles that another set holds too, with document frequency and place,
    and the frequencies of its repeated ones. A batch's own row goes through.

    Frequencies count sets of batches: copies that several batches hold (rows with one id, or beyond MOST_COPIED) count
    again. They only order the shingles, and every shingle of two sets has at least 2.
    """
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:
        out = [(x["batch"], x["bucket"], b"", b"", x["places"], x["sets"], x["repeated"], x["counts"]) for x in rows]
    else:
        lone, repeated = [_unpack(x["lone"]) for x in rows], [_unpack(x["repeated"]) for x in rows]
        s = np.concatenate([*lone, *repeated])
        weight = np.concatenate([np.ones(sum(map(len, lone)), np.int64), *(_full(x["counts"], "<u4").astype(np.int64) for x in rows)])
        order = np.argsort(s, kind="stable")
        s, weight = s[order], weight[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        df = np.add.reduceat(weight, first)
        shared, df = s[first][df > 1], np.minimum(df[df > 1], 2**31 - 1).astype("<i4")
        out = []
        for row, own, many in zip(rows, lone, repeated, strict=True):
            k = np.minimum(np.searchsorted(shared, own), max(len(shared) - 1, 0))
            hit = shared[k] == own if len(shared) else np.zeros(len(own), bool)
            out.append((row["batch"], row["bucket"], _pack(own[hit]), _squeezed(df[k[hit]]), _squeezed(_full(row["places"], "<u2")[hit]), b"", b"", _squeezed(df[np.searchsorted(shared, many)])))
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    return pa.table([pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.binary()) for i in range(len(names))], names=names)


INDEX = "set bigint, n bigint, shingles array<bigint>, prefix bigint"


def _indexed(percent: int):
    """For one batch, from its own row and its answers: INDEX of the sets whose shared shingles reach into the prefix."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["bucket"])
        own, rest = rows[0], rows[1:]
        numbers, sizes = np.split(np.frombuffer(own["sets"], "<i8"), 2)
        counts = _full(own["counts"], "<u4")
        s = np.concatenate([np.repeat(_unpack(own["repeated"]), counts), *(_unpack(x["shingles"]) for x in rest)])
        df = np.concatenate([np.repeat(np.concatenate([_full(x["counts"], "<i4") for x in rest]), counts), *(_full(x["df"], "<i4") for x in rest)])
        place = np.concatenate([_full(x["places"], "<u2") for x in rows]).astype(np.int64)
        least = (sizes * percent + 99) // 100
        shared = np.bincount(place, minlength=len(sizes))
        busy = np.flatnonzero((shared >= least) & (sizes > 0))
        keep = np.isin(place, busy)
        s, df, place = s[keep], df[keep], place[keep]
        s = s[np.lexsort((s, df, place))]
        offsets = pa.array(np.r_[0, np.cumsum(shared[busy])].astype(np.int32))
        return pa.table([pa.array(numbers[busy]), pa.array(sizes[busy]), pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64))), pa.array(shared[busy] - least[busy] + 1)], names=["set", "n", "shingles", "prefix"])

    return run


def need(n: Column, percent: int) -> Column:
    """Least intersection with any set that a set of n shingles can link to: n * percent / 100, rounded up."""
    return F.floor((n * percent + 99) / 100)


def index_of(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, buckets: int, renamed: Renamed = {}, copied: Copied = NO_COPIES) -> DataFrame:  # noqa: B006
    """(set, n, shingles, prefix): sets that may link, their shared shingles from rare to common, and how many of these
    lie in the prefix; those not shared come before, so position i of the array is position n - size + i of the set."""
    answers = packed_postings(docs, width, buckets, id_col, text_col, renamed, copied).groupBy("bucket").applyInArrow(_answers, ANSWERS)
    found = answers.groupBy("batch").applyInArrow(_indexed(percent), INDEX)
    return found.dropDuplicates(["set"])  # copies of a set in several batches


def _block(n: Column, percent: int) -> Column:
    """Number of the block of sizes that n lies in; sets that link lie in the same block or in adjacent ones."""
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _reach(percent: int) -> Column:
    """Largest set that one with n shingles, ``left`` of them from this list's on, can link to by this list. The overlap
    is at most ``left`` and has to be percent / (100 + percent) of both sizes together."""
    return F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("left") * (100 + percent) / percent) - F.col("n"))


def _visited(percent: int, from_: Column) -> Column:
    """Blocks of a list that a set looks into, from the one numbered from_: those whose smallest size is in reach from
    its position. All other blocks are skipped unread."""
    last = _block(_reach(percent), percent)
    return F.explode(F.when((_reach(percent) > 0) & (last >= from_), F.sequence(from_, last)).otherwise(F.array().cast("array<int>"))).alias("block")


def _fits(percent: int) -> Column:
    """Sizes and positions of two list entries x and y still allow the threshold."""
    most = F.least(F.col("x_left"), F.col("y_left"))
    return (100 * most >= percent * (F.col("x_n") + F.col("y_n") - most)) & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))


def _verify(pairs: DataFrame, index: DataFrame, few: bool) -> DataFrame:
    """(a, b, both, a_n, b_n): intersection and sizes of each pair. Where the pairs are few, only the sets that they name
    are shuffled; their numbers go to every task for that."""
    if few:
        named = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        index = index.join(F.broadcast(named), "set", "left_semi")
    one = index.select(F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("shingles").alias("a_s"))
    two = index.select(F.col("set").alias("b"), F.col("n").alias("b_n"), F.col("shingles").alias("b_s"))
    both = F.size(F.array_intersect("a_s", "b_s")).cast("bigint")
    return pairs.join(two, "b").join(one, "a").select("a", "b", both.alias("both"), "a_n", "b_n")


def _linked(both: Column, n: Column, percent: int) -> Column:
    """Two sets with n shingles together, both of which they share, reach the threshold."""
    return 100 * both >= percent * (n - both)


def _derived(percent: int) -> Column:
    """What the overlaps of x and y with a set that both have been compared with settle about x and y: true (linked),
    false (not linked), or null where there is no such set or it leaves the answer open."""
    x, y, n = F.col("x_both"), F.col("y_both"), F.col("x_n") + F.col("y_n")
    most = F.least(x, y) + F.least(F.col("x_n") - x, F.col("y_n") - y)
    settled = F.when(_linked(x + y - F.col("hub_n"), n, percent), True).when(~_linked(most, n, percent), False)
    return F.when(F.col("x_hub") == F.col("y_hub"), settled)


def link_components(index: DataFrame, percent: int) -> DataFrame:
    """(set, root) for each set that links to another one; root is the component's smallest set number."""
    temporary: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """A stored table that goes at the end of the round."""
        temporary.append(stored(df, name))
        return temporary[-1]

    size = F.size("shingles")
    prefixes = stored(index.select("set", "n", size.alias("size"), F.slice("shingles", 1, F.col("prefix").cast("int")).alias("prefix")), "prefixes")
    known = roots = open_ = None

    def rooted(rows: DataFrame) -> DataFrame:
        """Rows of sets with their components so far."""
        own = rows.join(roots.select(F.col("id").alias("set"), "root"), "set", "left")
        return own.withColumn("root", F.coalesce("root", "set"))

    def lists(sets: DataFrame, most: int | None = None) -> DataFrame:
        """Entries of the lists of the sets' whole prefixes, or of the first ``most`` shingles. left: shingles of the set
        from this position on; alone: those that no other set has."""
        entries = sets.select("set", "n", "size", "root", F.posexplode("prefix" if most is None else F.slice("prefix", 1, most)).alias("i", "shingle"))
        return entries.select("shingle", _block(F.col("n"), percent).alias("block"), "set", "n", (F.col("size") - F.col("i")).alias("left"), (F.col("n") - F.col("size")).alias("alone"), "root")

    def reopen() -> None:
        """Entries of the lists that hold two components still. Components only grow, so a list that has one is done."""
        nonlocal open_
        rows = lists(rooted(prefixes)) if open_ is None else rooted(open_.drop("root"))
        span = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
        old, open_ = open_, stored(rows.join(kept(span, "span"), "shingle", "left_semi"), "open")
        temporary.extend([] if old is None else [old])

    def settle(cross: DataFrame) -> None:
        """Answers the candidate pairs (x, y) that have no answer yet and renews the components. ``derived`` says what
        similar sets' answers settle already; only what they leave open is computed from the sets."""
        nonlocal known, roots
        pairs = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "derived")
        pairs = pairs.groupBy("a", "b").agg(F.max("derived").alias("derived")).where("derived is null or derived")
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = kept(pairs, "candidates")
        n = pairs.count()
        if roots is not None and not n:
            while temporary:
                drop_stored(temporary.pop())
            return
        fresh = stored(_verify(pairs.where("derived is null").select("a", "b"), index, n <= FEW_PAIRS), "pairs")
        new = fresh.where(_linked(F.col("both"), F.col("a_n") + F.col("b_n"), percent)).select("a", "b").union(pairs.where("derived").select("a", "b"))
        if roots is None or new.limit(1).count():
            # components so far are stars already: a link of each set to its root stands for all links before
            old, roots = roots, stored(components(new if roots is None else roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(new)), "roots")
            temporary.extend([] if old is None else [old])
        if known is None:
            known = fresh
        else:
            temporary.extend((known, fresh))
            known = stored(known.union(fresh), "known")
        while temporary:
            drop_stored(temporary.pop())

    def answered(rows: DataFrame) -> DataFrame:
        """Rows with a set that they have been compared with (hub, the first leader of the list's block), its size and
        the overlap with it (hub_n, both); nulls where there is none. A leader's overlap with itself is its size."""
        if known is None:
            return rows.withColumns({c: F.lit(None).cast("bigint") for c in ("hub", "hub_n", "both")})
        # a table of its own, so that both sides of the join are exchanges that adaptive execution can split
        first = F.min_by(F.struct(F.col("set").alias("hub"), F.col("n").alias("hub_n")), F.struct("alone", "set"))
        hubs = kept(rows.groupBy("shingle", "block").agg(first.alias("first")).select("shingle", "block", "first.*"), "hubs")
        pairs = rows.join(hubs, ["shingle", "block"]).withColumns({"a": F.least("set", "hub"), "b": F.greatest("set", "hub")})
        both = F.when(F.col("set") == F.col("hub"), F.col("n")).otherwise(F.col("both"))
        found = pairs.join(known.select("a", "b", "both"), ["a", "b"], "left").withColumn("both", both)
        return kept(found.select(*rows.columns, F.when(F.col("both").isNotNull(), F.col("hub")).alias("hub"), "hub_n", "both"), "answered")

    def side(rows: DataFrame, name: str, block: Column) -> DataFrame:
        columns = {"set": name, "n": f"{name}_n", "left": f"{name}_left", "root": f"{name}_root", "hub": f"{name}_hub", "both": f"{name}_both"}
        return rows.select("shingle", block, F.col("block").alias(f"{name}_block"), *([] if name == "y" else ["hub_n"]), *(F.col(c).alias(v) for c, v in columns.items()))

    apart = (F.col("x_root") != F.col("y_root")) & _fits(percent)
    leading = Window.partitionBy("shingle", "block").orderBy("alone", "set")
    within = Window.partitionBy("shingle", "block", "root").orderBy("alone", "set")
    lowest = _block(F.ceil(F.col("n") * percent / 100), percent)

    def with_leaders(rows: DataFrame, leaders: int) -> None:
        # a table of its own: the join's sides are exchanges then, and a long list can be split
        hubs = kept(side(rows.withColumn("rank", F.row_number().over(leading)).where(F.col("rank") <= leaders), "y", F.col("block")), "leaders")
        settle(side(rows, "x", _visited(percent, lowest)).join(hubs, ["shingle", "block"]).where(apart).withColumn("derived", _derived(percent)))

    # Leaders of a list's block: the sets with the fewest shingles of their own alone, which lie in the middle of their
    # family and lead in most of its lists. Every set of another component is compared with them: rows grow with the
    # list times a constant, and families fall together; most already in the lists of their sets' rarest shingles.
    with_leaders(answered(lists(prefixes.withColumn("root", F.col("set")), HEAD)), 1)
    reopen()
    with_leaders(answered(open_), LEADERS)
    # What is still apart: all pairs of different components, in growing numbers of each list and component, without
    # those that answers of a common leader settle.
    k = 0
    while True:
        reopen()
        most, rows, *pairs = _pairs(open_)
        if not most:
            break
        # as many as a round's pairs allow, and more than in the round before
        k = next((s for s, n in reversed(list(zip(STEPS, pairs, strict=True))) if s > k and n <= ALL_PAIRS * rows), min((s for s in STEPS if s > k), default=int(most)))
        top = answered(open_.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("rank"))
        one, two = side(top, "x", F.col("block")), side(top, "y", _visited(percent, F.col("block")))
        cross = one.join(two, ["shingle", "block"]).where(apart & ((F.col("x_block") != F.col("y_block")) | (F.col("x") < F.col("y"))))
        settle(cross.withColumn("derived", _derived(percent)).where("derived is null or derived"))
        if most <= k:  # all pairs of this round's components have an answer
            break
    for x in (*temporary, prefixes, open_, known):
        drop_stored(x)
    return roots.select(F.col("id").alias("set"), "root")


def _pairs(entries: DataFrame) -> tuple:
    """The most entries that a component has in a block of a list, all entries, and for each of STEPS the pairs of
    different components with at most so many entries of each."""
    each = entries.groupBy("shingle", "block", "root").agg(F.count("*").cast("double").alias("c"))
    some = [F.least("c", F.lit(float(s))) for s in STEPS]
    blocks = each.groupBy("shingle", "block").agg(F.max("c").alias("most"), F.sum("c").alias("rows"), *(F.sum(x).alias(f"one{i}") for i, x in enumerate(some)), *(F.sum(x * x).alias(f"own{i}") for i, x in enumerate(some)))
    return tuple(blocks.agg(F.max("most"), F.sum("rows"), *(F.sum(F.col(f"one{i}") * F.col(f"one{i}") - F.col(f"own{i}")) for i in range(len(STEPS)))).first())


def _settled(docs: DataFrame) -> DataFrame:
    """docs, stored unless their plan only scans, filters and projects: shuffled rows may come in another order again."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    scans = "FileScan" in plan or "BatchScan" in plan
    return docs if scans and not any(x in plan for x in ("Exchange", "Join", "Sample", "Aggregate", "Limit", "Python", "Arrow", "Pandas")) else stored(docs, "documents")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; component_id is the smallest id reachable by links.

    Null and empty texts and texts of white space have no shingles and link with nothing: their component is their own
    id. Ids that are null keep a null component unless they link to another row. Repeated rows are equal sets and
    linked. Other columns are not read; an empty table gives an empty table. A task that is repeated has to get its rows
    in the same order, so docs that don't come straight from files are stored first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = _settled(docs.select(id_col, text_col))
    rows = stored(document_sets(docs, width, id_col, text_col), "sets")
    if renamed := namesakes(rows):
        drop_stored(rows)
        rows = stored(document_sets(docs, width, id_col, text_col, renamed), "sets")
    buckets = 1 + (rows.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_SHINGLES
    index = stored(index_of(docs, percent, width, id_col, text_col, buckets, renamed, copied_sets(rows)), "index")
    roots = link_components(index, percent)
    drop_stored(index)
    sets = rows.where("n_shingles > 0").groupBy("set").agg(F.min("id").alias("least")).join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    # tables of their own: a component may hold much of all sets, and a set much of all rows, so joins have to be splittable
    sets = stored(sets, "components")
    least = stored(sets.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_set = sets.select("set", "root").join(least, "root").select("set", "component_id")
    named = rows.join(of_set, "set", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return named.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the smallest of its component. An id is a document: of rows that repeat one, one
    stays (any of them). Rows with a null id can't be told apart: they all stay unless their component has an id."""
    firsts = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("_first")).agg(F.count("*").alias("_rows"))
    repeated = firsts.where("_rows > 1 and _first is not null")
    same = docs[id_col].eqNullSafe(firsts["_first"])
    if not repeated.limit(1).count():
        return docs.join(firsts, same, "left_semi")
    single = docs.join(firsts.where("_rows = 1 or _first is null"), same, "left_semi")
    return single.union(docs.join(repeated, same, "left_semi").dropDuplicates([id_col]))
