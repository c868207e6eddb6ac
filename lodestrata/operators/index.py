"""The index: segments of records, postings, lengths, vectors and figures, and a table of dead records.

A segment is written once and never changed. New records become a segment of their own; records of older segments that
they replace, or that are removed, are listed as dead (tombstones). Readers see all segments without their dead rows, and
corpus figures are sums over segments less what is dead. When there are too many segments, or too much of them is dead,
some are merged without tokenizing or embedding anything again. Numbered pointer files name the current segments, and the
highest one counts, so readers never see half an index.

Postings are packed: a row holds all occurrences of a token in a shard, which is some records of together about
SHARD_TOKENS tokens. They lie in ranges of (token, shard) in small row groups, lengths in ranges of id, records dealt and
sorted by id, both with a bloom filter: a few tokens or ids, given as literals, reach the Parquet scan as pushed filters and skip the rest. Term
frequencies are sums of a shard's own postings.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.embedding import Embedder
from ..functions.records import search_text
from ..session import ship_package, spread

#: Columns of the keyword index and what an occurrence in each weighs.
WEIGHTS = {"title": 6.0, "recipient": 16.0, "keys": 8.0, "body": 1.0}


def index_fields(records: DataFrame, aliases: bool = True) -> DataFrame:
    """(id, title, recipient, keys, body): what the keyword index holds of each record; its number too, where it has one."""
    field = T.with_aliases if aliases else (lambda c: F.coalesce(c, F.lit("")))
    body = search_text(*(F.col(c) for c in ("title", "raw_text", "alias_text", "location", "entities")))
    return records.select("id", *_numbered(records), F.coalesce("title", F.lit("")).alias("title"), field(F.col("recipient")).alias("recipient"), field(F.col("key_fields")).alias("keys"), body.alias("body"))


def postings(fields: DataFrame, columns=tuple(WEIGHTS)) -> DataFrame:
    """(id, col, pos, tok) for each token of each column, in one pass over the fields."""
    return postings_of(tokenised(fields, columns)).drop("len")


def tokenised(fields: DataFrame, columns=tuple(WEIGHTS)) -> DataFrame:
    """(id, len, cols array<struct<col, toks>>): the tokens of each column and how many there are together."""
    per = F.array(*(F.struct(F.lit(c).alias("col"), T.index_tokens(F.col(c)).alias("toks")) for c in columns))
    length = F.aggregate("cols", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x["toks"]))
    own = ["id", *_numbered(fields)]
    return fields.select(*own, per.alias("cols")).select(*own, length.alias("len"), "cols")


def _numbered(df: DataFrame) -> list[str]:
    return [c for c in ("doc",) if c in df.columns]


def held_tokens(cut: DataFrame, tokens: list[str], positions: bool) -> DataFrame:
    """(id, len, found array<struct<col, pos, tok>>) of a table that tokenised() makes: where the given tokens stand,
    looked up by hash in each row's arrays, so that nothing else becomes a row. Without positions pos is null."""

    def of_column(x: Column) -> Column:
        wanted = lambda t: t.isin(tokens)
        if not positions:
            return F.transform(F.filter(x["toks"], wanted), lambda t: F.struct(x["col"].alias("col"), F.lit(None).cast("int").alias("pos"), t.alias("tok")))
        every = F.transform(x["toks"], lambda t, i: F.when(wanted(t), F.struct(x["col"].alias("col"), i.alias("pos"), t.alias("tok"))))
        return F.filter(every, lambda t: t.isNotNull())

    return cut.select("id", "len", F.flatten(F.transform("cols", of_column)).alias("found"))


def postings_of(cut: DataFrame) -> DataFrame:
    """postings() of a table that tokenised() has made, with each record's length, and number where it has one."""
    own = ["id", "len", *_numbered(cut)]
    return cut.select(*own, F.explode("cols").alias("x")).select(*own, "x.col", F.posexplode("x.toks").alias("pos", "tok"))


#: Tokens and records of a shard, about; a longer record is a shard of its own.
SHARD_TOKENS, SHARD_RECORDS = 2_000_000, 50_000
#: The row of a shard that names its records has this token, which no text holds: their lengths as held, their ids and docs.
RECORDS = ""
PACKED = "tok string, shard bigint, held array<bigint>, ids array<string>, docs array<bigint>"
#: Bits of an occurrence (held) below the record's place in its shard, and below the column's number in WEIGHTS.
PLACE, COLUMN = 40, 36


def packed_postings(cut: DataFrame) -> DataFrame:
    """PACKED: for each token and shard its occurrences in order, each one number made of the record's place in the shard,
    the column and the position. cut is a table that tokenised() makes, with numbers. A shard is named by its first
    record's number."""
    ship_package(cut.sparkSession)
    names = [x.split()[0] for x in PACKED.split(", ")]

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, docs, lens, cols = (t.column(c).combine_chunks() for c in ("id", "doc", "len", "cols"))
        docs, flat = docs.to_numpy(), cols.flatten()
        toks = flat.field("toks")
        each = np.diff(toks.offsets.to_numpy())
        row = np.repeat(np.repeat(np.arange(len(docs)), np.diff(cols.offsets.to_numpy())), each)
        col = np.repeat(pc.index_in(flat.field("col"), pa.array(list(WEIGHTS))).to_numpy().astype(np.int8), each)
        at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        words = toks.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(words.dictionary)))
        held = np.r_[lens.to_numpy(), ((row << PLACE) | (col.astype(np.int64) << COLUMN) | at)[order]]
        every = pa.concat_arrays([pa.array([RECORDS]), words.dictionary.cast(pa.string())])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, len(docs), len(docs) + ends].astype(np.int32)), pa.array(held))
        once = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.nulls(len(ends), pa.list_(values.type))])
        columns = [every, pa.array(np.full(len(every), docs[0])), lists, once(ids), once(pa.array(docs))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens = records = 0
        for b in batches:
            total, start = np.cumsum(b.column("len").to_numpy()), 0
            while start < b.num_rows:
                base = total[start - 1] if start else 0
                stop = int(np.searchsorted(total, base + SHARD_TOKENS - tokens, side="right"))
                stop = min(max(stop, start + (not held)), start + SHARD_RECORDS - records)
                if stop > start:
                    held.append(b.slice(start, stop - start))
                    tokens, records = tokens + int(total[stop - 1] - base), records + stop - start
                start = stop
                if start < b.num_rows:  # the shard is full
                    yield pack(held)
                    held, tokens, records = [], 0, 0
        if held:
            yield pack(held)

    return cut.select("id", "doc", "len", "cols").mapInArrow(run, PACKED)


def _without_dead(left: pa.Table, right: pa.Table) -> pa.Table:
    """PACKED rows of a shard without the records whose places aren't in right (place). Places stay what they are."""
    live, rows = right.column("place").to_numpy(), left.combine_chunks()
    if not len(live) or not len(rows):
        return rows.slice(0, 0)
    tok, held = rows.column("tok").to_pylist(), rows.column("held").combine_chunks()
    flat, own = held.flatten().to_numpy(), np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
    keep = np.isin(flat >> PLACE, live) | (own == tok.index(RECORDS))
    offsets = np.r_[0, np.cumsum(np.bincount(own[keep], minlength=len(held)))].astype(np.int32)
    out = rows.set_column(2, "held", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep])))
    return out.filter(pa.array(np.diff(offsets) > 0))


def weight_of(col: Column, weights: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for item in weights.items() for x in item))[col]


def term_frequencies(post: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, tok, f), with the record's length and number where post has them: weighted occurrences. Counts meet map-side
    before the shuffle."""
    return post.groupBy("id", "tok", *(c for c in ("len", "doc") if c in post.columns)).agg(F.sum(weight_of(F.col("col"), weights)).alias("f"))


def document_lengths(fields: DataFrame, columns=tuple(WEIGHTS)) -> DataFrame:
    """(id, len): tokens of all columns together; 0 for records without any."""
    return tokenised(fields, columns).select("id", "len")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """Both tables' rows, of each key the one with the highest order. max_by needs one pass and no sort."""
    return latest_of(old.unionByName(new), key, order)


def latest_of(rows: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """Of each key the row with the highest order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


#: More segments than this are merged, the smallest ones first, ``MERGE`` at a time.
MOST_SEGMENTS, MERGE = 8, 4
#: A segment with a larger share of dead records is merged.
MOST_DEAD = 0.3
#: Literals that one pushed filter holds at most; beyond that a join is used.
MOST_LITERALS = 400
#: Bytes of a row group, so that a filter on the sorted column has something to skip.
ROW_GROUP = 4 << 20
#: Bytes of a row group's bloom filter at most; 100,000 ids or so fill it.
BLOOM = 128 << 10
#: Dead rows that are broadcast at most, and figures that a pointer holds itself at most.
BROADCAST_DEAD, MOST_FIGURES = 100_000, 10_000
#: Bitmaps of 4 kB that are broadcast at most.
BROADCAST_BITMAPS = 10_000


class Conflict(RuntimeError):
    """Another writer has changed the index meanwhile."""


def one_of(column: str, values: list) -> Column:
    """column is one of a few values: equalities, each of which Parquet checks against its statistics and bloom filters
    (a long IN list becomes a range there)."""

    def tree(low: int, high: int) -> Column:
        return F.col(column) == F.lit(values[low]) if high - low == 1 else tree(low, (low + high) // 2) | tree((low + high) // 2, high)

    return tree(0, len(values)) if values else F.lit(False)


class Index:
    """An index folder ``root``."""

    TABLES = ("records", "postings", "lengths", "vectors", "figures", "bitmaps")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- pointers ----

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, the current one last."""
        fs, p = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for name in names if (m := re.fullmatch(r"current-(\d+)\.json", name)))

    def _pointer(self, number: int | None = None) -> dict | None:
        if number is None:
            numbers = self._pointers()
            if not numbers:
                return None
            number = numbers[-1]
        fs, p = self._fs(f"{self.root}/current-{number}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def meta(self) -> dict:
        found = self._pointer()
        if found is None:
            raise FileNotFoundError(f"no index under {self.root}")
        return found

    def exists(self) -> bool:
        return self._pointer() is not None

    def updated(self) -> float | None:
        """When the current pointer was written, in seconds since 1970."""
        if not (numbers := self._pointers()):
            return None
        fs, p = self._fs(f"{self.root}/current-{numbers[-1]}.json")
        return fs.getFileStatus(p).getModificationTime() / 1000

    def _point(self, meta: dict, after: int | None = None) -> None:
        """Writes the next pointer beside its place and renames it: at any time the highest one is whole. ``after`` is the
        pointer that this one builds on; another writer's pointer in between is a Conflict. Without it, of two writers at
        once the second one takes the number after the first one's. What the pointer before refers to stays for its
        readers; folders of older ones go, pointers first."""
        fs, tmp = self._fs(f"{self.root}/{uuid.uuid4().hex[:8]}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(meta, ensure_ascii=False).encode()))
        finally:
            out.close()
        numbers = self._pointers()
        number = numbers[-1] + 1 if numbers else 0
        if after is not None and number != after + 1:
            fs.delete(tmp, False)
            raise Conflict(f"{self.root} was changed meanwhile")
        while not fs.rename(tmp, self._fs(f"{self.root}/current-{number}.json")[1]):  # another writer has just taken it
            taken = self._pointers()
            if after is not None or number not in taken:
                fs.delete(tmp, False)
                raise Conflict(f"the pointer under {self.root} can't be written")
            number = taken[-1] + 1
        numbers = self._pointers()
        keep = {f for n in numbers[-2:] for f in _folders(self._pointer(n))}
        for n in numbers[:-2]:
            old = _folders(self._pointer(n))
            fs.delete(self._fs(f"{self.root}/current-{n}.json")[1], False)
            for folder in old - keep:
                fs.delete(self._fs(f"{self.root}/{folder}")[1], True)

    # ---- reading ----

    def _read(self, meta: dict, segment: str, name: str) -> DataFrame:
        schema = StructType.fromJson(meta["schemas"][name])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}")

    def _live(self, meta: dict, name: str, where: Column | None = None, segments: list[str] | None = None) -> DataFrame:
        """A table's rows over segments, without dead ones; ``where`` is applied to what each scan reads."""
        dead = {s["name"] for s in meta["segments"] if s["dead"]}
        parts: list[DataFrame] = []
        for segment in segments if segments is not None else [s["name"] for s in meta["segments"]]:
            rows = self._read(meta, segment, name)
            rows = rows if where is None else rows.where(where)
            if segment in dead:
                gone = self._dead(meta).where(F.col("segment") == segment).select("id")
                rows = rows.join(F.broadcast(gone) if meta["dead_rows"] <= BROADCAST_DEAD else gone, "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _dead(self, meta: dict) -> DataFrame:
        return self.spark.read.schema(DEAD).parquet(f"{self.root}/{meta['dead']}/ids")

    def table(self, name: str, where: Column | None = None) -> DataFrame:
        """records, postings, tf, lengths or vectors of the whole index, as of now."""
        meta = self.meta()
        if name in ("postings", "tf"):
            rows = self._occurrences(meta) if name == "postings" else self._frequencies(meta)
            return rows if where is None else rows.where(where)
        rows = self._live(meta, name, where)
        return rows.drop("doc", "rows") if name == "records" else rows.drop("shard", "place")

    def _packed(self, meta: dict) -> DataFrame:
        """PACKED of all segments, dead records too."""
        return reduce(DataFrame.unionByName, [self._read(meta, s["name"], "postings") for s in meta["segments"]])

    def _single(self, meta: dict) -> DataFrame:
        """(tok, shard, place, col, pos) of all segments, dead records too."""
        names, x = F.array(*map(F.lit, WEIGHTS)), F.col("x")
        rows = self._packed(meta).where(F.col("tok") != RECORDS).select("tok", "shard", F.explode("held").alias("x"))
        at = F.shiftright(x, COLUMN).bitwiseAND(F.lit((1 << (PLACE - COLUMN)) - 1)).cast("int")
        return rows.select("tok", "shard", F.shiftright(x, PLACE).alias("place"), F.get(names, at).alias("col"), x.bitwiseAND(F.lit((1 << COLUMN) - 1)).cast("int").alias("pos"))

    def _occurrences(self, meta: dict) -> DataFrame:
        return self._single(meta).join(self._live(meta, "lengths").select("shard", "place", "id"), ["shard", "place"]).select("id", "col", "pos", "tok")

    def _frequencies(self, meta: dict) -> DataFrame:
        f = self._single(meta).groupBy("tok", "shard", "place").agg(F.sum(weight_of(F.col("col"), WEIGHTS)).alias("f"))
        return f.join(self._live(meta, "lengths"), ["shard", "place"]).select("id", "tok", "len", "doc", "f")

    def shards(self, tokens: list[str], only: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """PACKED rows of the given tokens, and (shard, place, id, len, picked) of the records of all shards, without dead
        ones; those that ``only`` leaves are there once more, as picked."""
        meta = self.meta()
        wanted = one_of("tok", tokens) if len(tokens) <= MOST_LITERALS else F.col("tok").isin(tokens)
        lengths, own = self._live(meta, "lengths"), ("shard", "place", "id", "len")
        records = lengths.select(*own, F.lit(only is None).alias("picked"))
        if only is not None:
            records = records.unionByName(only(lengths).select(*own, F.lit(True).alias("picked")))
        return self._packed(meta).where(wanted).select("tok", "shard", "held"), records

    def count(self) -> int:
        return self.meta()["count"]

    def get(self, record_id: str) -> DataFrame:
        return self.table("records", F.col("id") == record_id)

    def lookup(self, ids: list[str], name: str = "records") -> DataFrame:
        """Rows of stated ids; up to MOST_LITERALS of them read only the row groups that may hold one."""
        ids = sorted(set(ids))
        if len(ids) <= MOST_LITERALS:
            return self.table(name, one_of("id", ids))
        return self.table(name).join(self.spark.createDataFrame([(x,) for x in ids], "id string"), "id", "left_semi")

    def of_tokens(self, name: str, tokens: list[str] | None) -> DataFrame:
        """postings or tf, of a few tokens only; None is all tokens."""
        return self.table(name, None if tokens is None else one_of("tok", tokens))

    def allowed(self, filters: Mapping | None) -> Callable[[DataFrame], DataFrame] | None:
        """A function that leaves the rows (with their record's number as doc) of records that pass all filters, as
        search.metadata_filter has them; None without filters. The records of each value of a filter's key are a bitmap
        (one row for each 32,768 numbers); those of a range are joined by OR, those of several keys by AND, and a row
        looks up its bit."""
        wanted = {k: v for k, v in (filters or {}).items() if k in FILTERABLE and v is not None}
        if not wanted:
            return None
        meta, parts = self.meta(), []
        for key, value in wanted.items():
            ranged = key == "date" and isinstance(value, (list, tuple)) and len(value) == 2
            held = F.col("value").between(*value) if ranged else F.col("value") == value
            own = reduce(DataFrame.unionByName, [self._read(meta, s["name"], "bitmaps").where((F.col("key") == key) & held) for s in meta["segments"]])
            parts.append(own.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        bits = reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")
        few = bits.limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS

        def left(rows: DataFrame) -> DataFrame:
            number, columns = F.col("doc") + 1, rows.columns
            at = F.bitmap_bit_position(number)
            byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.expr("shiftright(_byte, CAST(_at % 8 AS INT)) & 1")
            found = rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits) if few else bits, "bucket")
            return found.withColumns({"_byte": byte, "_at": at}).where(bit == 1).select(*columns)

        return left

    def figures(self) -> list[tuple[str, str, int]]:
        """(kind, value, n) over the whole index: stats() of the records, without reading them."""
        meta = self.meta()
        if meta["figures"] is not None:
            return [tuple(x) for x in meta["figures"]]
        return [tuple(r) for r in self._figures(meta).collect()]

    def _figures(self, meta: dict) -> DataFrame:
        parts = [self._read(meta, s["name"], "figures") for s in meta["segments"]]
        if meta["dead"]:
            parts.append(self.spark.read.schema(parts[0].schema).parquet(f"{self.root}/{meta['dead']}/figures"))
        return reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n > 0")

    # ---- writing ----

    def write(self, records: DataFrame, embedder: Embedder, append: bool = False, remove: Callable[[DataFrame], DataFrame] | None = None, files: DataFrame | None = None) -> dict:
        """Makes a segment of records and returns the index's figures; of one id the last record stays.

        Without append the segment is the whole index. With it, older records of the same ids are dead from then on, and
        so are those that ``remove`` picks from the records table. ``indexed`` counts the rows given, also repeated
        ones; ``count`` the records that the index then holds. files is a manifest that goes with this state.
        """
        number = self._pointers()[-1:]
        base = self._pointer(number[0]) if append and number else None
        if base and base["embedder"] != embedder.name:
            raise ValueError(f"the index holds vectors of {base['embedder']}, not {embedder.name}")
        first = base.get("next", 0) if base else 0
        segment, schemas = self._segment(records, embedder, first)
        meta = {"segments": [segment], "schemas": schemas, "dead": None, "dead_rows": 0, "embedder": embedder.name, "dim": embedder.dim, "indexed": segment.pop("given"), "next": max(first, segment.pop("next"))}
        if base:
            meta["segments"] = base["segments"] + meta["segments"]
            meta |= {"dead": base["dead"], "dead_rows": base["dead_rows"]}
            self._bury(meta, base, segment["name"], remove)
            self._merge(meta)
        if files is not None:
            meta["files"] = f"files-{uuid.uuid4().hex[:12]}"
            files.write.parquet(f"{self.root}/{meta['files']}")
        elif base:
            meta["files"] = base.get("files")
        meta["count"] = sum(s["count"] - s["dead"] for s in meta["segments"])
        length = sum(s["length"] - s["dead_length"] for s in meta["segments"])
        meta["avgdl"] = length / meta["count"] if meta["count"] else 0.0
        few = self._figures(meta).limit(MOST_FIGURES + 1).collect()
        meta["figures"] = [list(r) for r in few] if len(few) <= MOST_FIGURES else None
        self._point(meta, number[0] if base else None)
        return meta

    def remove(self, pick: Callable[[DataFrame], DataFrame], embedder: Embedder) -> dict:
        """Records that ``pick`` takes from the records table are dead from then on."""
        return self.write(self.table("records").limit(0), embedder, True, pick)

    def _sorted(self, rows: DataFrame, path: str, *by: str, bloom: str | None = None) -> None:
        writer = rows.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd")
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.max.bytes", BLOOM)
        writer.parquet(path)

    def _segment(self, records: DataFrame, embedder: Embedder, first: int) -> tuple[dict, dict]:
        """Writes a segment. Its records get numbers from ``first`` on, which no other record of the index ever has."""
        name = f"segment-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}"
        read = lambda table: self.spark.read.parquet(f"{path}/{table}")
        # rows of one id meet once; of each the last one is found, and all are sorted, where they lie
        dealt = records.withColumn("ordinal", F.monotonically_increasing_id()).repartition("id")
        latest = dealt.groupBy("id").agg(F.max_by(F.struct(*records.columns), "ordinal").alias("_r"), F.count("*").alias("rows")).select("_r.*", "rows")
        self._sorted(latest.sortWithinPartitions("id").withColumn("doc", F.monotonically_increasing_id() + first), f"{path}/records", bloom="id")
        kept = read("records")
        fields = index_fields(spread(kept))
        # the text of each record is cut once; lengths and sorted postings come from the packed ones
        packed_postings(tokenised(fields)).write.option("compression", "zstd").parquet(f"{path}/packed")
        packed = self.spark.read.schema(PACKED).parquet(f"{path}/packed")
        named = packed.where(F.col("tok") == RECORDS).select("shard", F.posexplode(F.arrays_zip("ids", "docs", "held")).alias("place", "x"))
        lengths = named.select(F.col("x.ids").alias("id"), F.col("x.docs").alias("doc"), F.col("x.held").alias("len"), "shard", F.col("place").cast("bigint").alias("place"))
        self._ranged(lengths, f"{path}/lengths", ["id"], bloom="id")
        self._ranged(packed, f"{path}/postings", ["tok", "shard"])
        embedder.embed(fields.select("id", "doc", "body"), "body").select("id", "doc", "vec").write.parquet(f"{path}/vectors")
        stats(kept).write.parquet(f"{path}/figures")
        self._sorted(bitmaps(kept).repartitionByRange("key", "value").sortWithinPartitions("key", "value", "bucket"), f"{path}/bitmaps")
        sums = read("lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        last, given = kept.agg(F.max("doc"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        schemas = {t: read(t).schema.jsonValue() for t in self.TABLES}
        out = {"name": name, "count": sums["n"], "length": sums["len"], "dead": 0, "dead_length": 0, "given": given, "next": first if last is None else ((last >> 33) + 1) << 33}
        self._drop(f"{name}/packed")
        return out, schemas

    def _ranged(self, rows: DataFrame, path: str, by: list[str], bloom: str | None = None) -> None:
        self._sorted(rows.repartitionByRange(*by).sortWithinPartitions(*by), path, bloom=bloom)

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/{folder}")
        fs.delete(p, True)

    def _bury(self, meta: dict, base: dict, new: str, remove: Callable[[DataFrame], DataFrame] | None) -> None:
        """Lists the dead of older segments: what was so before, ids of the new segment, and what is removed."""
        fresh = self._read(meta, new, "lengths").select("id")
        few = [r["id"] for r in fresh.limit(MOST_LITERALS + 1).collect()]
        parts = []
        for s in base["segments"]:
            where = one_of("id", few) if len(few) <= MOST_LITERALS else None
            rows = self._live(base, "lengths", where, [s["name"]])
            gone = rows if where is not None else rows.join(fresh, "id", "left_semi")
            if remove is not None:
                out = remove(self._live(base, "records", None, [s["name"]])).select("id").join(self._read(base, s["name"], "lengths"), "id")
                gone = gone.unionByName(out.select(*gone.columns)).distinct()
            parts.append(gone.select(F.lit(s["name"]).alias("segment"), "id", "len"))
        if base["dead"]:
            parts.append(self._dead(base))
        meta["dead"] = f"dead-{uuid.uuid4().hex[:12]}"
        reduce(DataFrame.unionByName, parts).write.parquet(f"{self.root}/{meta['dead']}/ids")
        self._count_dead(meta)

    def _count_dead(self, meta: dict) -> None:
        """The dead of each segment, and their figures as negative ones."""
        dead = self._dead(meta)
        sums = {r["segment"]: r for r in dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()}
        parts = []
        for s in meta["segments"]:
            own = sums.get(s["name"])
            s["dead"], s["dead_length"] = (own["n"], own["len"]) if own else (0, 0)
            if own:
                gone = dead.where(F.col("segment") == s["name"]).select("id")
                parts.append(self._read(meta, s["name"], "records").select("id", *STATS).join(gone, "id", "left_semi"))
        meta["dead_rows"] = sum(s["dead"] for s in meta["segments"])
        figures = StructType.fromJson(meta["schemas"]["figures"])
        none = self.spark.createDataFrame([], figures)
        counted = stats(reduce(DataFrame.unionByName, parts)).select("kind", "value", (-F.col("n")).alias("n")) if parts else none
        counted.write.parquet(f"{self.root}/{meta['dead']}/figures")

    def _merge(self, meta: dict) -> None:
        """Bounds the number of segments and the share of dead records: the smallest segments, and those with many dead
        records, become one. Their rows are copied, not made again."""
        empty = [s for s in meta["segments"] if s["count"] == s["dead"]]
        chosen = [s for s in meta["segments"] if s["dead"] > MOST_DEAD * s["count"] and s not in empty]
        rest = sorted((s for s in meta["segments"] if s not in chosen and s not in empty), key=lambda s: s["count"])
        if len(rest) + bool(chosen) > MOST_SEGMENTS:
            chosen += rest[:MERGE]
        if len(empty) == len(meta["segments"]):  # one stays: the index is empty but has its tables
            empty = empty[:-1]
        if not chosen and not empty:
            return
        names, made = [s["name"] for s in chosen], []
        if chosen:
            name = f"segment-{uuid.uuid4().hex[:12]}"
            path = f"{self.root}/{name}"
            for table in ("records", "lengths"):
                self._ranged(self._live(meta, table, None, names), f"{path}/{table}", ["id"], bloom="id")
            own = reduce(DataFrame.unionByName, [self._read(meta, n, "postings") for n in names])
            if any(s["dead"] for s in chosen):
                live = self.spark.read.parquet(f"{path}/lengths").select("shard", "place")
                ship_package(self.spark)
                own = own.groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(_without_dead, PACKED)
            self._ranged(own, f"{path}/postings", ["tok", "shard"])
            self._live(meta, "vectors", None, names).write.parquet(f"{path}/vectors")
            stats(self.spark.read.parquet(f"{path}/records")).write.parquet(f"{path}/figures")
            both = reduce(DataFrame.unionByName, [self._read(meta, n, "bitmaps") for n in names])
            both = both.groupBy("key", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            self._sorted(both.repartitionByRange("key", "value").sortWithinPartitions("key", "value", "bucket"), f"{path}/bitmaps")
            made = [{"name": name, "count": sum(s["count"] - s["dead"] for s in chosen), "length": sum(s["length"] - s["dead_length"] for s in chosen), "dead": 0, "dead_length": 0}]
        gone = {s["name"] for s in chosen + empty}
        meta["segments"] = [s for s in meta["segments"] if s["name"] not in gone] + made
        before = self._dead(meta)
        dead = f"dead-{uuid.uuid4().hex[:12]}"
        before.where(~F.col("segment").isin(*gone)).write.parquet(f"{self.root}/{dead}/ids")
        self._drop(meta["dead"])
        meta["dead"] = dead
        self._count_dead(meta)

    def files(self) -> DataFrame | None:
        """The manifest that the current state was built from."""
        meta = self._pointer()
        if not meta or not meta.get("files"):
            return None
        return self.spark.read.parquet(f"{self.root}/{meta['files']}")


def _folders(meta: dict) -> set[str]:
    """What a pointer refers to."""
    named = {meta.get("snapshot"), meta.get("dead"), meta.get("files")}
    return {x for x in named if x} | {s["name"] for s in meta.get("segments", ())}


DEAD = "segment string, id string, len bigint"
STATS = ("language", "category", "source_type", "department")
#: Keys that records can be filtered by.
FILTERABLE = ("date", "language", "department", "category", "source_type")


def bitmaps(records: DataFrame) -> DataFrame:
    """(key, value, bucket, bits): for each value of each key that records can be filtered by, the numbers (doc) of the
    records that have it, as bitmaps of 32,768 bits."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in FILTERABLE))
    rows = records.select((F.col("doc") + 1).alias("n"), F.explode(pairs).alias("x")).where("x.value IS NOT NULL")
    return rows.groupBy("x.key", "x.value", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def stats(records: DataFrame) -> DataFrame:
    """(kind, value, n): counts by language, category, source type and department (those that have one), in one pass."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in STATS))
    return records.select(F.explode(kinds).alias("x")).where("x.kind != 'department' or x.value is not null").groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


