"""Document quality by a byte-level convolutional network in numpy.

Filters over windows of WIDTH embedded bytes slide over overlapping chunks that cover the whole document; each filter
is max-pooled within a chunk; the mean and the maximum over the chunks are combined into one probability. Chunks
overlap by WIDTH - 1 bytes, so each window lies in exactly one of them. The network is trained on the driver, on a
bounded sample of labelled documents, and goes to the executors as a few kilobytes of weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .batches import back, for_arrow, pieces, schema_of, texts

WIDTH, EMBED, FILTERS, CHUNK = 8, 6, 24, 256
#: Windows that one matrix product takes at once.
BLOCK = 32_768
#: Labelled documents of each label that the network is fitted on, and chunks of each that one training pass sees.
SAMPLE, TRAIN_CHUNKS = 1200, 6
EPOCHS, BATCH, RATE, DECAY = 16, 32, 1e-2, 1e-4
KEEP_FROM = 0.3


class ByteConvNet:
    """weights: embed (256, EMBED), filters (WIDTH * EMBED, FILTERS), bias, mix (2 * FILTERS), offset."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteConvNet:
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        return cls({"embed": f32(r.normal(0, 0.5, (256, EMBED))), "filters": f32(r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS))), "bias": np.zeros(FILTERS, np.float32), "mix": f32(r.normal(0, 0.3, 2 * FILTERS)), "offset": np.zeros(1, np.float32)})

    def pooled(self, raw: np.ndarray, starts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Maximum of each filter over the windows of each chunk. raw: bytes, with WIDTH - 1 more at its end; a chunk
        goes from its start to the next one's. gaps: places, in order, at which no window of a document begins."""
        n = len(raw) - WIDTH + 1
        table = self.w["embed"]
        out = np.full((len(starts), FILTERS), -np.inf, np.float32)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            rows = table[raw[a : b + WIDTH - 1]].reshape(-1)
            windows = np.lib.stride_tricks.as_strided(rows, (b - a, WIDTH * EMBED), (EMBED * 4, 4))
            values = np.ascontiguousarray(windows) @ self.w["filters"]
            values[gaps[slice(*np.searchsorted(gaps, (a, b)))] - a] = -np.inf
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            cut = np.maximum(starts[first:last] - a, 0)
            np.maximum(out[first:last], np.maximum.reduceat(values, cut, axis=0), out=out[first:last])
        return np.maximum(out + self.w["bias"], 0)

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each document; an empty one is a single zero byte."""
        raw, starts, owner, gaps = joined(batch)
        hidden = self.pooled(raw, starts, gaps)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[first, len(owner)])
        mean = np.add.reduceat(hidden.astype(np.float64), first, axis=0) / count[:, None]
        top = np.maximum.reduceat(hidden, first, axis=0).astype(np.float64)
        z = mean @ self.w["mix"][:FILTERS].astype(np.float64) + top @ self.w["mix"][FILTERS:].astype(np.float64) + float(self.w["offset"][0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def joined(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents with WIDTH - 1 zeros after each, starts of their chunks, each chunk's document, and the
    places of the zeros: a document's score must not depend on the one behind it."""
    batch = [x or b"\0" for x in batch]
    gap = bytes(WIDTH - 1)
    raw = np.frombuffer(gap.join([*batch, b""]), np.uint8)
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + WIDTH - 1
    begin = np.cumsum(sizes) - sizes
    parts = -(-(sizes - WIDTH + 1) // CHUNK)
    owner = np.repeat(np.arange(len(batch)), parts)
    starts = begin[owner] + CHUNK * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    gaps = ((begin + sizes)[:, None] - np.arange(WIDTH - 1, 0, -1)).ravel()
    return raw, starts, owner, gaps


def training_chunks(text: bytes, seed: int = 7) -> list[bytes]:
    """The chunks of a document that training may see: all, or as many as its passes can show, drawn over the whole
    text. Each has WIDTH - 1 bytes of the next one too, so far as there are any."""
    text = text or b"\0"
    chunks = np.arange(-(-len(text) // CHUNK))
    if len(chunks) > EPOCHS * TRAIN_CHUNKS:
        chunks = np.sort(np.random.default_rng([seed, zlib.crc32(text)]).permutation(chunks)[: EPOCHS * TRAIN_CHUNKS])
    return [text[c * CHUNK : c * CHUNK + CHUNK + WIDTH - 1] for c in chunks.tolist()]


def fit(documents: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> ByteConvNet:
    """Adam on the weighted logistic loss, over the training_chunks of documents. In each pass a document shows at most
    TRAIN_CHUNKS of its chunks, other ones each time; scoring always takes them all."""
    net, r = ByteConvNet.fresh(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    t = 0
    raws = [np.frombuffer(b"".join(x.ljust(CHUNK + WIDTH - 1, b"\0") for x in d), np.uint8).reshape(len(d), -1) for d in documents]
    lengths = [np.array([min(CHUNK, len(x)) for x in d]) for d in documents]  # windows that begin in each chunk
    steps = EPOCHS * -(-len(documents) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(documents))
        for s in range(0, len(order), BATCH):
            own = order[s : s + BATCH]
            rows, owner, size = [], [], []
            for k, i in enumerate(own):
                for c in r.permutation(len(raws[i]))[:TRAIN_CHUNKS]:
                    rows.append(raws[i][c])
                    owner.append(k)
                    size.append(lengths[i][c])
            raw, owner, size = np.stack(rows), np.array(owner), np.array(size)
            e = net.w["embed"][raw]
            flat = np.lib.stride_tricks.as_strided(e, (len(rows), CHUNK, WIDTH * EMBED), (e.strides[0], EMBED * 4, 4))
            z = np.ascontiguousarray(flat).reshape(-1, WIDTH * EMBED) @ net.w["filters"]
            z = z.reshape(len(rows), CHUNK, FILTERS)
            if size.min() < CHUNK:
                z[np.arange(CHUNK)[None, :] >= size[:, None]] = -1e9
            at = z.argmax(1)
            best = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.w["bias"]
            hidden = np.maximum(best, 0)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            mean = np.add.reduceat(hidden, first, axis=0) / count[:, None]
            top = np.maximum.reduceat(hidden, first, axis=0)
            logit = mean @ net.w["mix"][:FILTERS] + top @ net.w["mix"][FILTERS:] + net.w["offset"]
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) * weights[own] / len(own)).astype(np.float32)
            g = {"mix": np.r_[err @ mean, err @ top] + DECAY * net.w["mix"], "offset": err.sum(keepdims=True)}
            dh = (err / count)[owner, None] * net.w["mix"][None, :FILTERS] + err[owner, None] * net.w["mix"][None, FILTERS:] * (hidden == top[owner])
            dh = np.where(best > 0, dh, 0).astype(np.float32)
            g["bias"] = dh.sum(0)
            # only the window that won has a gradient
            won = raw[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            seen = net.w["embed"][won].reshape(len(rows), FILTERS, WIDTH * EMBED)
            g["filters"] = np.einsum("cfk,cf->kf", seen, dh, optimize=True)
            back = (dh[:, :, None] * net.w["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(won.reshape(-1), back[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
            t += 1
            rate = RATE * (1 - 0.9 * t / steps)
            for k in net.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteConvNet:
    """Fits the network on at most ``sample`` documents of each label, those whose ids hash lowest, held-out ids never
    among them. Each label weighs as much as its share of all usable labels, so scores keep the labels' prior. Null
    ids or labels and ids with both labels teach nothing; of rows with the same id the least text counts. Without
    documents of both labels the network says the share of label 1 for all. The driver gets at most EPOCHS * TRAIN_CHUNKS
    chunks of CHUNK bytes for each sampled document (25 kB), however long its text is."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("id")))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):  # two top-k queries: no shuffle of all labels
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    ids = sorted({r["id"] for r in chosen.collect()})
    agreed = known.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    picked = {r["id"]: r["label"] for r in agreed.collect()} if ids else {}
    # one text for each id, however often the id occurs
    own = docs.where(F.col(id_col).isin(list(picked))).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(training_chunks, raw)), pa.list_(pa.binary()))], ["id", "chunks"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(draw, f"id {kind}, chunks array<binary>").collect() if picked else []
    rows.sort(key=lambda r: r["id"])
    net = ByteConvNet.fresh()
    y = np.array([picked[r["id"]] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        share = min(max(totals.get(1, 0) / max(1, sum(totals.values())), 0.01), 0.99) if totals else 0.5
        net.w["mix"][:] = 0
        net.w["offset"][0] = np.log(share / (1 - share))
        return net
    share = {k: totals[k] / sum(totals.values()) for k in (0, 1)}
    weight = np.where(y == 1, share[1] / (y == 1).mean(), share[0] / (y == 0).mean()).astype(np.float32)
    return fit([[bytes(x) for x in r["chunks"]] for r in rows], y, weight)


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for each row of docs; keep may name the text column. Null and empty texts are scored as one
    zero byte; null ids stay; repeated rows give repeated rows; other columns are not read; an empty table gives an
    empty table."""
    rows, names = for_arrow(docs, id_col, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            scores = net.scores([x.encode() for x in texts(b.column("_text"))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores)], [*names, "score"])

    return back(rows.mapInArrow(run, f"{schema_of(rows, names)}, score double"), id_col, text_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs, by a network that is trained on labels first.

    Null and empty texts are scored as one zero byte; null ids stay and aren't held out; equal texts have equal scores but for rounding
    and repeated rows stay; columns of other names are not read, whatever they are called; empty documents give an
    empty table, and with empty labels every score is 0.5."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def held_out(doc_id: int) -> bool:
    """is_held_out for one id, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
