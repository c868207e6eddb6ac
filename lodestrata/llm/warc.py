"""WARC archives, one Zstandard frame per record, with the dictionary in a leading skippable frame.

Layout of an archive: a skippable frame (magic 0x184D2A5D) with the dictionary, then for each record one frame that is
compressed with it. Spark's text writer writes them: a row is a whole archive, and the "line separator" after it is an
empty skippable frame, which decoders pass over, so archives lie on whatever file system Spark writes to. The reader
takes whole files, loads the dictionary, decodes frame by frame and validates headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stored, ship_package, stored
from .batches import pieces, texts

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50), which is also valid UTF-8.
SEPARATOR = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which an archive ends.
ARCHIVE_BYTES = 8_000_000
#: The dictionary's bytes, and how many of an archive's first payload bytes it is trained on.
DICT_BYTES, SAMPLE_BYTES = 16_384, 1_000_000
#: Fewer samples than this don't make a dictionary; the archive then has an empty one.
LEAST_SAMPLES = 16
#: Payloads below this many bytes never become revisits.
LEAST_REVISIT = 1000
#: Repeated payloads, 60 bytes each, that go to every task at most; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
RECORD_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodestrata:warc")


class WarcError(ValueError):
    """An archive or record that doesn't hold what its headers say."""


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, named fields, Content-Length, empty line, block, two line ends."""
    for name, value in fields:
        if "\r" in value or "\n" in value:
            raise WarcError(f"a line end in {name}")
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(number: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, number)}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, number: str) -> bytes:
    """The record of one page with a payload of ``size`` bytes: a response with its payload, or a revisit with HTTP
    headers alone. A record that others refer to is known by its page and digest, others by ``number``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    # percent-encoding keeps any url on one line
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(f"{page_id}/{digest}" if refers_to == page_id is not None else number)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Length", str(size))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(f"{refers_to}/{digest}")), ("X-Refers-To-Page", str(refers_to))]
    return record(fields, block)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's first payloads; empty where they are too few or too short to train on."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < LEAST_SAMPLES or sum(map(len, samples)) < 8 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # all samples alike
        return b""


class ArchiveWriter:
    """Builds one archive in memory."""

    def __init__(self, dictionary: bytes):
        self.parts = [struct.pack("<II", DICT_MAGIC, len(dictionary)), dictionary]
        self.size = 8 + len(dictionary)
        use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **use)

    def add(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.parts.append(frame)
        self.size += len(frame)

    def content(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: memoryview, at: int) -> int:
    """Where the compressed frame that begins at ``at`` ends, from its header and the headers of its blocks."""
    if len(data) < at + 6 or data[at : at + 4] != zstandard.FRAME_HEADER:
        raise WarcError("no frame where one should begin")
    said = data[at + 4]
    single = said >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[said & 3] + (single, 2, 4, 8)[said >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise WarcError("a frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(head & 1), head >> 1 & 3
        if kind == 3:
            raise WarcError("a block of an unknown kind")
        at += 3 + (1 if kind == 1 else head >> 3)  # a run-length block holds the byte that it repeats
    at += 4 * (said >> 2 & 1)
    if at > len(data):
        raise WarcError("a frame is cut short")
    return at


def read_frames(data: bytes) -> Iterator[bytes]:
    """Decoded records of an archive. Skippable frames after the first are passed over."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        raise WarcError("no leading dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise WarcError("the dictionary is cut short")
    dictionary = data[8 : 8 + size]
    if dictionary[:4] == zstandard.FRAME_HEADER:  # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decompressor, view, at = zstandard.ZstdDecompressor(**use), memoryview(data), 8 + size
    while at < len(view):
        if len(view) >= at + 8 and 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise WarcError("a skippable frame is cut short")
            continue
        end = frame_end(view, at)
        frame = decompressor.decompressobj()
        try:
            out = frame.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        if not frame.eof or frame.unused_data:
            raise WarcError("a frame is cut short")
        at = end
        yield out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record, after validating version, fields, lengths and digests."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise WarcError(f"no field: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block isn't as long as Content-Length says")
    block = rest[:-4]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("another block digest")
    return fields, block


def read_page(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record that page_record has made."""
    fields, block = parse(raw)
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise WarcError("no HTTP headers")
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("another payload than its headers say")
    if kind == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("warc-target-uri")
    url = url if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return number("x-page-id"), url, size, digest, kind, number("x-refers-to-page")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row of pages into archives under path.

    Of rows with equal payloads (html in UTF-8) of at least LEAST_REVISIT bytes those with the largest id are
    responses, the others revisit it. Null html is an empty payload; a row with a null id never is what others refer
    to, and a group of null ids alone is all responses; a null url has no target field; repeated rows are records of
    their own; other columns are not read; an empty table writes no archive.
    """
    ship_package(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    large = F.col("size") >= LEAST_REVISIT
    groups = rows.where(large).groupBy("digest").agg(F.max("id").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null")
    groups = stored(groups.select(F.col("digest").alias("key"), "latest"), "repeated")
    # Few repeated payloads go to every task, and pages aren't shuffled at all. Beyond that pages meet them by digest;
    # small ones need no answer and are spread, and a payload that very many pages have is a partition that adaptive
    # execution can split, as both sides are exchanges.
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("id", "url").cast("string"))))
    joined = rows.join(F.broadcast(groups) if few else groups.hint("merge"), "key", "left")
    revisit = large & F.col("latest").isNotNull() & ~F.col("id").eqNullSafe(F.col("latest"))
    sent = F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload"))  # a revisit is written without its payload
    marked = joined.select("id", "url", sent.alias("payload"), "size", "digest", "latest", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda w: pa.RecordBatch.from_arrays([pa.array([w.content()], pa.binary())], ["archive"])
        writer, count, task = None, 0, TaskContext.get().partitionId()
        for b in pieces(batches, "payload", SAMPLE_BYTES):
            payloads = b.column("payload").to_pylist()
            if writer is None:
                writer = ArchiveWriter(train([x for x in payloads if x]))
            for page_id, url, payload, *rest in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), payloads, *(b.column(c).to_pylist() for c in ("size", "digest", "latest", "revisit")), strict=True):
                count += 1
                writer.add(page_record(page_id, url, payload or b"", *rest, f"{page_id}/{task}/{count}"))
            if writer.size >= ARCHIVE_BYTES:
                yield done(writer)
                writer = None
        if writer is not None:
            yield done(writer)

    archives = marked.mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)
    drop_stored(groups)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) for each record under path; an archive that
    isn't valid raises WarcError. Files without a byte (of tasks without rows) hold no records."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                for raw in read_frames(content.as_py()):
                    rows.append(read_page(raw))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
