"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages become ``response`` records, or ``revisit`` records where an equal
payload of at least ``MIN_REVISIT`` bytes belongs to a smaller page_id. An archive
is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame
per record. Each archive is a row; Spark's text writer puts each row in a file of
its own, with an empty skippable frame as the line separator, so archives reach any
file system that Spark can write and survive lost executors by its commit protocol.

Reading: ``read_archives`` takes the dictionary from the leading frame, as it is or
compressed itself, decodes frame by frame, also frames that don't say how long their
content is, and validates headers, block lengths, payload lengths and digests. A
damaged frame or record raises ``ValueError``, and so does a dictionary that comes
after the first frame. Other skippable frames are passed over.

Defined results: null html is an empty payload; null url gives no target URI.
A null page_id is written and read as null; it is never referred to while a number
is there, and among rows of equal page_id and payload all have the same type.
An empty table gives no archive and no rows. Payloads are whole, of any length that
a row can hold; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame, all of its bytes ASCII: magic 0x184D2A50, length 0.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
#: Documented bound of the dictionary's training sample: pages, and bytes of the largest page among them.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 400, 32 << 10, 32 << 10
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record(kind: str, page_id, url, refers_to, size: int, digest: str, payload: bytes) -> bytes:
    """One WARC/1.1 record: headers, HTTP block, two line ends. A revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&*+,;=~')}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not m:
        raise ValueError(f"not a record id: {urn!r}")
    return int(m[1]) if m[1] else None


def parse_record(data: bytes) -> dict:
    """The fields of one record, after checks of its headers, lengths and digest."""
    try:
        return _parse(data)
    except (KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"a record without a header that it needs, or not in UTF-8: {e}") from e


def _parse(data: bytes) -> dict:
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("a record without a WARC/1.1 header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes; its header says {size}")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("a block without HTTP headers")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": None if url is None else unquote(url), "record_type": kind, "refers_to": _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Magic number and bytes of each frame (of a skippable one, its content), in order."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("an archive that ends inside a frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if end > len(data):
                raise ValueError("an archive that ends inside a skippable frame")
            yield magic, data[at + 8 : end]
        elif magic == 0xFD2FB528:
            end = _frame_end(data, at)
            yield magic, data[at:end]
        else:
            raise ValueError(f"not a frame: magic {magic:#x}")
        at = end


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    flags = data[at + 4]
    single, size_flag, checksum, dict_flag = flags >> 5 & 1, flags >> 6, flags >> 2 & 1, flags & 3
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[dict_flag] + ((1 if single else 0), 2, 4, 8)[size_flag]
    while True:
        if at + 3 > len(data):
            raise ValueError("an archive that ends inside a frame")
        header = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("an archive that ends inside a frame")
    return at


def records(data: memoryview) -> Iterator[dict]:
    """The records of one archive, in order."""
    decoder = zstandard.ZstdDecompressor()
    for i, (magic, frame) in enumerate(frames(data)):
        try:
            if magic == DICT_MAGIC:
                if i:
                    raise ValueError("a dictionary behind the first frame")
                plain = bytes(frame)
                if plain[:4] == zstandard.FRAME_HEADER:
                    plain = decoder.decompressobj().decompress(plain)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
            elif magic == 0xFD2FB528:
                content = decoder.decompressobj()
                record = content.decompress(frame)
                if not content.eof:
                    raise ValueError("a frame that ends early")
                yield parse_record(record)
        except zstandard.ZstdError as e:
            raise ValueError(f"a damaged frame: {e}") from e


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty where there are too few to train one."""
    fit = pages.where(F.octet_length("html").between(64, SAMPLE_BYTES))
    n = fit.count()
    # a hash below a threshold picks about SAMPLE_PAGES pages, the same ones on every run
    uniform = F.pmod(F.xxhash64(F.lit("warc"), "page_id", "html"), F.lit(1 << 20)) / float(1 << 20)
    payloads = [r.html.encode() for r in fit.where(uniform < SAMPLE_PAGES / max(n, 1)).select("html").toLocalIterator()]
    if len(payloads) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (page_id, url, html) below ``path``, a folder that need not exist."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # only copies are looked up: (page_id, digest) of those that revisit, without their payloads
    light = pages.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = light.join(first, "digest").where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    typed = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    dictionary = train_dictionary(pages.select("page_id", F.col("payload").cast("string").alias("html")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        held, size = [lead], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, refers_to, n, digest, payload = (batch.column(c)[i].as_py() for c in range(6))
                held.append(comp.compress(_record("response" if refers_to is None else "revisit", page_id, url, refers_to, n, digest, payload)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield row()
                    held, size = [lead], 0
        if size:
            yield row()

    size = pages.agg(F.sum("size")).first()[0] or 0
    # archives of a fair size, also where the shuffle has many small partitions
    typed = typed.coalesce(max(pages.sparkSession.sparkContext.defaultParallelism, size // archive_bytes + 1))
    archives = typed.select("page_id", "url", "refers_to", "size", "digest", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")).mapInArrow(pack, "value binary")
    archives.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits) of every record below ``path``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for record in records(memoryview(batch.column(0)[i].as_buffer()).cast("B")):
                    rows.append(record)
                    size += len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, RECORD_SCHEMA)


def op2_warc_zstd(spark, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""
