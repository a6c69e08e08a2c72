"""Operator 11, WARC archives compressed with a dictionary of their own.

``write_archives`` turns rows (page_id, url, html) into WARC/1.1 records and the records into ``.warc.zst`` files: a file begins
with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from all records of that file, then
every record is a frame of its own, so a reader can start at any record. ``read_archives`` reads such files.

Equal payloads (by SHA-256) are stored once: the row of the smallest page_id is the ``response``, every other row becomes a ``revisit``
that names it. Payloads meet in an aggregate that keeps one copy per task before anything is shuffled, so a payload that a third of
all rows hold moves once per task, and each payload moves once; rows without payload (the revisits) are narrow. A task fills one archive
after another from the rows it gets and holds one at a time.

Files are written by Spark's own text sink, a row a file, so its commit protocol decides what is kept when a task runs again, and any
file system that Spark reaches will do. The sink ends each row with a line feed; an archive therefore ends with the head of a skippable frame of
one byte, whose content that line feed is: every file stays a plain sequence of frames.

Nulls and odd input: a null html is an empty payload; a null url leaves ``WARC-Target-URI`` out, control characters in a url are
percent-encoded; null page_ids come after all others when the smallest is sought, and a null one is left out of the record. Rows repeated whole
are one response (if none smaller) and revisits of it. Payloads below ``least`` bytes are all responses. An archive of too few records to
build a dictionary from has none. An empty table writes no record. Extra columns are ignored. A payload longer than an
archive makes an archive of its own length; its dictionary is then built from evenly spaced pieces of TRAIN_BYTES in all.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_conf, lean, return_freed_memory, written

ARCHIVE_BYTES = 64 << 20   # of records after which an archive is closed, before compression
DICTIONARY_BYTES = 112_640
LEVEL = 6
PIECE = 128 << 10          # longest sample a dictionary is built from; longer records give several
TRAIN_BYTES = 256 << 20    # an archive above this (one very long record) is sampled evenly
# fixed values of the format: Zstandard frame magics, the one of a dictionary frame, and one of the other skippable frames
FRAME, DICTIONARY_FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                 "refers_to_record string, intact boolean")


# --------------------------------------------------------------------------
# Records
# --------------------------------------------------------------------------
def _digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _record_id(key: bytes, page_id: int | None, url: str | None, copy: int) -> str:
    name = b"\0".join([key, str(page_id).encode(), b"-" if url is None else b"+" + url.encode(), str(copy).encode()])
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _page_record(date: str, key: bytes, page_id, url, copy: int, size: int, sha1: bytes, html: bytes | None, first_id, first_url) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if html is None else http + html
    fields = [("WARC-Type", "revisit" if html is None else "response"), ("WARC-Record-ID", _record_id(key, page_id, url, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _uri(url)),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + _digest(sha1)),
              ("WARC-Block-Digest", "sha1:" + _digest(hashlib.sha1(block).digest())),
              ("X-Page-ID", None if page_id is None else str(page_id))]
    if html is None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(key, first_id, first_url, 0)),
                   ("WARC-Refers-To-Target-URI", None if first_url is None else _uri(first_url)), ("WARC-Refers-To-Date", date)]
    return _record(fields, block)


def _info_record(date: str, n: int) -> bytes:
    body = f"software: sparkmem\r\nformat: WARC File Format 1.1\r\nrecords: {n}\r\n".encode()
    name = hashlib.sha256(f"{date} {n}".encode()).digest()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], body)


# --------------------------------------------------------------------------
# Writing
# --------------------------------------------------------------------------
def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """Zstandard dictionary of the records, None where they are too few or too short for one."""
    pieces = [r[i:i + PIECE] for r in records for i in range(0, len(r), PIECE)]
    step = math.ceil(sum(map(len, pieces)) / TRAIN_BYTES)
    try:
        return zstandard.train_dictionary(size, pieces[::max(1, step)], k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def _archive(date: str, archive_bytes: int):
    """Archives of a task's rows, one row each: an archive is closed once its records hold ``archive_bytes``."""
    closing = struct.pack("<II", SKIPPABLE, 1)      # the sink's line feed is this frame's content

    def archive(records: list[bytes]) -> pa.RecordBatch:
        raw = build_dictionary(records)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=True, write_checksum=True, write_dict_id=True)
        out = bytearray()
        if raw is None:
            packer = zstandard.ZstdCompressor(compression_params=params)
        else:
            stored = min(zstandard.ZstdCompressor(level=19).compress(raw), raw, key=len)
            out += struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored
            shared = zstandard.ZstdCompressionDict(raw)
            shared.precompute_compress(level=LEVEL)
            packer = zstandard.ZstdCompressor(compression_params=params, dict_data=shared)
        out += packer.compress(_info_record(date, len(records)))
        records.reverse()
        while records:
            out += packer.compress(records.pop())
        out += closing
        return pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in cols.items()}
                records.append(_page_record(date, v["key"], v["page_id"], v["url"], v["copy"], v["size"], v["sha1"], v["html"],
                                            v["first_id"], v["first_url"]))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield archive(records)
                    records, held = [], 0
                    return_freed_memory()
        if records:
            yield archive(records)
        return_freed_memory()
    return run


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records to write: responses with html, revisits without, each of these with its first holder."""
    def smallest(*names):
        return F.min(F.struct(*[x for n in names for x in (F.col(n).isNull().alias(f"no_{n}"), F.col(n).alias(n))]))

    base = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
            .withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html").cast("long")))
    narrow = written(base.withColumn("sha1", F.unhex(F.sha1("html"))).drop("html")
                     .groupBy("key", "size", "sha1", "page_id", "url").agg(F.count("*").alias("rows")), "warc-rows")
    small = F.col("size") < least
    firsts = (narrow.where(~small).groupBy("key").agg(smallest("page_id", "url").alias("first"), F.sum("rows").alias("n"))
              .where("n > 1").select("key", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    again = narrow.join(firsts, "key").withColumn("is_first", F.expr("page_id <=> first_id AND url <=> first_url").cast("long"))
    again = (again.where("rows > is_first").withColumn("copy", F.explode(F.expr("sequence(is_first, rows - 1)")))
             .select("key", "page_id", "url", "copy", "size", "sha1", F.lit(None).cast("binary").alias("html"), "first_id", "first_url"))
    # one row per payload (below ``least``: per page); the aggregate keeps one copy of a payload per task before the shuffle
    once = (base.groupBy("key", F.when(small, F.struct("page_id", "url")).alias("own"))
            .agg(smallest("page_id", "url").alias("first"), F.first("html").alias("html"), F.first("size").alias("size"),
                 F.count("*").alias("rows"))
            .select("key", F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"),
                    F.explode(F.expr("sequence(0L, if(own IS NULL, 0L, rows - 1))")).alias("copy"), "size",
                    F.unhex(F.sha1("html")).alias("sha1"), "html",
                    F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url")))
    return once.unionByName(again)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages' records as archives ``*.warc.zst`` into ``folder`` (a path of any file system that Spark reaches)."""
    spark = pages.sparkSession
    arrow_conf(spark)
    (plan_records(pages, least).mapInArrow(_archive(date, archive_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
     .write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 1).text(folder))
    _name_archives(spark, folder)


def _name_archives(spark: SparkSession, folder: str) -> None:
    """Give the committed files their suffix: one rename a file; files without a record go."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            if status.getLen() == 0:
                fs.delete(status.getPath(), False)
            else:
                fs.rename(status.getPath(), status.getPath().suffix(".warc.zst"))


# --------------------------------------------------------------------------
# Reading
# --------------------------------------------------------------------------
def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends: its head and block heads are read, nothing is decompressed."""
    head = zstandard.get_frame_parameters(data[at:at + 18])
    at += zstandard.frame_header_size(data[at:at + 18])
    last = 0
    while not last:
        word = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        at += 3 + (1 if kind == 1 else size)        # a run-length block stores one byte
    return at + 4 * bool(head.has_checksum)


def frames(data) -> Iterator[bytes]:
    """The decompressed frames of an archive in order."""
    data = memoryview(data)
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic, size = struct.unpack("<II", data[at:at + 8])
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if magic == DICTIONARY_FRAME and at == 0:
                raw = bytes(data[8:8 + size])
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = frame_end(data, at)
        yield unpack.decompress(data[at:end])
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def _page_fields(raw: bytes, with_payload: bool):
    fields, block = parse_record(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    intact = fields["warc-block-digest"] == "sha1:" + _digest(hashlib.sha1(block).digest())
    if kind == "response":
        size, digest = len(payload), _digest(hashlib.sha1(payload).digest())
        intact &= digest == said
    else:
        size, digest = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1]), said
    page = fields.get("x-page-id")
    return (fields["warc-record-id"], kind, None if page is None else int(page), fields.get("warc-target-uri"),
            payload if with_payload and kind == "response" else None, size, digest, fields.get("warc-refers-to"), intact)


def _read(with_payload: bool):
    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found, held = [], 0
                for raw in frames(content.as_buffer()):
                    row = _page_fields(raw, with_payload)
                    if row:
                        found.append(row)
                        held += len(row[4] or b"")
                        if len(found) >= 4096 or held > 8 << 20:
                            yield rows(found)
                            found, held = [], 0
                if found:
                    yield rows(found)
    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per response and revisit of the archives; ``intact`` says whether digests hold, ``payload`` is null for revisits."""
    arrow_conf(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(lean(_read(with_payload)), RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records with ``refers_to``: the page_id of the response that a revisit names."""
    revisits = records.where("record_type = 'revisit'")
    responses = records.where("record_type = 'response'")
    target = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    keep = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "intact"]
    return (responses.select(*keep, F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits.join(target, "refers_to_record", "left").select(*keep, "refers_to")))
