"""Operator 11: archives written and read back."""
import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from sparkmem.llm import warc as W

SCHEMA = "page_id long, url string, html string"
ODD = [(7, "http://a/1", "same text"), (3, "http://a/2", "same text"), (None, "http://a/3", "same text"), (9, None, None), (4, "http://b/\r\nX: y", ""),
       (5, "http://c/", "Ünï\0code \r\n\r\n body"), (5, "http://c/", "Ünï\0code \r\n\r\n body"), (8, "http://d/", "x" * 3_000_000),
       (6, "http://e/", "x" * 3_000_000), (None, None, "only nulls"), (None, None, "only nulls"), (2, "", "WARC/1.1\r\n\r\n")]


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by a plain loop."""
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault(html or "", []).append((page_id is None, page_id or 0, url is None, url or ""))
    out = []
    for html, members in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for k, m in enumerate(sorted(members)):
            first = k == 0 or len(raw) < least
            low = sorted(members)[0]
            out.append((None if m[0] else m[1], len(raw), digest, "response" if first else "revisit", None if first or low[0] else low[1]))
    return sorted(out, key=str)


def result(spark, folder):
    rows = W.resolve_revisits(W.read_archives(spark, folder)).collect()
    assert all(r.intact for r in rows)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("least,archive_bytes", [(0, 64 << 20), (0, 4096), (10, 1 << 20)])
def test_round_trip(spark, tmp_path, least, archive_bytes):
    rows = ODD + [(100 + i, f"http://h{i % 7}/{i}", f"<html><body>page {i % 400} " + "common boilerplate of every page " * 9 + f"{i % 400}</body>") for i in range(700)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("payload", W.F.lit(1))
    W.write_archives(pages.repartition(5), str(tmp_path / "w"), least=least, archive_bytes=archive_bytes)
    assert result(spark, str(tmp_path / "w")) == expected(rows, least)
    back = W.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()
    stored = {bytes(r.payload).decode() for r in back}
    assert stored == {h or "" for _, _, h in rows}


def test_layout_is_frames_after_a_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" + "".join(f" shared words number {j % 50} and {i * j % 97}" for j in range(60))) for i in range(500)]
    W.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    (path,) = glob.glob(str(tmp_path / "w" / "*.warc.zst"))
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    raw = zstandard.ZstdDecompressor().decompress(data[8:8 + size]) if data[8:12] == struct.pack("<I", 0xFD2FB528) else data[8:8 + size]
    assert raw[:4] == struct.pack("<I", 0xEC30A437)                # a dictionary as the format defines it
    # the library's own reader agrees on what the frames hold, and the records need the dictionary
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).stream_reader(data[8 + size:], read_across_frames=True)
    assert reader.read() == b"".join(W.frames(data))
    plain = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(x)) for x in W.frames(data))
    assert len(data) - 8 - size < 0.6 * plain
    records = [W.parse_record(x) for x in W.frames(data)]
    assert records[0][0]["warc-type"] == "warcinfo" and len(records) == 501
    assert zstandard.get_frame_parameters(data[8 + size:8 + size + 18]).dict_id == zstandard.ZstdCompressionDict(raw).dict_id()


def test_record_at_a_time_and_damage(spark, tmp_path):
    record = W._page_record("2020-01-01T00:00:00Z", b"k", 1, "http://a/", 0, 5, hashlib.sha1(b"hello").digest(), b"hello", None, None)
    fields, block = W.parse_record(record)
    assert block.endswith(b"hello") and W._page_fields(record, True)[-1] is True
    assert W._page_fields(record.replace(b"hello", b"hellO"), True)[-1] is False
    with pytest.raises(ValueError):
        W.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert W.resolve_revisits(W.read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_copies_move_once_a_task(spark, tmp_path):
    """A payload that most rows hold is combined in the map tasks; its revisits carry no payload."""
    rows = [(i, f"http://h/{i}", "hot " * 2000 if i % 3 else f"page {i}") for i in range(300)]
    records = W.plan_records(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = records.collect()
    assert sum(r.html is not None for r in got) == 101 and len(got) == 300
