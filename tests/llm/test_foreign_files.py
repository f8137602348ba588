"""WARC archives and Matroska files of other writers, and bytes that have been damaged."""

import base64
import hashlib
import io
import random
import struct
import zlib

import pytest

from packspark.llm import matroska as M
from packspark.llm import warc as W


def gzip_with(data, extra=b"", name=b""):
    """A gzip member whose header has an extra field and a file name."""
    flags = (4 if extra else 0) | (8 if name else 0)
    head = b"\x1f\x8b\x08" + bytes([flags]) + b"\0" * 6
    if extra:
        head += struct.pack("<H", len(extra)) + extra
    if name:
        head += name + b"\0"
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return head + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc(kind, block, content="", **fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]]
    head += [f"Content-Type: {content}"] * bool(content) + [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"


def archive():
    body = b"<p>one</p>"
    sha = hashlib.sha1(body).digest()
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    uuid = "<urn:uuid:6f1f2a52-0f5c-4c1a-9a55-2c46e0d1f1aa>"
    return [
        warc("warcinfo", b"software: x\r\n", "application/warc-fields", WARC_Record_ID=uuid),
        warc("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Record_ID=uuid),
        warc("response", http + body, HTTP, WARC_Record_ID=uuid, WARC_Payload_Digest="sha1:" + base64.b32encode(sha).decode()),
        warc("response", http + body, HTTP, WARC_Record_ID=uuid, WARC_Payload_Digest="SHA1:" + sha.hex()),
        warc("response", http + body, HTTP, WARC_Record_ID=uuid),
        warc("response", http + body, HTTP, WARC_Record_ID=uuid, WARC_Payload_Digest="md5:abc"),
        warc("response", http + body, HTTP, WARC_Record_ID=uuid, WARC_Payload_Digest="sha1:" + "A" * 32),
        warc("resource", body, "text/html"),
        warc("revisit", http, HTTP, WARC_Refers_To=uuid),
        warc("metadata", b""),
        b"WARC/1.1\r\nWARC-Type: conversion\r\nContent-Length: many\r\n\r\nabc\r\n\r\n",
        warc("response", http + body, HTTP, WARC_Record_ID="<urn:x-page:99999999999999999999>"),
    ]


@pytest.mark.parametrize("range_bytes", [1 << 20, 700])
def test_other_writers(spark, tmp_path, range_bytes):
    records = archive()
    data = b"".join(gzip_with(r, extra=b"x" * (5_000 * (i % 3)), name=b"n" * (9_000 * (i % 2))) for i, r in enumerate(records))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = sorted(W.read_warc(spark, [(str(tmp_path / "a.warc.gz"), len(data))], range_bytes).collect(), key=lambda r: r["offset"])
    assert [r["record_type"] for r in got] == ["warcinfo", "request", *["response"] * 5, "resource", "revisit", "metadata", "conversion", "response"]
    sha = base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode()
    assert [r["payload_digest"] for r in got[2:8]] == [sha, hashlib.sha1(b"<p>one</p>").hexdigest(), sha, "md5:abc", "A" * 32, sha]
    assert [bool(r["problem"]) for r in got] == [False] * 6 + [True] + [False] * 3 + [True, False]
    assert all(bytes(r["payload"]) == b"<p>one</p>" for r in got[2:8]) and got[0]["record_id"].startswith("<urn:uuid:")
    assert {r["page_id"] for r in got} == {None} and got[8]["payload"] is None and got[8]["payload_bytes"] is None


def test_damaged_archives_never_raise():
    rnd = random.Random(1)
    whole = b"".join(W.gzip_member(r) for r in archive())
    for _ in range(150):
        data = bytearray(whole[: rnd.randint(0, len(whole))])
        for _ in range(rnd.randint(0, 6)):
            if data:
                data[rnd.randrange(len(data))] = rnd.randrange(256)
        for _, record in W.record_starts(io.BytesIO(bytes(data)), 0, len(data)):
            W.parse_record(record)
    for r in archive():
        for _ in range(40):
            at = rnd.randrange(8, len(r))
            W.parse_record(r[:at] + rnd.randbytes(rnd.randint(0, 9)) + r[at:])
            W.parse_record(r[:at])


def block(flags, body):
    return M.element(M.EBML, M.uint(0x4286, 1)) + M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.SIMPLE_BLOCK, M.varint(1) + struct.pack(">hB", 0, flags) + body)))


@pytest.mark.parametrize(
    "data",
    [
        block(0x02, b""), block(0x04, b""), block(0x06, b""), block(0x02, b"\x03\xff\xff\xff"), block(0x06, b"\x02"), block(0x02, b"\x02\xff"),
        M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.INFO, M.element(M.DURATION, b"0123456789"))),
        M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"1" * 30))),
    ],
)
def test_broken_values_are_problems(data):
    with pytest.raises(M.Malformed):
        M.demux(data)


def test_damaged_media_never_raise(spark):
    rnd = random.Random(2)
    whole = [M.mux(M.pad(rnd.randbytes(n))) for n in (10, 3_000, 13_000)]
    track = M.element(M.TRACK_ENTRY, M.element(M.TRACK_NUMBER, b"\xff" * 8) + M.uint(M.DEFAULT_DURATION, 1 << 60))
    big = M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.TRACKS, track) + M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 8) + M.element(M.SIMPLE_BLOCK, M.varint(1 << 50) + b"\0\0\0x")))
    cases = [big, M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.INFO, M.element(M.DURATION, b"")))]
    for _ in range(400):
        data = bytearray(rnd.choice(whole))
        for _ in range(rnd.randint(1, 8)):
            at = rnd.randrange(min(len(data), rnd.choice([80, 400, len(data)])))
            data[at] = rnd.choice([0, 255, rnd.randrange(256)])
        cases.append(bytes(data[: rnd.randint(1, len(data))]) if rnd.random() < 0.3 else bytes(data))
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "doc_id long, media binary")
    got = frame.select("doc_id", M.packets_udf("media").alias("p")).select("doc_id", "p.*").collect()
    assert len(got) == len(cases)
    for r in got:
        assert r["problem"] is None or r["packets"] == []
        assert all(0 <= p["start"] <= p["end"] <= len(cases[r["doc_id"]]) for p in r["packets"])
    assert got[0]["packets"][0]["track"] == 1 << 50 and sum(r["problem"] is None for r in got) > 20
