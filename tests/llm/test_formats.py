"""Secrets, WARC and Matroska: plain versions, exact round trips, broken bytes."""

import base64
import collections
import gzip
import hashlib
import json
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from packspark.llm import matroska as M
from packspark.llm import secrets as S
from packspark.llm import warc as W


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def rsa_key(rnd):
    number = lambda n: der(2, b"\1" + rnd.randbytes(n - 1))
    return der(0x30, der(2, b"\0") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))


def b64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_structures():
    rnd = random.Random(1)
    key = rsa_key(rnd)
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1") + b"\5\0") + der(4, key))
    sec1 = der(0x30, der(2, b"\1") + der(4, rnd.randbytes(32)))
    field = lambda x: struct.pack(">I", len(x)) + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(rnd.randbytes(51)) + field(rnd.randbytes(136))
    token = ".".join([url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(b'{"sub":"1"}'), url64(rnd.randbytes(32))])
    kinds = lambda text: {k for _, _, k in S.scan(text)} - {"assign", "access", "hex"}
    assert S.der_key(key) == "pkcs1" and S.der_key(pkcs8) == "pkcs8" and S.der_key(sec1) == "sec1" and S.ssh_key(ssh)
    for data in (key, pkcs8, sec1):
        assert kinds(f"see {b64(data)} there") == {"der"}
        assert kinds(f"see {data.hex()} there") == {"der"}
        assert not kinds("x " + b64(data[:-1] + b"zz")) and not kinds("x " + b64(data[:-3]))
    assert kinds(b64(ssh)) == {"ssh"} and not kinds(b64(ssh[:-1]))
    assert kinds(f"bearer {token}.") == {"jwt"} and not kinds(token.replace("eyJ", "eyK", 1))
    lines = "\n".join(re.findall(".{1,64}", b64(pkcs8)))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    assert (0, len(pem), "pem") in S.scan(pem)
    assert "pem" not in kinds(pem.replace(lines, "\n".join(["QUJD" * 16] * 4)))
    assert not kinds("plain words " * 50 + "a" * 5000 + b64(rnd.randbytes(300)))


def plain_base(text):
    out = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_secret_rows(spark):
    rnd = random.Random(3)
    bits = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCD1234EFGH5678", "AKIAXY", "deadbeef" * 3, "abc", "0123456789abcdef", "é", "ſecret=abcdefgh", "toKen=abcdefg", "\n", "a.b-c_d", "xyz+/="]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", "password=" + "a" * 200_000, "f" * 100_000]
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(None, texts[0], "kept")], "doc_id long, text string, n_hex string")
    got = {r["doc_id"]: r for r in S.digest(S.with_secrets(frame)).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        count = collections.Counter(k for _, k, _ in base)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [count[k] for k in ("assign", "access", "hex")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(got[i]["spans"].split(","))
    assert S.with_secrets(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, offset string, payload string"


def plain_pages(rows):
    first = {}
    for i, _, h, _, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    count = collections.Counter((h or "") for _, _, h, _, _ in rows)
    out = collections.Counter()
    for i, _, h, _, _ in rows:
        raw, f = (h or "").encode(), first.get(h or "")
        again = count[h or ""] > 1 and f is not None and i != f
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None] += 1
    return out


@pytest.mark.parametrize("range_bytes", [37, 1000, W.RANGE_BYTES])
def test_warc_round_trip(spark, range_bytes):
    rnd = random.Random(4)
    pages = ["", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x" * 150_000, "".join(chr(rnd.randint(1, 0xD7FF)) for _ in range(40_000)), None]
    rows = [(i, rnd.choice(["http://a/ö?b=1 2", None, ""]), rnd.choice(pages) if i % 2 else f"page {i}", "a", "b") for i in range(40)]
    rows += [(None, "u", "page 3 only", "a", "b"), (None, None, pages[1], "a", "b"), rows[4], rows[5]]
    frame = spark.createDataFrame(rows, PAGES).repartition(3)
    path = W.new_dir(spark, "test-warc")
    files = W.write_warc(frame, path)
    size = sum(n for _, n in files)
    if range_bytes == 37 and size > 300_000:
        files = [f for f in files if f[1] < 60_000][:1] or files[:1]  # tiny ranges over one small file
        got = W.read_warc(spark, files, max(range_bytes, files[0][1] // 400)).count()
        assert got == sum(1 for _ in W.record_starts(W.open_for_read(files[0][0]), 0, files[0][1]))
        return
    got = W.read_warc(spark, files, range_bytes).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == plain_pages(rows)
    for r in got:
        if r["record_type"] == "response":
            assert r["payload"].decode() in {(h or "") for _, _, h, _, _ in rows}


def test_warc_is_gzip_and_ranges_own_once(tmp_path):
    records = [W.record(i, "http://x/", (b"\x1f\x8b\x08" + bytes([i])) * 50, None, False) for i in range(30)]
    data = b"".join(W.gzip_member(r) for r in records)
    name = str(tmp_path / "a.warc.gz")
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert gzip.decompress(data) == b"".join(records)
    for step in (1, 50, 333, len(data)):
        with W.open_for_read(name) as f:
            found = [x for a in range(0, len(data), step) for x in W.record_starts(f, a, min(len(data), a + step))]
        assert [x[1] for x in found] == records


def test_warc_empty(spark):
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1536, 1537, 12_288, 12_289, 5_000_000])
def test_matroska_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = M.pad(raw)
    assert len(payload) % 192 == 0 and len(payload) > 0 and payload.startswith(raw)
    data = M.mux(payload)
    x = M.demux(data)
    assert b"".join(data[a:b] for _, _, a, b, _, _, _ in x["packets"]) == payload
    times = [p[1] for p in x["packets"]]
    assert times == [8.0 * k for k in range(len(times))] and x["duration"] == len(payload) / 192
    assert [data[c : c + 4] for _, _, c in x["cues"]] == [M.element_id(M.CLUSTER)] * len(x["clusters"])


def test_matroska_parser():
    """Xiph lacing, block groups, unknown sizes and foreign elements, built by hand."""
    frames = [b"a" * 300, b"b" * 255, b"c" * 3]
    xiph = M.varint(2) + struct.pack(">hB", 5, 0x02) + bytes([2, 255, 45, 255, 0]) + b"".join(frames)
    plain = M.varint(2) + struct.pack(">hB", -1, 0x00) + b"zz"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, xiph) + M.uint(M.REFERENCE_BLOCK, 1))
    track = M.element(M.TRACK_ENTRY, M.uint(M.TRACK_NUMBER, 2) + M.uint(M.TRACK_TYPE, 1) + M.element(M.CODEC_ID, b"V_TEST"))
    unknown = lambda kind, body: M.element_id(kind) + b"\x01" + b"\xff" * 7 + body
    clusters = unknown(M.CLUSTER, M.uint(M.TIMESTAMP, 10) + group) + unknown(M.CLUSTER, M.uint(M.TIMESTAMP, 20) + M.element(0xEC, b"void") + M.element(M.SIMPLE_BLOCK, plain))
    data = M.element(M.EBML, M.uint(0x4286, 1)) + unknown(M.SEGMENT, M.element(M.TRACKS, track) + clusters)
    got = [(t, ms, data[a:b], key, lace, c) for t, ms, a, b, key, lace, c in M.demux(data)["packets"]]
    assert got == [(2, 15.0, frames[0], False, "xiph", 0), (2, 15.0, frames[1], False, "xiph", 0), (2, 15.0, frames[2], False, "xiph", 0), (2, 19.0, b"zz", False, "none", 1)]
    for cut in (1, 9, 30, len(data) - 1):
        with pytest.raises(M.Malformed):
            M.demux(data[:cut][:-1] if cut > 1 else b"")


def test_ebml_lacing():
    for sizes in ([5, 6, 7, 900, 1], [1, 70_000, 2], [64, 1, 64, 1]):
        frames = [bytes([i]) * n for i, n in enumerate(sizes)]
        lacing, body = M.laced(frames)
        block = M.varint(1) + struct.pack(">hB", 0, lacing << 1) + body
        _, _, _, ranges = M.frames_of(block, 0, len(block))
        assert [block[a:b] for a, b in ranges] == frames


def test_media_rows(spark):
    texts = [None, "", "é" * 96, "x" * 191, "plain", "plain", "long " * 200_000]
    frame = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "plain", "m")], "doc_id long, text string, media string")
    got = M.media_digest(frame).collect()
    assert len(got) == len(texts) + 1
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = M.pad(raw)
        assert (by[i]["n_bytes"], by[i]["payload_bytes"], by[i]["payload_sha256"], by[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (by[i]["media_bytes"], by[i]["media_sha256"]) == (len(M.mux(payload)), hashlib.sha256(M.mux(payload)).hexdigest())
    assert by[4]["feature"] == by[5]["feature"] == by[None]["feature"]
    stored = M.with_media(frame.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")), "raw")
    packets = M.packet_table(stored).filter("doc_id = 6").collect()
    assert sum(r["end"] - r["start"] for r in packets) == len(M.pad(texts[6].encode())) and {r["codec"] for r in packets} == {"A_PCM/INT/LIT"}
    broken = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None)], "doc_id long, media binary").select(M.packets_udf("media").alias("p")).select("p.*").collect()
    assert all(r["packets"] == [] and r["problem"] for r in broken)
    assert M.media_digest(frame.limit(0)).count() == 0
