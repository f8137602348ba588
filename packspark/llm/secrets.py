"""Secret scans: pattern candidates, confirmed by the structure of what they decode to.

Base kinds (assign, access, hex) are patterns alone. The structural kinds decode a base64 or
hex run, or the segments of a token, and report it only if what comes out parses:

* jwt: three base64url segments, the first a JSON object with a string "alg", the second JSON.
* pem: BEGIN/END lines of a private key whose body decodes to a confirmed structure, or, behind
  Proc-Type and DEK-Info headers, to whole cipher blocks.
* der: a base64 or hex run, or base64 wrapped over lines, that ends with a DER key: PKCS#1, DSA,
  SEC1, PKCS#8 with a payload that parses as its algorithm wants, encrypted PKCS#8. Every nested
  length fills its parent exactly, at every level. The key may begin inside the run (path/MII...).
* ssh: a base64 run that ends with the openssh-key-v1 container, whose length-prefixed fields fit.

Spans are code points, end exclusive. Null text counts as empty and gives no span; very long
texts are scanned whole, in linear time; rows are independent, so ties, repeated rows and null
ids do not matter; an empty table gives an empty table; extra columns pass through ``with_secrets``
unless they are called like its result, which replaces them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import arrow_udf

#: The patterns and least lengths of the base kinds, in the order they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals [0-9a-f]+ and a length of 24
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*|ew[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"(?:[ \t]*[A-Za-z0-9+/]{40,120}\r?\n)+[ \t]*[A-Za-z0-9+/]+={0,2}")
HEX_ANY = re.compile(r"[0-9a-fA-F]{64,}")
CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s")
#: Base64 of the first bytes of a DER sequence (tag and length form) and of an SSH container.
KEY_START = re.compile(r"M(?=I[G-L]|[C-H][A-Za-z0-9+/_-])|b3BlbnNzaC1rZXktdjEA")

INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31
#: Object identifiers of private key algorithms, and of password-based encryption.
RSA = {"2a864886f70d010101", "2a864886f70d01010a"}
EC = "2a8648ce3d0201"
DSA, DH = "2a8648ce380401", "2a864886f70d010301"
EDWARDS = {"2b656e": 32, "2b656f": 56, "2b6570": 32, "2b6571": 57}
ENCRYPTION = ("2a864886f70d0105", "2a864886f70d010c01")


def unbase64(s: str) -> bytes | None:
    """Decode standard or URL-safe base64 with or without padding; None if it isn't that."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, or None."""
    items, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n = int.from_bytes(data[at : at + width], "big")
            if n < 128:  # DER wants the shortest form
                return None
            at += width
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def nests(data: bytes, start: int, end: int, depth: int = 16) -> bool:
    """Whether data[start:end] is DER values whose lengths fill their parents at every level."""
    items = der_items(data, start, end)
    return items is not None and depth > 0 and all(not tag & 0x20 or nests(data, a, b, depth - 1) for tag, a, b in items)


def naturals(data: bytes, items: list[tuple[int, int, int]]) -> list[int] | None:
    """The values of items if all are positive integers in their shortest form."""
    out = []
    for tag, a, b in items:
        if tag != INTEGER or a == b or data[a] & 0x80 or (b - a > 1 and data[a] == 0 and not data[a + 1] & 0x80):
            return None
        out.append(int.from_bytes(data[a:b], "big"))
    return out


def der_key(data: bytes) -> str | None:
    """The kind of private key that a DER encoding holds, if all of it parses as one."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE or not nests(data, 0, len(data)):
        return None
    parts = der_items(data, top[0][1], top[0][2]) or []
    tags = [p[0] for p in parts]
    if tags == [SEQUENCE, OCTETS]:
        return "encrypted" if encrypted(data, parts) else None
    version = naturals(data, parts[:1])
    if not version or version[0] > 1:
        return None
    if tags[:9] == [INTEGER] * 9 and tags[9:] in ([], [SEQUENCE] * version[0]):
        numbers = naturals(data, parts[1:9])
        return "pkcs1" if numbers and all(numbers) else None
    if tags == [INTEGER] * 6 and version == [0]:
        numbers = naturals(data, parts[1:])
        return "dsa" if numbers and numbers[0].bit_length() >= 512 and 128 <= numbers[1].bit_length() <= 512 and 0 < numbers[4] < numbers[1] else None
    if tags[1:2] == [OCTETS] and version == [1] and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        inner = {tag: [x[0] for x in der_items(data, a, b) or ()] for tag, a, b in parts[2:]}
        fits = inner.get(0xA0, [OID]) in ([OID], [SEQUENCE]) and inner.get(0xA1, [BITS]) == [BITS]
        return "sec1" if 16 <= parts[1][2] - parts[1][1] <= 72 and fits else None
    if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        algorithm = der_items(data, parts[1][1], parts[1][2]) or []
        if algorithm and algorithm[0][0] == OID and payload_fits(data[algorithm[0][1] : algorithm[0][2]].hex(), data[parts[2][1] : parts[2][2]]):
            return "pkcs8"
    return None


def payload_fits(oid: str, payload: bytes) -> bool:
    """Whether the payload of PKCS#8 is what its algorithm wants; of an unknown one, DER to its end."""
    items = der_items(payload, 0, len(payload))
    if not items or len(items) != 1:
        return False
    if oid in RSA:
        return der_key(payload) == "pkcs1"
    if oid == EC:
        return der_key(payload) == "sec1"
    if oid in (DSA, DH):
        return bool(naturals(payload, items))
    if oid in EDWARDS:
        return items[0][0] == OCTETS and items[0][2] - items[0][1] == EDWARDS[oid]
    return items[0][0] in (SEQUENCE, INTEGER, OCTETS) and nests(payload, 0, len(payload))


def encrypted(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """EncryptedPrivateKeyInfo: a password-based algorithm with parameters, then cipher blocks."""
    algorithm = der_items(data, parts[0][1], parts[0][2]) or []
    n = parts[1][2] - parts[1][1]
    return [x[0] for x in algorithm] == [OID, SEQUENCE] and data[algorithm[0][1] : algorithm[0][2]].hex().startswith(ENCRYPTION) and n >= 32 and n % 8 == 0


def der_size(head: bytes) -> int:
    """How many bytes the DER value that begins so has; 0 if that can't be told."""
    n = head[1] if len(head) > 1 else 0
    if n < 0x80:
        return 2 + n
    width = n & 0x7F
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big") if 1 <= width <= 4 and len(head) >= 2 + width else 0


def ssh_key(data: bytes) -> bool:
    """Whether data is an openssh-key-v1 container: names, options, key count, public and private block."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and at == len(data)


def json_object(segment: str) -> dict | None:
    raw = unbase64(segment)
    try:
        value = json.loads(raw.decode("utf-8")) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def structural_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in JWT.finditer(text):
        header = json_object(m[1])
        if header and isinstance(header.get("alg"), str) and json_object(m[2]) is not None:
            yield m.start(), m.end(), "jwt"
    pems: list[tuple[int, int]] = []
    for m in PEM.finditer(text):
        if pem_body(m[2]):
            pems.append((m.start(), m.end()))
            yield m.start(), m.end(), "pem"
    armoured = lambda at: any(a <= at < b for a, b in pems)
    for m in BASE64.finditer(text):
        found = key_in(m[0])
        if found and not armoured(m.start()):
            yield m.start() + found[0], m.end(), found[1]
    for m in WRAPPED.finditer(text):
        found = key_in(re.sub(r"\s+", "", m[0])) if not armoured(m.start()) else None
        if found:
            skipped = 0  # where the key begins, blanks counted
            for k, c in enumerate(m[0]):
                skipped += not c.isspace()
                if skipped > found[0]:
                    yield m.start() + k, m.end(), found[1]
                    break
    for m in HEX_ANY.finditer(text):
        run = m[0]
        for at in (x.start() for x in re.finditer("30", run)):
            if (len(run) - at) % 2 == 0 and 2 * der_size(bytes.fromhex(run[at : at + 12])) == len(run) - at and der_key(bytes.fromhex(run[at:])):
                yield m.start() + at, m.end(), "der"
                break


def pem_body(body: str) -> bool:
    """Whether what stands between the lines of a private key is one."""
    head, _, rest = body.replace("\r", "").lstrip("\n").partition("\n\n")
    if "Proc-Type:" in head:
        data = unbase64(re.sub(r"\s+", "", rest))
        return bool("ENCRYPTED" in head and CIPHER.search(head + "\n") and data and len(data) >= 32 and len(data) % 8 == 0)
    data = unbase64(re.sub(r"\s+", "", body))
    return bool(data and (der_key(data) or ssh_key(data)))


def key_in(run: str) -> tuple[int, str] | None:
    """Where in a base64 run a key begins that fills it to the end, and its kind.

    A DER value tells its size in its first bytes, so only beginnings from which it would end with
    the run are decoded: scanning stays linear.
    """
    body = run.rstrip("=")
    for m in KEY_START.finditer(body):
        at, n = m.start(), len(body) - m.start()
        if n % 4 == 1:
            continue
        if m[0] == "M":
            if der_size(unbase64(body[at : at + 8]) or b"") == n * 3 // 4 and (data := unbase64(body[at:])) and der_key(data):
                return at, "der"
        elif (data := unbase64(body[at:])) and ssh_key(data):
            return at, "ssh"
    return None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind as listed, then end."""
    text = text or ""
    found = base_spans(text)
    found += structural_spans(text)
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS_TYPE = "array<struct<start:int,end:int,kind:string>>"


@arrow_udf(SPANS_TYPE)
def spans_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in texts], dtype=object)


def with_secrets(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the array of secret spans (start, end, kind) of each whole text."""
    return df.withColumn(out, spans_udf(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    base = F.filter(F.col(spans), lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    )
