"""Media columns: byte payloads as Matroska files, and Matroska files as packet tables.

``mux`` stores a payload losslessly as one PCM track of unsigned 8-bit samples: EBML header,
segment with info, tracks, clusters of laced blocks, and cues. ``packets`` parses any Matroska
bytes: variable-length element ids and sizes (unknown sizes too), clusters, block groups and
simple blocks, Xiph, fixed-size and EBML lacing, cues. Both work on one value at a time, so
memory is bounded by the longest value of a batch, and nothing depends on other rows.

Null payloads count as empty and are padded like any other; bytes that are not Matroska, break off or
contradict themselves anywhere give no packets and the error in ``problem``, never an exception;
repeated rows give equal values; rows don't depend on each other, so ties and null ids don't matter;
very long values are handled whole, one at a time; an empty table gives an empty table. The result
column replaces a column of its name; ``packet_table`` and ``media_digest`` return their own columns
and those they are asked to keep.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import arrow_udf

#: Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Fixed values of op10's contract and of the stored form.
UNIT, PAD = 192, b" "
RATE = 192_000  # samples a second: a unit of 192 samples lasts one millisecond
FRAME = 8 * UNIT
LACE = 8
BLOCKS_PER_CLUSTER = 64


class Malformed(ValueError):
    """The bytes break off or don't follow EBML."""


def element_id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def varint(n: int, width: int = 0) -> bytes:
    """An EBML size: the shortest form, or one of the given width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return element_id(kind) + varint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and block body: fixed-size lacing for equal frames, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    if len({len(f) for f in frames}) == 1:
        return 2, bytes([len(frames) - 1]) + b"".join(frames)
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1]) + varint(sizes[0])
    for before, size in zip(sizes, sizes[1:-1], strict=False):
        delta = size - before
        width = next(w for w in range(1, 9) if abs(delta) < (1 << 7 * w - 1))
        head += varint(delta + (1 << 7 * width - 1) - 1, width)
    return 3, head + b"".join(frames)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload with spaces to a positive multiple of the unit."""
    return payload + PAD * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def mux(payload: bytes) -> bytes:
    """Matroska bytes that hold the payload, a multiple of UNIT, as 8-bit PCM of RATE."""
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
    track += uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
    track += element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"packspark") + element(WRITING_APP, b"packspark")
    info += element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    step = FRAME * LACE
    for c in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        start = c * 1000 // RATE
        blocks = [uint(TIMESTAMP, start)]
        for b in range(c, min(len(payload), c + step * BLOCKS_PER_CLUSTER), step):
            chunk = payload[b : b + step]
            lacing, body = laced([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)])
            head = varint(1) + struct.pack(">hB", b * 1000 // RATE - start, 0x80 | lacing << 1)
            blocks.append(element(SIMPLE_BLOCK, head + body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    versions = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8))
    head = b"".join(uint(k, v) for k, v in versions) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


def read_varint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value and following offset; None for the reserved all-ones size (unknown)."""
    if at >= end or data[at] == 0:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed(f"integer at {at} breaks off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n -= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, inside: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each child element's body; one of unknown size ends with its parent,
    an unknown-sized cluster before the next element of its own level."""
    while at < end:
        kind, at = read_varint(data, at, end, keep_marker=True)
        size, at = read_varint(data, at, end)
        if size is None:
            stop = end
            if kind == CLUSTER:
                stop, probe = end, at
                while probe < end:
                    k, body = read_varint(data, probe, end, keep_marker=True)
                    if k in (CLUSTER, CUES, TRACKS, INFO):
                        stop = probe
                        break
                    n, body = read_varint(data, body, end)
                    probe = body + (n or 0)
        else:
            stop = at + size
        if stop > end:
            raise Malformed(f"element {kind:x} at {at} passes its parent's end")
        yield kind, at, stop
        at = stop


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges of a block's frames."""
    track, at = read_varint(data, at, end)
    if track is None or at + 3 > end:
        raise Malformed(f"block at {at} breaks off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == 0:
        return track, relative, flags, [(at, end)]
    if at >= end:
        raise Malformed(f"laced block at {at} breaks off")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Malformed("fixed-size lacing does not divide its block")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Malformed(f"laced sizes at {at} break off")
            sizes.append(size + data[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        for i in range(n - 1):
            before = at
            value, at = read_varint(data, at, end)
            value = (1 << 7 * (at - before)) - 1 if value is None else value
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Malformed("laced sizes pass their block's end")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return track, relative, flags, out


def demux(data: bytes) -> dict:
    """Tracks, packets and cues of Matroska bytes.

    packets: (track, timestamp in ms, start, end, keyframe, lacing, cluster number).
    """
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": [], "duration": 0.0, "scale": 1_000_000}

    def number(a: int, b: int) -> int:
        if b - a > 8:
            raise Malformed(f"integer at {a} has {b - a} bytes")
        return int.from_bytes(data[a:b], "big")

    def real(a: int, b: int) -> float:
        if b - a not in (0, 4, 8):
            raise Malformed(f"float at {a} has {b - a} bytes")
        return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    for kind, start, end in top:
        if kind != SEGMENT:
            continue
        segment = start
        for k, a, b in elements(data, start, end):
            if k == INFO:
                for x, c, d in elements(data, a, b):
                    if x == TIMESTAMP_SCALE:
                        out["scale"] = number(c, d)
                    elif x == DURATION:
                        out["duration"] = real(c, d)
            elif k == TRACKS:
                for x, c, d in elements(data, a, b):
                    if x == TRACK_ENTRY:
                        track: dict = {"frame_ns": 0, "codec": "", "kind": 0, "number": 0}
                        for y, e, f in elements(data, c, d):
                            if y == TRACK_NUMBER:
                                track["number"] = number(e, f)
                            elif y == TRACK_TYPE:
                                track["kind"] = number(e, f)
                            elif y == CODEC_ID:
                                track["codec"] = data[e:f].decode("ascii", "replace")
                            elif y == DEFAULT_DURATION:
                                track["frame_ns"] = number(e, f)
                        out["tracks"][track["number"]] = track
            elif k == CLUSTER:
                out["clusters"].append(a)
                base = 0
                for x, c, d in elements(data, a, b):
                    if x == TIMESTAMP:
                        base = number(c, d)
                    elif x == SIMPLE_BLOCK:
                        add_packets(out, data, c, d, base, None)
                    elif x == BLOCK_GROUP:
                        inner = list(elements(data, c, d))
                        key = not any(y == REFERENCE_BLOCK for y, _, _ in inner)
                        for y, e, f in inner:
                            if y == BLOCK:
                                add_packets(out, data, e, f, base, key)
            elif k == CUES:
                for x, c, d in elements(data, a, b):
                    if x == CUE_POINT:
                        time, track_no, position = 0, 0, 0
                        for y, e, f in elements(data, c, d):
                            if y == CUE_TIME:
                                time = number(e, f)
                            elif y == CUE_TRACK_POSITIONS:
                                for z, g, h in elements(data, e, f):
                                    track_no = number(g, h) if z == CUE_TRACK else track_no
                                    position = number(g, h) if z == CUE_CLUSTER_POSITION else position
                        out["cues"].append((time, track_no, segment + position))
    return out


def add_packets(out: dict, data: bytes, start: int, end: int, base: int, key: bool | None) -> None:
    track, relative, flags, ranges = frames_of(data, start, end)
    step = out["tracks"].get(track, {}).get("frame_ns", 0) / 1e6
    keyframe = bool(flags & 0x80) if key is None else key
    for i, (a, b) in enumerate(ranges):
        ms = (base + relative) * out["scale"] / 1e6 + i * step
        out["packets"].append((track, ms, a, b, keyframe, LACINGS[flags >> 1 & 3], len(out["clusters"]) - 1))


PACKET_TYPE = "struct<track:long,timestamp_ms:double,start:long,end:long,keyframe:boolean,lacing:string,cluster:int,codec:string>"


@arrow_udf("binary")
def mux_udf(payloads: pd.Series) -> pd.Series:
    return pd.Series([mux(pad(bytes(p or b""))) for p in payloads], dtype=object)


@arrow_udf(f"struct<packets:array<{PACKET_TYPE}>,problem:string>")
def packets_udf(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        try:
            x = demux(bytes(m or b""))
            codec = {k: v["codec"] for k, v in x["tracks"].items()}
            rows.append(([(t, ms, a, b, key, lace, c, codec.get(t)) for t, ms, a, b, key, lace, c in x["packets"]], None))
        except Malformed as e:
            rows.append(([], str(e)))
    return pd.DataFrame(rows, columns=["packets", "problem"])


DIGEST_TYPE = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


@arrow_udf(DIGEST_TYPE)
def digest_udf(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes hold, read back through their packets."""
    rows = []
    for m in media:
        data = bytes(m)
        x = demux(data)
        payload = b"".join(data[a:b] for _, _, a, b, _, _, _ in x["packets"])
        lace = {k: 0 for k in LACINGS}
        for p in x["packets"]:
            lace[p[5]] += 1
        cued = sum(data.startswith(element_id(CLUSTER), at) for _, _, at in x["cues"])
        last = x["packets"][-1][1] if x["packets"] else 0.0
        feature = f"tracks={len(x['tracks'])};codec={x['tracks'][1]['codec']};clusters={len(x['clusters'])};cues={cued};packets={len(x['packets'])};fixed={lace['fixed']};ebml={lace['ebml']};unlaced={lace['none']};duration_ms={x['duration']:g};last_ms={last:g};mean={sum(payload) / len(payload):.4f}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def with_media(df: DataFrame, payload: Column | str, out: str = "media") -> DataFrame:
    """Add the column of Matroska bytes that store a binary column."""
    return df.withColumn(out, mux_udf(F.col(payload) if isinstance(payload, str) else payload))


def packet_table(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: track, timestamp, byte range in the media value, keyframe, lacing."""
    return df.select(*keep, F.explode(packets_udf(F.col(media))["packets"]).alias("_p")).select(*keep, "_p.*")


def media_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Store each text as media, read it back, and return the digests of both."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    stored = with_media(df.select("doc_id", raw.alias("_raw")), "_raw", "_media")
    return stored.select("doc_id", F.length("_raw").cast("long").alias("n_bytes"), digest_udf("_media").alias("_d")).select("doc_id", "n_bytes", "_d.*")
