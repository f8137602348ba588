"""WARC archives: a writer with revisit records and a splittable reader.

``write_warc`` gives every row a record, one gzip member each, in one file per task. Of rows with
equal payloads the one with the smallest id is the response; the others become revisit records
that refer to it and carry no payload. ``read_warc`` splits files into byte ranges, made on the
executors from the table of files. A task scans its range for the gzip magic, accepts a place as a
record only if a member decodes there to a WARC header, and owns the records that start inside its
range, however far they reach beyond it. Archives of other writers are read too: any record type,
record ids of any form (kept as ``record_id``; page_id and refers_to are null where an id isn't one of
ours), digests that are missing or of another kind, gzip headers of any length. A record that can't be
parsed or whose payload differs from its SHA-1 digest gives a row that says so in ``problem``.

Files go to a folder that all executors share. Each attempt of a task writes a file of its own, first
under another name and then renamed; only the files that the job returns are read, so attempts that
run twice or late disturb nothing. Bytes are written and read with Python's open for local and
mounted paths, else with pyarrow's file systems.

Null payloads count as empty; a null id is written as such, sorts last and refers to nothing of its
own; rows with the same id and payload are all responses if theirs is the smallest; a null url
becomes urn:unknown. Ranges without a record and empty tables give no rows. Very long payloads are
whole in memory, one record at a time. Columns other than the three named ones are not read,
whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm.common import join_facts, new_dir, stash, unused

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
CHUNK = 1 << 16
PREFIX = 16
MOST_TASKS = 100_000
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"  # archives of equal input are equal bytes
FILES_DDL = "file string, bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[object | None, str]:
    """(pyarrow file system or None for local, path)."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return None, unquote(urlparse(uri).path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_for_read(uri: str):
    fs, path = file_system(uri)
    return open(path, "rb") if fs is None else fs.open_input_file(path)


class Published:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        if self.fs is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.out = open(self.draft, "wb")
        else:
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.out = self.fs.open_output_stream(self.draft)

    def publish(self) -> int:
        size = self.out.tell()
        self.out.close()
        os.replace(self.draft, self.path) if self.fs is None else self.fs.move(self.draft, self.path)
        return size


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(page_id: int | None) -> str:
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~-._')}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(df: DataFrame, page_id: str, payload: str, least_bytes: int = LEAST_REVISIT_BYTES, out: str = "_first") -> DataFrame:
    """Add ``out``, the smallest id of the rows with the same payload (null where no other row has it).

    Payloads meet as digests; only those that repeat take part in the join, in which the rows of a
    frequent payload are dealt to several places.
    """
    (sha,) = unused(df, "_sha")
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keyed = df.select(F.col(page_id).alias("i"), F.sha2(raw, 256).alias(sha), F.length(raw).alias("n"))
    first = keyed.filter(F.col("n") >= least_bytes).groupBy(sha).agg(F.min("i").alias(out), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    return join_facts(df.withColumn(sha, F.sha2(raw, 256)), stash(first, "payloads"), [sha], "left").drop(sha)


def write_warc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> list[tuple[str, int]]:
    """Write all rows below path; (file, bytes) of each file, as written_files() has them."""
    return [(r["file"], r["bytes"]) for r in written_files(df, path, page_id, url, payload).collect()]


def written_files(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows below path; a stored table (file, bytes) with a row for each file."""
    rows = with_revisits(df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")), "page_id", "html")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        out, name = None, f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for i, u, h, first in batch.itertuples(index=False, name=None):
                out = out or Published(name)
                i, first = (None if pd.isna(x) else int(x) for x in (i, first))
                revisit = first is not None and first != i
                out.out.write(gzip_member(record(i, u, (h or "").encode("utf-8"), first, revisit)))
        if out:
            yield pd.DataFrame({"file": [name], "bytes": [out.publish()]})

    rows = rows.select(F.col("page_id").cast("decimal(20,0)").alias("i"), "url", "html", F.col("_first").cast("decimal(20,0)").alias("f"))
    return stash(rows.mapInPandas(write, FILES_DDL), "warc-files")


def member_prefix(f, offset: int) -> bytes:
    """The first bytes that a gzip member at offset decodes to, or b"" if none does; its header may
    be of any length."""
    z, found = zlib.decompressobj(31), b""
    f.seek(offset)
    while len(found) < PREFIX and not z.eof:
        chunk = f.read(4096)
        if not chunk:
            break
        try:
            found += z.decompress(chunk, PREFIX)
        except zlib.error:
            return b""
    return found


def member(f, offset: int) -> tuple[bytes, int] | None:
    """The whole decoded member at offset and the offset behind it."""
    z = zlib.decompressobj(31)
    f.seek(offset)
    parts, at = [], offset
    while not z.eof:
        chunk = f.read(CHUNK)
        if not chunk:
            return None
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        at += len(chunk)
    return b"".join(parts), at - len(z.unused_data)


def record_starts(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded member) of each record that starts in [start, end).

    After a record the search goes on behind it, so magic inside compressed data of a record that
    starts in the range is never tried; data of a record from before the range may hold it, which
    decoding and the WARC header then refuse.
    """
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += CHUNK if hit < 0 else end
            continue
        at += hit
        found = member(f, at) if member_prefix(f, at).startswith(b"WARC/1.") else None
        if found and found[0].startswith(b"WARC/1."):
            yield at, found[0]
            at = found[1]
        else:
            at += 1


def page_of(record_id: str | None) -> int | None:
    """The page that one of our record ids names; null for other ids."""
    found = re.fullmatch(r"<urn:x-page:(-?\d{1,19})>", record_id or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def parse_record(data: bytes) -> dict:
    """Type, ids, digest and payload of one WARC record, and what is wrong with it.

    The payload of an HTTP response is what follows its HTTP head, that of other records the block.
    A digest that isn't SHA-1 is kept with its label and not checked; a missing one is made.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    problem = None
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        problem, size = "no content length", str(max(0, len(rest) - 4))
    block = rest[: int(size)]
    if problem is None and len(block) < int(size):
        problem = "the block breaks off"
    kind = fields.get("warc-type", "")
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    else:
        http = b""
    length = len(payload)
    if kind == "revisit":  # the HTTP head tells how long the payload is that it doesn't carry
        said = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(said[0]) if said and re.fullmatch(rb"[0-9]{1,18}", said[0]) else None
    label, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    own = sha1_base32(payload)
    if label.lower() not in ("", "sha1"):
        digest = f"{label}:{digest}"
    elif not digest:
        digest = None if kind == "revisit" else own
    elif kind != "revisit" and problem is None and digest.upper() != own and digest.lower() != hashlib.sha1(payload).hexdigest():
        problem = f"the payload of {fields.get('warc-record-id')} differs from its digest"
    return {
        "record_id": fields.get("warc-record-id"), "page_id": page_of(fields.get("warc-record-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": digest, "refers_to": page_of(fields.get("warc-refers-to")) if kind == "revisit" else None, "payload": None if kind == "revisit" else payload, "problem": problem,
    }


RECORD_DDL = "file string, offset long, record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"


def read_warc(spark: SparkSession, files: DataFrame | list[tuple[str, int]], range_bytes: int = RANGE_BYTES, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the files, given with their sizes (file, bytes)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in RECORD_DDL.split(", "))])
        for batch in batches:
            for name, start, end in batch.to_pandas().itertuples(index=False, name=None):
                rows, held = [], 0
                with open_for_read(name) as f:
                    for offset, data in record_starts(f, start, end):
                        row = {"file": name, "offset": offset} | parse_record(data)
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    if isinstance(files, list):
        files = spark.createDataFrame(files, FILES_DDL)
    step = F.lit(int(range_bytes))
    starts = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    ranges = starts.select("file", "start", F.least(F.col("bytes"), F.col("start") + step).alias("end"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / step))).first()[0] or 0
    # A task reads one range, or, where there are very many, some one after another.
    return ranges.repartition(max(1, min(int(total), MOST_TASKS)), "file", "start").mapInArrow(read, RECORD_DDL)


def round_trip(df: DataFrame, name: str = "warc") -> DataFrame:
    """Write the rows to new archives in the shared folder and read the records back; a record that
    doesn't hold what was written ends the job."""
    spark = df.sparkSession
    found = read_warc(spark, written_files(df, new_dir(spark, name)), keep_payload=False)
    return found.withColumn("record_type", F.when(F.col("problem").isNotNull(), F.raise_error("problem")).otherwise(F.col("record_type")))
