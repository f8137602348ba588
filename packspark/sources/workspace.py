"""Corpora: files below a folder, or tables of texts; manifests and repository statistics."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.settings import Settings

#: Suffixes that are scanned.
SCANNED = (
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".java",
    ".go", ".rs", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".kt",
    ".swift", ".scala", ".sql", ".json", ".toml", ".yaml", ".yml", ".md",
    ".txt", ".cfg", ".ini",
)
#: Fixed value: larger files aren't scanned.
MAX_FILE_BYTES = 512 * 1024
MANIFEST_VERSION = 1
MANIFEST_DDL = "workspace_root string, version int, built_at string, entries array<struct<rel_path: string, mtime_ns: bigint, size: bigint, line_count: int>>"


@dataclasses.dataclass(frozen=True)
class Corpus:
    """files: path, name, mtime (seconds), size (bytes), content, lines. Everything else derives
    from it; persist it, or write it to Parquet, once for many queries."""

    files: DataFrame

    @property
    def lines(self) -> DataFrame:
        """path, line_no (from 1), line, line_lower, total."""
        at = self.files.select("path", F.size("lines").alias("total"), F.posexplode("lines").alias("pos", "line"))
        return at.select("path", (F.col("pos") + 1).alias("line_no"), "line", F.lower("line").alias("line_lower"), "total")


def scannable(path: Column, size: Column, settings: Settings) -> Column:
    """Whether a relative path is scanned: known suffix (in any case), no ignored part, not too large."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    ignored = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in settings.ignore_globs]))
    return suffix.isin(*SCANNED) & ~ignored & (size <= MAX_FILE_BYTES)


def with_lines(files: DataFrame) -> DataFrame:
    """Add name and lines to (path, mtime, size, content), leaving out empty files."""
    full = files.filter(F.length("content") > 0)
    return full.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "mtime", "size", "content", T.split_lines("content").alias("lines"))


def listing(spark: SparkSession, settings: Settings) -> list[tuple[str, str, int, int]]:
    """(uri, relative path, mtime_ns, size) of all regular files below the workspace, without what is
    ignored. Names alone come to the driver, where Spark plans its own scans too; those would leave
    out names like __init__.py, which begin with an underscore."""
    root = settings.workspace_root.rstrip("/")
    scheme = urlparse(root).scheme
    if scheme in ("", "file"):
        top, out = Path(urlparse(root).path if scheme else root), []
        for folder, folders, names in os.walk(top):
            folders[:] = sorted(f for f in folders if f not in settings.ignore_globs)
            for name in sorted(names):
                at = Path(folder, name)
                try:
                    if at.is_file():
                        stat = at.stat()
                        out.append((str(at), at.relative_to(top).as_posix(), stat.st_mtime_ns, stat.st_size))
                except OSError:
                    continue
        return out
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    found, out = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        out.append((uri, uri.removeprefix(top.toString()).lstrip("/"), f.getModificationTime() * 1_000_000, f.getLen()))
    return out


def read_bytes(uri: str) -> bytes:
    """A file's bytes; empty if it can't be read."""
    try:
        if "://" not in uri:
            return Path(uri).read_bytes()
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            return f.read()
    except OSError:
        return b""


def scan(spark: SparkSession, settings: Settings) -> DataFrame:
    """path (relative), mtime, mtime_ns, size, content of all scannable files below the workspace, read
    by the executors; malformed UTF-8 is replaced, unreadable files are empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.iloc[k : k + 64]
                yield part.assign(content=[read_bytes(u).decode("utf-8", "replace") for u in part["uri"]])

    names = spark.createDataFrame(listing(spark, settings), "uri string, path string, mtime_ns long, size long")
    wanted = names.filter(scannable(F.col("path"), F.col("size"), settings)).repartition("path")
    read_ = wanted.mapInPandas(read, "uri string, path string, mtime_ns long, size long, content string")
    return read_.select("path", (F.col("mtime_ns") / 1e9).alias("mtime"), "mtime_ns", "size", "content")


def from_workspace(spark: SparkSession, settings: Settings) -> Corpus:
    return Corpus(with_lines(scan(spark, settings)))


def from_table(texts: DataFrame, path: Column, content: Column | str = "text", mtime: Column | None = None) -> Corpus:
    """A corpus from a table: each row is a file of that path."""
    body = F.coalesce(T.col(content), F.lit(""))
    time = F.lit(0.0) if mtime is None else mtime.cast("double")
    return Corpus(with_lines(texts.select(path.alias("path"), time.alias("mtime"), F.octet_length(body).cast("long").alias("size"), body.alias("content"))))


# -- manifests ---------------------------------------------------------------------------------


def manifest(files: DataFrame) -> DataFrame:
    """rel_path, mtime_ns, size, line_count of scanned files."""
    return files.select(F.col("path").alias("rel_path"), "mtime_ns", "size", T.newline_count("content").cast("int").alias("line_count"))


def save_manifest(entries: DataFrame, settings: Settings) -> str:
    """Write a manifest as one JSON document; returns its path."""
    one = entries.agg(F.sort_array(F.collect_list(F.struct("rel_path", "mtime_ns", "size", "line_count"))).alias("entries"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    doc = one.select(F.lit(settings.workspace_root).alias("workspace_root"), F.lit(MANIFEST_VERSION).alias("version"), now.alias("built_at"), "entries")
    doc.coalesce(1).write.mode("overwrite").json(settings.manifest_path)
    return settings.manifest_path


def load_manifest(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """The stored manifest as one row, or None if there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        doc = spark.read.schema(MANIFEST_DDL).option("mode", "DROPMALFORMED").option("multiLine", True).json(settings.manifest_path)
        return None if doc.isEmpty() else doc.withColumn("version", F.coalesce("version", F.lit(MANIFEST_VERSION)))
    except AnalysisException:
        return None


def entries_of(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("entries").alias("e")).select("e.rel_path", "e.mtime_ns", "e.size", F.coalesce("e.line_count", F.lit(0)).alias("line_count"))


def stale_entries(entries: DataFrame, files: DataFrame, detect_new: bool = False) -> DataFrame:
    """Entries whose file is missing or differs in time or size (reason); with detect_new also files
    that have no entry, which are not noticed otherwise."""
    now = files.select(F.col("path").alias("rel_path"), F.col("mtime_ns").alias("now_ns"), F.col("size").alias("now_size"))
    both = entries.join(now, "rel_path", "full" if detect_new else "left")
    reason = F.when(F.col("now_ns").isNull(), "missing").when(F.col("mtime_ns").isNull(), "new").when(F.col("mtime_ns") != F.col("now_ns"), "time").when(F.col("size") != F.col("now_size"), "size")
    return both.select("rel_path", reason.alias("reason")).filter("reason IS NOT NULL")


def current_manifest(spark: SparkSession, settings: Settings, rebuild: bool = False, detect_new: bool = False) -> DataFrame:
    """The stored manifest while it is fresh, else a new one, stored if manifest_auto_build is on."""
    files = scan(spark, settings)
    if settings.manifest_auto_build and not rebuild:
        doc = load_manifest(spark, settings)
        if doc is not None and doc.first()["workspace_root"] == settings.workspace_root and stale_entries(entries_of(doc), files, detect_new).isEmpty():
            return entries_of(doc)
    built = manifest(files)
    if settings.manifest_auto_build:
        save_manifest(built, settings)
    return built


def searchable(corpus: Corpus, entries: DataFrame) -> Corpus:
    """The corpus restricted to the files of a manifest."""
    return Corpus(corpus.files.join(entries.select(F.col("rel_path").alias("path")), "path", "left_semi"))


def repo_stats(files: DataFrame) -> DataFrame:
    """One row: file_count, total_lines, loc_log."""
    lines = F.coalesce(F.sum(T.newline_count("content")), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("file_count"), lines.cast("long").alias("total_lines")).withColumn("loc_log", F.log10(F.col("total_lines") + 1.0))


def manifest_stats(entries: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("line_count"), F.lit(0)).cast("long")
    return entries.agg(F.count(F.lit(1)).alias("file_count"), total.alias("total_lines")).withColumn("loc_log", F.log10(F.col("total_lines") + 1.0))
