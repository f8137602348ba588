"""Import edges between the files of a corpus, and hops along them."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.operators.symbols import PYTHON

#: Suffixes of scripts, in the order in which a bare import is completed.
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Fixed value: what imports a module in scripts.
SCRIPT_IMPORT = re.compile(r"""(?:import\s[^'"]*from\s*|import\s*|require\s*\(\s*)['"]([^'"]+)['"]""")
#: src, number of the import, preference among its targets, possible target
TARGET_DDL = "src string, ord int, prio int, dst string"


def _joined(folder: str, *parts: str) -> str:
    """A normal relative path; None-like '' if it leaves the corpus."""
    path = posixpath.normpath(posixpath.join(folder, *parts))
    return "" if path.startswith("..") or path == "." else path


def _other_suffix(path: str, suffix: str) -> str:
    head, name = posixpath.split(path)
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return posixpath.join(head, stem + suffix)


def python_targets(path: str, source: str) -> list[list[str]]:
    """For each import the files that it can mean, all of which count where they exist."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            modules = [(alias.name, 0) for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            modules = [(node.module or "", node.level or 0)]
        else:
            continue
        for module, level in modules:
            folder = posixpath.join(posixpath.dirname(path), *[".."] * (level - 1)) if level else ""
            target = posixpath.normpath(posixpath.join(folder, *module.split("."))) if module else posixpath.normpath(folder or ".")
            if target.startswith(".."):
                continue
            plain = [] if target == "." else [_other_suffix(target, ".py")]
            out += [[c] for c in [*plain, _joined(target, "__init__.py")]]
    return out


def script_targets(path: str, source: str) -> list[list[str]]:
    """For each local import the files that it can mean, the first existing one of which counts."""
    out = []
    for spec in SCRIPT_IMPORT.findall(source):
        base = _joined(posixpath.dirname(path), spec) if spec.startswith(".") else ""
        if base:
            out.append([base, *[_other_suffix(base, s) for s in SCRIPTS], *[f"{base}/index{s}" for s in SCRIPTS]])
    return out


def import_edges(files: DataFrame) -> DataFrame:
    """src, ord, dst: which files of the corpus each file imports, first mention first, no repeats."""

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                found = python_targets(path, content) if path.endswith(PYTHON) else script_targets(path, content) if path.endswith(SCRIPTS) else []
                rows += [(path, k, p, dst) for k, options in enumerate(found) for p, dst in enumerate(options)]
            yield pd.DataFrame(rows, columns=["src", "ord", "prio", "dst"])

    possible = files.select("path", "content").mapInPandas(targets, TARGET_DDL)
    real = possible.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    first = real.groupBy("src", "ord").agg(F.min_by("dst", "prio").alias("dst")).filter("src <> dst")
    once = first.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    return once.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("ord")) - 1).alias("ord"), "dst")


def neighbours(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, path) of what the files of sources (query_id, path) import."""
    return sources.select("query_id", F.col("path").alias("src")).join(edges, "src").select("query_id", F.col("dst").alias("path")).distinct()


def hops(sources: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, path, hop): files within k hops that aren't among the sources, at their least hop.

    Each hop's files are held, so that the next hop's plan reads them instead of repeating theirs.
    """
    seen = edge = sources.select("query_id", "path").distinct().withColumn("hop", F.lit(0))
    edges = edges.persist() if k > 1 else edges
    for hop in range(1, k + 1):
        edge = neighbours(edge, edges).join(seen, ["query_id", "path"], "left_anti").withColumn("hop", F.lit(hop))
        edge = edge.persist() if hop < k else edge
        seen = seen.unionByName(edge)
    return seen.filter("hop > 0")
