"""Symbol spans of source files, and their lookup by name."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PYTHON = (".py", ".pyi")
#: Fixed value: what declares a symbol in languages with braces.
DECLARATION = re.compile(
    r"\b(?:export\s+)?(?:async\s+)?(?:function|class|func|fn)\s+([A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\("
    r"|([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{"
)
SYMBOL_DDL = "path string, ord int, name string, start_line int, end_line int"

Span = tuple[str, int, int]


def python_spans(source: str) -> list[Span]:
    """Functions and classes, outer ones first, from the first decorator on; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nodes = [n for n in ast.walk(tree) if isinstance(n, kinds)]
    return [(n.name, min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno or n.lineno) for n in nodes]


def brace_spans(lines: list[str]) -> list[Span]:
    """Declarations up to the line where their braces balance, or to the end of the file: the first
    line from the first brace on at whose end the depth is no greater than before the declaration."""
    before = [0]
    for x in lines:
        before.append(before[-1] + x.count("{") - x.count("}"))
    found = [(i, m) for i, x in enumerate(lines) if (m := DECLARATION.search(x))]
    # From the last line up, the places at which the depth is lower than anywhere before them, the
    # nearest last: where a declaration ends is found among them by bisection.
    out: list[Span] = []
    lower: list[int] = []
    opening, nearest = [0] * len(lines), len(lines)  # the first line from here on with a brace
    for i in range(len(lines) - 1, -1, -1):
        nearest = i if "{" in lines[i] else nearest
        opening[i] = nearest
    held: dict[int, list[int]] = {}
    for i, _ in found:
        held.setdefault(opening[i], []).append(i)
    ends: dict[int, int] = {}
    for s in range(len(lines) - 1, -1, -1):
        while lower and before[lower[-1]] >= before[s + 1]:
            lower.pop()
        lower.append(s + 1)
        for i in held.get(s, ()):
            low, high = 0, len(lower)  # depths rise towards the end of the list
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if before[lower[mid]] <= before[i] else (low, mid)
            ends[i] = lower[low - 1] if low else len(lines)
    for i, m in found:
        out.append((m[1] or m[2] or m[3], i + 1, min(ends.get(i, len(lines)), len(lines))))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """path, ord, name, start_line, end_line of every symbol of files (path, content, lines)."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, lines in batch.itertuples(index=False, name=None):
                spans = python_spans(content) if path.endswith(PYTHON) else brace_spans(list(lines))
                rows += [(path, k, *s) for k, s in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "start_line", "end_line"])

    return files.select("path", "content", "lines").mapInPandas(extract, SYMBOL_DDL)


def lookup(table: DataFrame, mentions: DataFrame) -> DataFrame:
    """For each (query_id, symbol) of mentions and each path: its first span of that name, else of
    that name in another case. Mentions may have a column path, which then must agree."""
    keyed = mentions.withColumn("_low", F.lower("symbol"))
    found = table.withColumn("_low", F.lower("name")).join(keyed, ["_low", *(["path"] if "path" in mentions.columns else [])])
    w = Window.partitionBy("query_id", "path", "symbol").orderBy(F.col("name") != F.col("symbol"), "ord")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "path", "symbol", "name", "start_line", "end_line")
