"""Text units as column expressions: lines, tokens, keywords, path words, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where lines end, as Python's splitlines has it.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85" + "\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}]"
#: Blanks as Python's strip has them.
BLANK = r"(?U)[\s\x1C-\x1F]"
SOLID = r"(?U)[^\s\x1C-\x1F]"
EVIDENCE_CHARS = 220

#: Words that are no keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "of",
    "to", "in", "on", "at", "is", "are", "was", "were", "be", "been", "this",
    "that", "it", "with", "from", "by", "as", "we", "i", "you", "my", "our",
    "fix", "add", "make", "use", "using", "how", "does", "do", "what", "why",
    "when", "where", "should", "would", "could", "please", "can", "after",
    "before", "into", "out", "up", "down", "not", "no", "yes",
)
#: What keywords, the words of a path and the humps of camel case look like.
KEYWORD = r"[A-Za-z_][A-Za-z0-9_]{2,}"
PATH_WORD = r"[A-Za-z_][A-Za-z0-9_]{1,}"
HUMP = r"(?<=[a-z0-9])(?=[A-Z])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: Column | str) -> Column:
    """The lines of a text; a trailing break makes no empty line."""
    parts = F.split(col(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newline_count(text: Column | str) -> Column:
    """Newlines plus one, 0 for an empty text: the manifest's count, one above that of the lines of
    a text that ends in a newline."""
    t = col(text)
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)


def quarter(text: Column) -> Column:
    """A quarter of the characters, 1 at least, 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


class _Counter:
    """What counts tokens, and what it is called."""

    count: Callable[[Column], Column] = staticmethod(quarter)
    method = "chars/4"


def tokens(text: Column | str) -> Column:
    """Tokens of a text, by the counter in use."""
    return _Counter.count(col(text)).cast("int")


def token_method() -> str:
    return _Counter.method


def use_counter(count: Callable[[Column], Column] | None = None, method: str = "custom") -> None:
    """Count tokens by an expression of the text from now on, in budgets, packing and estimates alike;
    without one, by a quarter of the characters."""
    _Counter.count, _Counter.method = (staticmethod(quarter), "chars/4") if count is None else (staticmethod(count), method)


def encoder_counter(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A counter from an encoder: ``load`` makes it on each worker, once a task (a tokenizer's file is
    the caller's), and it tells how many tokens a text has."""
    import pandas as pd

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = load()
        for texts in batches:
            yield pd.Series([None if t is None else size(t) for t in texts], dtype="Int32")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(count, "int")(text)


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) as a text."""
    return F.array_join(F.slice(lines, start, F.greatest(F.lit(0), end - start + 1)), "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda, Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_by_lower(words: Column) -> Column:
    """Words without later ones that differ in case only, in order."""
    keep = lambda ws: lambda low: F.filter(ws, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return let(words, lambda ws: let(F.transform(ws, F.lower), keep(ws)))


def keywords(query: Column | str, extra: Column | None = None) -> Column:
    """Identifier-like words of three characters or more that are no stopwords, each followed by the
    parts of its camel case; without repeats."""
    raw = F.regexp_extract_all(col(query), F.lit(KEYWORD), F.lit(0))
    if extra is not None:
        raw = F.concat(raw, F.flatten(F.transform(extra, lambda t: F.regexp_extract_all(t, F.lit(KEYWORD), F.lit(0)))))
    plain = F.filter(raw, lambda w: ~F.lower(w).isin(*STOPWORDS))
    humps = lambda w: F.when(w.rlike("[a-z0-9][A-Z]"), F.filter(F.split(w, HUMP, -1), lambda p: F.length(p) >= 3)).otherwise(F.array().cast("array<string>"))
    return distinct_by_lower(F.flatten(F.transform(plain, lambda w: F.concat(F.array(w), humps(w)))))


def path_words(path: Column | str) -> Column:
    """The lower-cased words of a path without its last suffix."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]+$", "")), F.lit(PATH_WORD), F.lit(0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+$", "")


def evidence(content: Column | str, limit: int = EVIDENCE_CHARS) -> Column:
    """A text's solid lines, stripped, in one line; cut and dotted beyond the limit."""
    line = F.array_join(F.filter(F.transform(split_lines(content), strip), lambda x: x != ""), " ")
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(rstrip(F.substring(line, 1, limit - 3)), F.lit("...")))


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(lit(high), value))


def line_span(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.lit(0), col(end) - col(start) + 1)
