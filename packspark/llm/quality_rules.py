"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees on labelled documents give candidate rules: each path from a root is a
conjunction of thresholds on statistics. A lasso logistic regression on the rules, its penalty
chosen on a part of the sample that it isn't fitted on, keeps few of them, and those compile to one
Spark column expression: scoring is column arithmetic alone.

Fitting takes at most ``max_rows`` labelled rows, those with the smallest hash of their id, to the
driver, as numbers. Statistics cover whole texts. Null and empty texts have all statistics 0 and
get the score that the rules give for that. Without labelled rows of both classes the score is the
share of label 1 (0.5 without any). A document with several labels counts as 1 if their mean is at
least a half; null labels are ignored; of labelled documents with the same id the least text counts.
Equal texts get equal scores, and so do repeated rows; an empty table gives an empty table. Columns
other than doc_id, text and the score pass through, whatever they are called.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import unused
from packspark.llm.toxicity import labelled

MAX_ROWS = 20_000
TREES = 40
DEPTH = 3
RATE = 0.3
MAX_CUTS = 31
PENALTIES = (0.03, 0.01, 0.003, 0.001)

Condition = tuple[int, float, bool]  # statistic, threshold, whether it lies above
Rule = tuple[Condition, ...]


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; all 0 for an empty one."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("double")
    lines = F.split(text, "\n", -1)
    per = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "words": n,
        "word_length": per(chars, n),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n),
        "upper": per(count(r"\p{Lu}"), chars),
        "digits": per(count(r"\p{Nd}"), chars),
        "stops": per(count(r"[.,;:?]"), n),
        "marks": per(count(r"[^\p{L}\p{M}\p{Nd}\s.,;:?'\"()-]"), n),
        "bangs": per(count("!"), n),
        "loose_marks": per(count(r"(?<=\s)[^\p{L}\p{Nd}\s]+(?=\s)"), n),
        "words_a_line": per(n, F.size(lines).cast("double")),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
    }


NAMES = ("words", "word_length", "distinct_words", "upper", "digits", "stops", "marks", "bangs", "loose_marks", "words_a_line", "distinct_lines")


@dataclasses.dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]
    constant: float | None = None

    def describe(self) -> list[str]:
        """The rules as text, the heaviest first."""
        say = lambda c: f"{NAMES[c[0]]} {'>' if c[2] else '<='} {c[1]:g}"
        return [f"{w:+.3f} if {' and '.join(map(say, r))}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def grow(cuts: list[np.ndarray], codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grow a tree on codes (which cut interval each statistic lies in); collect its paths and,
    in out, the value of each row's leaf."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, -1, -1)
    if depth:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(codes[rows, f], gradient[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], hessian[rows], len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), f, k))
    if best[1] < 0:
        out[rows] = g / (h + 1)
        return
    _, f, k = best
    above = codes[rows, f] > k
    for part, up in ((rows[~above], False), (rows[above], True)):
        rule = (*path, (f, float(cuts[f][k]), up))
        rules.append(rule)
        grow(cuts, codes, gradient, hessian, part, depth - 1, rule, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All paths of boosted trees, each once, in the order in which they were found."""
    cuts = []
    for f in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, f], np.linspace(0, 1, MAX_CUTS + 2)[1:-1], method="inverted_cdf"))
        cuts.append(cut[cut < x[:, f].max()])
    codes = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)], 1)  # x <= cut[k] iff code <= k
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(cuts, codes, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, (), found, out)
        margin += RATE * out
    return list(dict.fromkeys(tuple(sorted(set(r))) for r in found))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) if up else (x[:, f] <= t) for f, t, up in rule])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, use: np.ndarray, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1 logistic regression on the rows in use, by accelerated proximal
    gradient; r is float32 and never copied."""
    n, k = int(use.sum()), r.shape[1]
    share = float(y[use].mean())
    b = float(np.log(share / (1 - share)))
    w, vw, vb, t = np.zeros(k), np.zeros(k), b, 1.0
    times = lambda v: (r @ v.astype(np.float32)).astype(np.float64)
    back = lambda e: (e.astype(np.float32) @ r).astype(np.float64)
    v = np.ones(k) / np.sqrt(k)
    top = 1.0
    for _ in range(15):
        v = back(np.where(use, times(v), 0.0)) / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * (top + 1))
    for _ in range(steps):
        e = np.where(use, 1 / (1 + np.exp(-np.clip(vb + times(vw), -500, 500))) - y, 0.0) / n
        nw = vw - step * back(e)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules and weights from statistics x (in the order of NAMES) and labels y."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0, [], float(y.mean()) if len(y) else 0.5)
    # Of rules that hold for the same rows the first stands for all.
    first: dict[bytes, Rule] = {}
    for rule in tree_rules(x, y):
        first.setdefault(hashlib.blake2b(np.packbits(holds(rule, x)).tobytes(), digest_size=16).digest(), rule)
    rules = list(first.values())
    if not rules:
        return Model(0.0, [], float(y.mean()))
    r = np.empty((len(y), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        r[:, k] = holds(rule, x)
    check, everyone = np.arange(len(y)) % 5 == 0, np.ones(len(y), bool)
    best = (np.inf, PENALTIES[0])
    if y[~check].min() != y[~check].max() and check.any():
        for penalty in PENALTIES:
            b, w = lasso(r, y, penalty, ~check)
            m = (b + r @ w.astype(np.float32))[check].astype(np.float64)
            best = min(best, (float(np.mean(np.logaddexp(0, m) - y[check] * m)), penalty))
    b, w = lasso(r, y, best[1], everyone)
    return Model(b, [(rules[k], float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-6)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    rows = labelled(docs, labels, label, max_rows)
    stats = statistics(F.col("text"))
    pdf = rows.select("y", *[stats[k].alias(k) for k in NAMES]).toPandas()  # max_rows bounds it
    return fit_arrays(pdf[list(NAMES)].to_numpy(float), pdf["y"].to_numpy(float))


def score_column(model: Model, stats: dict[str, Column]) -> Column:
    """The rules as one expression of the statistics' columns."""
    if model.constant is not None:
        return F.lit(model.constant)
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        hit = None
        for f, threshold, up in rule:
            c = stats[NAMES[f]] > F.lit(threshold) if up else stats[NAMES[f]] <= F.lit(threshold)
            hit = c if hit is None else hit & c
        total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is good (a column of that name is replaced)."""
    (held,) = unused(df, "_stats")
    stats = df.withColumn(held, F.struct(*[v.alias(k) for k, v in statistics(F.col(text)).items()]))
    return stats.withColumn(out, score_column(model, {k: F.col(f"{held}.{k}") for k in NAMES})).drop(held)
