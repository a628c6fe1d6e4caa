"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on bootstrap samples of labelled rows; every path from a root becomes a
conjunctive rule over the statistics. A logistic model with a lasso penalty weights the rules,
most weights become zero, and the rest are compiled to a Spark column expression, so scoring is
one projection in the JVM over all rows.

Only the fit looks at a sample: at most MAX_LABELLED labelled rows, those with the lowest hash of
their ids, so that the same rows are taken at any partitioning; and each tree at most BOOTSTRAP_ROWS
of those, drawn with replacement. Both bounds are parameters.

Defined cases: a null text is the empty text and is scored as such; rows without a label, or with a
null one, are not learned from; without labelled rows of both kinds the score is their share of ones
(0.5 if there are none); repeated rows are scored each; an id with several labels, or several texts,
is learned from once for each pair of them, within the bound; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.quality_rules import let, occurrences, words_of

MAX_LABELLED, BOOTSTRAP_ROWS = 20_000, 4_000
TREES, DEPTH, LEAST_LEAF = 24, 3, 5
PENALTY = 2e-3

STATISTICS = ("log_words", "mean_word", "symbol_rate", "bar_rate", "shout_rate", "capital_share", "distinct_share", "digit_share", "stop_rate", "line_words", "dup_line_share", "long_word_share")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS (doubles) of a text that is not null."""

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")), F.lit(1)).cast("double")
        lines = F.filter(F.split(text, "\n"), lambda l: F.trim(l) != "")
        values = {
            "log_words": F.log1p(F.size(w).cast("double")),
            "mean_word": chars / n,
            "symbol_rate": occurrences(text, "#*$%&<>") / n,
            "bar_rate": occurrences(text, "|") / n,
            "shout_rate": occurrences(text, "!") / n,
            "capital_share": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
            "distinct_share": F.size(F.array_distinct(w)) / F.sqrt(n),
            "digit_share": occurrences(text, "0123456789") / chars,
            "stop_rate": occurrences(text, ".?") / n,
            "line_words": let(lines, lambda ls: n / F.greatest(F.size(ls), F.lit(1))),
            "dup_line_share": let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))) / F.greatest(F.size(ls), F.lit(1))),
            "long_word_share": F.size(F.filter(w, lambda x: F.length(x) > 20)) / n,
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])

    return let(words_of(text), of)


Condition = tuple[int, bool, float]  # statistic, is it at most, threshold


@dataclass(frozen=True)
class Rules:
    """Weighted rules; score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, low, at in conditions:
                value = stats[STATISTICS[k]]
                holds = holds & ((value <= at) if low else (value > at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            total += weight * holding(x, conditions)
        return 1 / (1 + np.exp(-total))


def holding(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, low, at in conditions:
        out &= (x[:, k] <= at) if low else (x[:, k] > at)
    return out


def best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(gain, statistic, threshold) of the split with the least Gini impurity."""
    n, best = len(y), None
    parent = y.mean() * (1 - y.mean())
    for k in columns:
        order = np.argsort(x[:, k], kind="stable")
        v, ones = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[:-1] < v[1:]) + 1
        at = at[(at >= least) & (at <= n - least)]
        if not len(at):
            continue
        left, right = ones[at - 1], ones[-1] - ones[at - 1]
        p, q = left / at, right / (n - at)
        gain = parent - (at * p * (1 - p) + (n - at) * q * (1 - q)) / n
        j = int(np.argmax(gain))
        if gain[j] > 1e-9 and (best is None or gain[j] > best[0] + 1e-12):
            best = (float(gain[j]), int(k), float((v[at[j] - 1] + v[at[j]]) / 2))
    return best


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> list[tuple[Condition, ...]]:
    """Conditions from the root to each node of a tree that looks at a random half of the statistics at each split."""
    out: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            out.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        columns = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        split = best_split(x[rows], y[rows], columns, least)
        if split:
            _, k, at = split
            low = x[rows, k] <= at
            grow(rows[low], (*path, (k, True, at)))
            grow(rows[~low], (*path, (k, False, at)))

    grow(np.arange(len(y)), ())
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise log loss + penalty * |weights|, by accelerated proximal steps."""
    n, d = z.shape
    rate = 4.0 * n / (np.linalg.norm(z, 2) ** 2 + n)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(p / (1 - p))), np.zeros(d)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(vb + z @ vw))) - y
        nb, step = vb - rate * error.mean(), vw - rate * (z.T @ error) / n
        nw = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, penalty: float = PENALTY, bootstrap: int = BOOTSTRAP_ROWS, seed: int = 7) -> Rules:
    """Fit on rows of statistics and labels 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return Rules(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(seed)
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), bootstrap))
        for path in tree_paths(x[rows], y[rows].astype(float), rng, depth, least):
            paths.setdefault(path)
    # Rules that hold for the same rows are one rule; the shortest stays.
    by_rows: dict[bytes, tuple[tuple[Condition, ...], np.ndarray]] = {}
    for path in sorted(paths, key=lambda p: (len(p), p)):
        held = holding(x, path)
        if 0 < held.sum() < len(y):
            by_rows.setdefault(np.packbits(held).tobytes(), (path, held))
    kept = list(by_rows.values())
    z = np.array([h for _, h in kept], np.float32).T
    b, w = lasso_logistic(z, y.astype(float), penalty)
    return Rules(b, tuple((path, float(v)) for (path, _), v in zip(kept, w) if v != 0))


def labelled(docs: DataFrame, labels: DataFrame, target: str, learn_from: Column, most: int = MAX_LABELLED) -> DataFrame:
    """Statistics and label of at most so many labelled rows, those of the lowest hashes."""
    chosen = labels.filter(learn_from & F.col(target).isNotNull()).select("doc_id", F.col(target).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # At most `most` rows of two numbers go to every task; repeated ids can make more of them, so the bound holds again.
    joined = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), statistics(F.col("text")).alias("s"), "y")
    return joined.orderBy("h", "doc_id", "y").limit(most).select("doc_id", "s", "y")


def train(docs: DataFrame, labels: DataFrame, target: str, learn_from: Column, most: int = MAX_LABELLED, **fit) -> Rules:
    rows = labelled(docs, labels, target, learn_from, most).select("doc_id", "s.*", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, *[r[k] for k in STATISTICS], r.y))
    x = np.array([[r[k] for k in STATISTICS] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r.y for r in rows], int), **fit)


def score(docs: DataFrame, rules: Rules, into: str = "score") -> DataFrame:
    """docs plus a score column."""
    stats = statistics(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn(into, let(stats, rules.column))
