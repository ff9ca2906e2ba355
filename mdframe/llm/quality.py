"""Quality by a sparse ensemble of rules over text statistics.

Small regression trees are boosted on a sample; every path from a root is a rule, a conjunction of bounds on statistics; a lasso logistic
model chooses rules and weighs them. Statistics and rules are Spark columns, so scoring is one expression over the text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import table
from mdframe.llm.labelled import held_out, sample_ids, with_rows

#: Labelled rows that a model learns from, at most.
FIT_ROWS = 12_000
FOLDS, FOLD = 5, 0
CUT = 0.3
TREES = 40
DEPTH = 3
BINS = 24


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, each a double; of a null or empty text all are 0."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    count = F.size(words).cast("double")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1.0))

    return {
        "log_chars": F.log1p(chars),
        "word_chars": chars / count,
        "fresh_words": F.size(F.array_distinct(words)) / F.sqrt(count),
        "repeated_words": 1 - F.size(F.array_distinct(words)) / count,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.log1p(count / F.size(lines)),
        "capitals": share(r"\p{Lu}"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]"),
        "bars": share(r"\|"),
        "stops": share(r"[.]"),
        "digits": share(r"\p{Nd}"),
    }


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    grid = np.linspace(0, 1, BINS + 2)[1:-1]
    return [np.unique(np.quantile(col, grid)) for col in x.T]


def _grow(x, residual, weight, rows, bounds, depth, path, rules) -> dict:
    """A regression tree by largest gain; every node's path is added to ``rules``."""
    total, mass = residual[rows].sum(), weight[rows].sum()
    node = {"value": total / (mass + 1.0)}
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 20:
        return node
    best = (1e-6, None, None)
    for k, cuts in enumerate(bounds):
        if not len(cuts):
            continue
        b = np.searchsorted(cuts, x[rows, k], side="right")
        r = np.bincount(b, residual[rows], len(cuts) + 1).cumsum()[:-1]
        w = np.bincount(b, weight[rows], len(cuts) + 1).cumsum()[:-1]
        n = np.bincount(b, minlength=len(cuts) + 1).cumsum()[:-1]
        gain = r**2 / (w + 1.0) + (total - r) ** 2 / (mass - w + 1.0) - total**2 / (mass + 1.0)
        gain[(n < 5) | (len(rows) - n < 5)] = -1
        if gain.max() > best[0]:
            best = (gain.max(), k, cuts[gain.argmax()])
    if best[1] is None:
        return node
    _, k, cut = best
    low = x[rows, k] < cut
    node |= {"k": k, "cut": cut}
    node["low"] = _grow(x, residual, weight, rows[low], bounds, depth - 1, [*path, (k, "<", float(cut))], rules)
    node["high"] = _grow(x, residual, weight, rows[~low], bounds, depth - 1, [*path, (k, ">=", float(cut))], rules)
    return node


def _predict(node: dict, x: np.ndarray) -> np.ndarray:
    if "k" not in node:
        return np.full(len(x), node["value"])
    low = x[:, node["k"]] < node["cut"]
    out = np.empty(len(x))
    out[low], out[~low] = _predict(node["low"], x[low]), _predict(node["high"], x[~low])
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[tuple]:
    """Paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    bounds, rules, z = _bounds(x), set(), np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = rng.choice(len(y), max(20, len(y) // 2), replace=len(y) < 40)
        tree = _grow(x, y - p, p * (1 - p) + 1e-6, rows, bounds, DEPTH, [], rules)
        z += 0.3 * _predict(tree, x)
    return sorted(rules)


def rule_matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, side, cut in rule:
            out[:, j] *= (x[:, k] < cut) if side == "<" else (x[:, k] >= cut)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept under an absolute-value penalty on weights, by accelerated proximal gradient."""
    n = len(y)
    full = np.c_[a, np.ones(n)]
    step = 4 * n / (np.linalg.norm(full, 2) ** 2 + 1e-9)
    w = np.zeros(full.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        u = v - step * (full.T @ (p - y)) / n
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return w[:-1], float(w[-1])


class RuleEnsemble:
    """Weighted rules and an intercept; ``column`` compiles them."""

    def __init__(self, names: list[str], rules: list[tuple[tuple, float]], intercept: float) -> None:
        self.names, self.rules, self.intercept = names, rules, intercept

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, from 0 to 1."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            match = None
            for k, side, cut in rule:
                c = stats[self.names[k]]
                c = c < cut if side == "<" else c >= cut
                match = c if match is None else match & c
            z = z + F.when(match, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, penalty: float = 3e-4) -> RuleEnsemble:
    """Learn from at most ``most`` labelled rows outside the held-out fold. Without both labels every score is the share of label 1."""
    stats = statistics(F.col("text"))
    ids = sample_ids(labels, "quality", FOLDS, FOLD, most)
    rows = with_rows(docs.select("doc_id", "text"), ids).select("doc_id", *[c.alias(k) for k, c in stats.items()], "y")
    rows = rows.orderBy("doc_id", *stats).collect()
    x, y = np.array([r[1:-1] for r in rows], float).reshape(len(rows), len(stats)), np.array([float(r[-1]) for r in rows])
    if len(set(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.99, 0.01, 0.99))
        return RuleEnsemble(list(stats), [], math.log(share / (1 - share)))
    rules = extract_rules(x, y)
    weights, intercept = lasso_logistic(rule_matrix(x, rules), y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-3]
    return RuleEnsemble(list(stats), kept, intercept)


def _unused(name: str, columns: list[str]) -> str:
    """``name``, longer where a column, or the start of one, has it."""
    low = [c.lower() for c in columns]
    while any(c.startswith(name) for c in low):
        name += "_"
    return name


def with_score(docs: DataFrame, model: RuleEnsemble, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text in a new last column ``name``; a null text scores as an empty one.

    Every row is scored on its own, repeated rows and rows that share an id too; a column of any name may be there but ``name`` itself.
    """
    stats, own = statistics(F.col(text)), _unused("__s", [*docs.columns, name])
    held = docs.select("*", F.struct(*[c.alias(f"{own}{k}") for k, c in stats.items()]).alias(f"{own}all"))
    held = held.select(*docs.columns, F.inline_outer(F.array(f"{own}all")))  # a barrier: no filter on the score computes statistics again for each rule
    score = model.column({k: F.col(f"{own}{k}") for k in stats})
    return held.select(*[held[c] for c in docs.columns], score.alias(name))


def keep_good(docs: DataFrame, model: RuleEnsemble, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    name = _unused("__q", docs.columns)
    return with_score(docs, model, name).where(F.col(name) >= cut).drop(name)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a row for each row, whatever its id or text (see :func:`with_score`)."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
