"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on a bounded sample propose conjunctions of thresholds; a lasso logistic
regression keeps few of them; those are compiled into a Spark column over built-in expressions, so
that scoring is one pass of generated code with neither shuffle nor Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import table

#: Labelled rows that are fitted on, at most: those whose hashed doc_id is least.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 24, 0.3
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, as built-in expressions; null is as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    per_char = lambda x: x / F.greatest(chars, F.lit(1))
    words, lines = F.split(t, r"[ \t-\r]+", -1), F.split(t, r"\n", -1)
    return {
        "chars": chars.cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": chars / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": F.size(words) / F.size(lines),
        "upper": per_char(left(r"\P{Lu}+")),
        "digits": per_char(left(r"[^0-9]+")),
        "signs": per_char(left(r"[\p{L}\p{N}\s.,]+")),
        "sentence_ends": count(r"[.!?](?=\s|\z)") / F.size(words),
    }


class Rule(NamedTuple):
    """(statistic, above, threshold) conditions that hold together, and their weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


class Model(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]

    def column(self, prefix: str = "") -> Column:
        """The score, 0 to 1, over columns that hold the statistics."""
        total = F.lit(self.bias)
        for r in self.rules:
            holds = F.lit(True)
            for name, above, at in r.conditions:
                c = F.col(prefix + name)
                holds = holds & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Grows one tree by gain over histograms; adds every node's path to ``out``; returns its steps."""
    step = np.zeros(len(grad))
    g, h = grad[rows].sum(), hess[rows].sum()
    value = -g / (h + 1.0)
    step[rows] = value
    if not depth or len(rows) < 20:
        return step
    best = (1e-6, 0, 0)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        gs = np.bincount(codes[rows, j], grad[rows], len(edges) + 1).cumsum()[:-1]
        hs = np.bincount(codes[rows, j], hess[rows], len(edges) + 1).cumsum()[:-1]
        gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
        gain[(hs < 0.5) | (h - hs < 0.5)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    gain, j, k = best
    if gain <= 1e-6:
        return step
    low = codes[rows, j] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        here = (*path, (j, above, float(cuts[j][k])))
        out.append(here)
        step[part] = _tree(x, codes, cuts, grad, hess, part, depth - 1, here, out)[part]
    return step


def _simplest(path: tuple) -> tuple:
    """One bound per statistic and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for j, above, at in path:
        old = bounds.get((j, above))
        bounds[j, above] = at if old is None else (max if above else min)(old, at)
    return tuple(sorted((j, above, at) for (j, above), at in bounds.items()))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic loss + penalty * |weights| by accelerated proximal gradient; the last column, the bias, is free."""
    n = len(y)
    rate = 4.0 / max((r**2).sum(axis=1).max(), 1.0)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ z)))
        new = z - rate * (r.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Rules and weights from a matrix of statistics and 0/1 labels.

    Without rows the score is a half everywhere; with one label only, it is near that label.
    """
    n = len(y)
    if not n:
        return Model(0.0, ())
    rate = (y.sum() + 0.5) / (n + 1)
    prior = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Model(prior, ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [e[e < c.max()] for e, c in zip(cuts, x.T)]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x.T)], axis=1)
    paths: list[tuple] = []
    f, rng = np.full(n, prior), np.random.default_rng(5)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(rng.random(n) < 0.6) if n > 100 else np.arange(n)
        grown: list[tuple] = []
        step = _tree(x, codes, cuts, grad, hess, rows, DEPTH, (), grown)
        # steps reach the rows outside the sample by the same paths
        for path in sorted(grown, key=len):
            inside = np.ones(n, bool)
            for j, above, at in path:
                inside &= (x[:, j] > at) == above
            sample = inside[rows]
            if sample.any():
                step[inside] = step[rows[sample]].mean() if len(path) == DEPTH else step[inside]
        f = f + RATE * step
        paths += grown
    rules = sorted(set(map(_simplest, paths)))
    r = np.ones((n, len(rules) + 1), np.float32)
    for i, rule in enumerate(rules):
        for j, above, at in rule:
            r[:, i] *= (x[:, j] > at) == above
    r = r.astype(float)
    fold = rng.random(n) < 0.75 if n > 60 else np.ones(n, bool)
    w, best = np.zeros(len(rules) + 1), (np.inf, PENALTIES[-1])
    w[-1] = prior
    for penalty in PENALTIES:
        w = _lasso(r[fold], y[fold], penalty, w)
        p = np.clip(1 / (1 + np.exp(-(r[~fold] @ w))), 1e-6, 1 - 1e-6) if (~fold).any() else np.zeros(0)
        loss = -np.mean(np.where(y[~fold] == 1, np.log(p), np.log(1 - p))) if len(p) else 0.0
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    start = np.zeros(len(rules) + 1)
    start[-1] = prior
    w = _lasso(r, y, best[1], start, 800)
    kept = tuple(Rule(tuple((names[j], above, at) for j, above, at in rule), float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-6)
    return Model(float(w[-1]), kept)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents. Labels other than 0 and 1, and null ids, are
    left out; a document labelled twice takes the higher label."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").alias("t"))
    stats = statistics(F.col("t"))
    found = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", *[c.alias(k) for k, c in stats.items()]).limit(2 * rows).collect()
    found.sort(key=lambda r: tuple(r))
    x = np.asarray([[r[k] for k in stats] for r in found], float).reshape(-1, len(stats))
    return fit(x, np.asarray([r.y for r in found], float), list(stats))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 from a half on) of each row's whole text, null as empty.

    Rows stay rows: repeats and ties get equal scores, other columns aren't read.
    """
    stats = docs.select("doc_id", *[c.alias(f"s_{k}") for k, c in statistics(F.col("text")).items()])
    return stats.select("doc_id", model.column("s_").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
