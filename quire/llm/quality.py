"""Quality by a sparse rule ensemble over text statistics.

Statistics are Spark column expressions over the whole text. Small boosted trees over them are
grown in numpy on a bounded labelled sample; every path from a root is a conjunctive rule; an
l1-penalised logistic regression keeps few of the rules and weighs them. The kept rules are
compiled back into one Spark column expression, so scoring is a projection: no Python runs on
the executors and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids, sample_rows


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of a text; null counts as empty, and shares of nothing are 0."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = lambda c: n - F.length(F.replace(t, F.lit(c), F.lit("")))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    number = F.size(words)
    lines = count("\n") + 1
    return {
        "chars": n.cast("double"),
        "word_length": share(F.length(F.concat_ws("", words)), number),
        "distinct_words": F.when(number == 0, 0.0).otherwise(share(F.size(F.array_distinct(words)), number)),
        "words_a_line": share(number, lines),
        "exclamations": share(count("!"), number),
        "pipes": share(count("|"), number),
        "stops": share(count("."), number),
        "commas": share(count(","), number),
        "symbols": share(F.regexp_count(t, F.lit(r"[#$%&*@^~=+<>{}\[\]_\\]")), number),
        "capitals": share(F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")), n),
        "digits": share(F.regexp_count(t, F.lit("[0-9]")), n),
    }


def _tree(x: np.ndarray, g: np.ndarray, depth: int, leaf: int) -> list[tuple]:
    """The paths of a regression tree on residuals: tuples of (column, at_most, threshold)."""
    rules: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * leaf:
            return
        best, total = (1e-9, None), g[rows].sum()
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            vs, left = v[order], np.cumsum(g[rows][order])
            k = np.arange(1, len(rows))
            ok = (vs[1:] > vs[:-1]) & (k >= leaf) & (k <= len(rows) - leaf)
            if ok.any():
                gain = np.where(ok, left[:-1] ** 2 / k + (total - left[:-1]) ** 2 / (len(rows) - k) - total**2 / len(rows), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (j, float((vs[i] + vs[i + 1]) / 2)))
        if best[1]:
            j, at = best[1]
            low = x[rows, j] <= at
            grow(rows[low], (*path, (j, True, at)))
            grow(rows[~low], (*path, (j, False, at)))

    grow(np.arange(len(x)), ())
    return rules


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, at in rule:
        out &= (x[:, j] <= at) if low else (x[:, j] > at)
    return out


def rule_ensemble(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, leaf: int = 5, penalty: float = 0.002, seed: int = 11) -> tuple[list[tuple], np.ndarray, float]:
    """(rules, weights, bias): rules with a weight other than 0 only.

    Without rows of both labels there are no rules, and the bias gives the share of label 1.
    """
    if not len(y) or y.min() == y.max():
        return [], np.zeros(0), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rng = np.random.default_rng(seed)
    f, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        part = rng.random(len(y)) < 0.7
        g = y - 1 / (1 + np.exp(-f))
        found = _tree(x[part], g[part], depth, leaf)
        rules.update(dict.fromkeys(found))
        ends = [r for r in found if not any(len(q) > len(r) and q[: len(r)] == r for q in found)]
        for r in ends:
            h = holds(r, x)
            if h.any():
                f[h] += 0.3 * 4 * g[h].mean()
    rules = list(rules)
    if not rules:
        return [], np.zeros(0), float(f[0])
    a = np.stack([holds(r, x) for r in rules], 1).astype(float)
    scale = np.maximum(a.std(0), 0.02)
    w, b, step = np.zeros(len(rules)), float(f.mean()), 4 / (np.linalg.norm(a / scale, 2) ** 2 / len(y) + 1)
    v, c, t = w.copy(), b, 1.0
    for _ in range(800):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(a @ (v / scale) + c))) - y
        new = v - step * (a.T @ r / len(y)) / scale
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb, nt = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    keep = np.flatnonzero(w)
    return [rules[i] for i in keep], (w / scale)[keep], float(b)


def compiled(rules: list[tuple], weights: np.ndarray, bias: float, columns: list[Column]) -> Column:
    """The ensemble's probability of label 1 as a column expression."""
    z = F.lit(bias)
    for rule, w in zip(rules, weights.tolist(), strict=True):
        test = F.lit(True)
        for j, low, at in rule:
            test = test & ((columns[j] <= at) if low else (columns[j] > at))
        z = z + F.when(test, w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row, from its whole text.

    Fits on at most ``most`` labelled rows of each label, chosen by the hash of their id, from
    rows that aren't held out. Null and empty texts are scored by their statistics, all 0. Rows,
    repeats and null ids are kept; other columns are ignored.
    """
    stats = statistics(F.col(text))
    names = list(stats)
    known = sample_ids(labels, label, most, id_col)
    rows = sample_rows(docs, known, [F.array(*stats.values()).alias("x")], id_col, text).collect() if known else []
    rows.sort(key=lambda r: (r[0], r.x))
    rules, weights, bias = rule_ensemble(np.array([r.x for r in rows]).reshape(-1, len(names)), np.array([r.y for r in rows], float))
    inner = docs.select(F.col(id_col).alias("id"), F.array(*stats.values()).alias("x"))
    score = compiled(rules, weights, bias, [F.get("x", F.lit(j)) for j in range(len(names))])
    out = inner.select(F.col("id").alias(id_col), "x").withColumn("score", score)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
