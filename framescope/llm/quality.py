"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees propose conjunctions of threshold tests (every path from a root to a node), a lasso-penalised
logistic regression keeps few of them, and what is left is compiled into one Spark column expression over the
statistics.  The statistics come from bytes and words of the whole text and know no language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col, free_name
from framescope.llm.supervision import labelled

STATISTICS = ("words", "word_length", "distinct_share", "repeat_share", "upper_share", "digit_share", "letter_share", "mark_share",
              "symbol_share", "exclaim_share", "line_words", "line_repeat", "short_share", "stop_share")
SMALL_MARKS = b".,;:'\"-()?"


def statistics_of(text: str) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = raw.split()
    w = max(len(words), 1)
    upper, lower, digits, high = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum()), int(counts[128:].sum())
    marks = int(sum(counts[c] for c in SMALL_MARKS))
    symbols = int(counts[33:127].sum()) - upper - lower - digits - marks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (float(np.log1p(len(words))), float(lengths.sum()) / w, len(set(words)) / w, sum(map(bytes.__eq__, words, words[1:])) / w,
            upper / max(upper + lower, 1), digits / n, (upper + lower + high) / n, marks / n, symbols / n, int(counts[33]) / n,
            float(np.log1p(w / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1), float((lengths <= 3).sum()) / w,
            int(counts[46]) / w)


def _statistics_column(text: str) -> Column:
    """A struct of the statistics.  Python gets the text and returns numbers; the other columns stay where they are."""
    kind = pa.struct([(name, pa.float64()) for name in STATISTICS])

    @F.arrow_udf(", ".join(f"{name} double" for name in STATISTICS))
    def measured(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics_of(x.as_py()) for x in texts], float).reshape(len(texts), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(STATISTICS))], fields=list(kind))

    return measured(F.coalesce(col(text), F.lit("")))


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The `keep` columns under the names k0, k1, ..., and one double per name in STATISTICS."""
    rated = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], _statistics_column(text).alias("s"))
    return rated.select(*[f"k{i}" for i in range(len(keep))], *[F.col("s")[name].alias(name) for name in STATISTICS])


# ---------------------------------------------------------------- trees that propose rules
def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, seed: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """Distinct conjunctions ((statistic, is_greater, threshold), ...) on the paths of boosted trees."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))
        open_nodes = [(np.flatnonzero(rng.random(len(y)) < 0.7), np.arange(len(y)), ())]
        for level in range(depth):
            nodes, open_nodes = open_nodes, []
            for fit, everyone, path in nodes:
                best = (1e-3, None)
                for j in rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]:
                    k = len(edges[j]) + 1
                    gs, hs = np.cumsum(np.bincount(coded[fit, j], g[fit], k)), np.cumsum(np.bincount(coded[fit, j], h[fit], k))
                    if k < 2 or len(fit) == 0:
                        continue
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (gain[at], (j, at))
                if best[1] is None:
                    step[everyone] = g[fit].sum() / (h[fit].sum() + 1) if len(fit) else 0.0
                    continue
                j, at = best[1]
                for greater in (False, True):
                    here = path + ((int(j), greater, float(edges[j][at])),)
                    rules.setdefault(tuple(sorted(here)), None)
                    f = fit[(coded[fit, j] > at) == greater]
                    e = everyone[(coded[everyone, j] > at) == greater]
                    step[e] = g[f].sum() / (h[f].sum() + 1) if len(f) else 0.0
                    open_nodes.append((f, e, here))
        score += rate * step
    return list(rules)


def matches(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for r, rule in enumerate(rules):
        for j, greater, threshold in rule:
            out[:, r] *= (x[:, j] > threshold) == greater
    return out


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, k = m.shape
    step = 4.0 / max(float(np.linalg.eigvalsh((m.T @ m) / n).max(initial=0.0)) + 1.0, 1.0)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(m @ z[:k] + z[k])))
        nxt = z - step * np.append(m.T @ (p - y), (p - y).sum()) / n
        nxt[:k] = np.sign(nxt[:k]) * np.maximum(np.abs(nxt[:k]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return w[:k], float(w[k])


@dataclass
class RuleModel:
    rules: list
    weights: list[float]
    intercept: float

    def column(self, inside: Column | None = None) -> Column:
        """The probability as a column over STATISTICS, or over the fields of a struct of them."""
        value = (lambda j: F.col(STATISTICS[j])) if inside is None else (lambda j: inside[STATISTICS[j]])
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for j, greater, threshold in rule:
                test = test & ((value(j) > threshold) if greater else (value(j) <= threshold))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{STATISTICS[j]} {'>' if g else '<='} {t:.5g}" for j, g, t in r) for r, w in zip(self.rules, self.weights, strict=True)]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3, seed: int = 5) -> RuleModel:
    """The penalty is the one with the least log loss on a fifth of the rows.  Without rows of both classes the model is a
    constant: the smoothed share of ones."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    if y[~test].min() == y[~test].max() or not test.any():
        test[:] = False
    rules = boosted_rules(x[~test], y[~test], trees, depth, bins, rate, seed)
    if not rules:
        return RuleModel([], [], float(np.log(y.mean() / (1 - y.mean()))))
    m, best = matches(x, rules), (np.inf, 0.003)
    if test.any():
        for penalty in (0.0005, 0.001, 0.002, 0.005):
            w, b = lasso_logistic(m[~test], y[~test], penalty)
            p = np.clip(1 / (1 + np.exp(-(m[test] @ w + b))), 1e-6, 1 - 1e-6)
            loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
            best = min(best, (loss, penalty))
    w, b = lasso_logistic(m, y, best[1], 600)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """Fits on at most `max_rows` labelled rows that are not held out; their statistics (doubles) are what reaches the driver."""
    rows = with_statistics(labelled(docs, labels, label, max_rows, key, text), ("label",)).toPandas().sort_values([*STATISTICS, "k0"])
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["k0"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns and score (0 to 1).  Null and empty texts are scored by their zero statistics; every row is scored,
    repeated ones alike; an empty table gives no rows; other columns are ignored."""
    return with_statistics(docs, keep, text).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], model.column().alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose score is `least` or more.  Null and empty texts are scored by their zero statistics, repeated
    rows alike; an empty table gives no rows; columns of any name are kept."""
    own = free_name(docs, "__statistics")
    return docs.withColumn(own, _statistics_column(text)).filter(model.column(F.col(own)) >= least).drop(own)
