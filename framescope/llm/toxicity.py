"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of four rows of one embedding table, two hashes of the word and two of its first bytes (two hashes, so that
a chance collision moves a word only half way).  Filters of widths 1 to 3 slide over the words, each keeps its maximum over
the whole text, and a logistic unit reads the maxima.  One embedding coordinate starts from smoothed log odds, the rest
at random; then everything is trained together.  Thresholds per language are chosen on rows kept back from training;
the language is no input of the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import bytewords
from framescope.llm.storage import col
from framescope.llm.supervision import labelled

ROWS_BITS, DIM, FILTERS, WIDTHS, PREFIX = 19, 8, 8, (1, 2, 3), 4
PAD = 1 << ROWS_BITS  # a row of zeros


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table by word and text; first word of each text).  After each text come as many PAD words as the widest
    filter has, so that a window that begins in one text, or at the first PAD of an empty one, never reaches the next."""
    w = bytewords.Words(texts, bytewords.letters())
    whole, head = w.word_hashes(), w.hashes(w.begin, np.minimum(w.begin + PREFIX, w.end))
    mask = np.uint64((1 << ROWS_BITS) - 1)
    head = bytewords.mixed(head ^ np.uint64(0x5851F42D4C957F2D))
    rows = np.stack([h >> np.uint64(s) & mask for h in (whole, head) for s in (0, 32)], 1).astype(np.int32)
    sizes = np.bincount(w.owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + WIDTHS[-1])])
    out = np.full((first[-1], 4), PAD, np.int32)
    out[np.arange(len(rows)) + WIDTHS[-1] * w.owner] = rows
    return out, first


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of each text begin and end: at its words, or at one PAD if it has none."""
    begin, words = first[:-1], np.diff(first) - WIDTHS[-1]
    return begin, begin + np.maximum(words, 1)


@dataclass
class TextConvolution:
    table: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) per width
    biases: list[np.ndarray]
    head: np.ndarray
    intercept: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def maps(self, rows: np.ndarray):
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]] + self.table[rows[:, 3]]
        padded = np.concatenate([x, np.zeros((2, x.shape[1]), np.float32)])
        return padded, [sum(padded[j:j + len(x)] @ f[j] for j in range(len(f))) + b for f, b in zip(self.filters, self.biases, strict=True)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in bytewords.groups(texts):
            rows, first = word_rows(texts[a:b])
            ranges = np.stack(window_starts(first), 1).reshape(-1)
            pooled = np.concatenate([np.maximum.reduceat(m, ranges)[::2] for m in self.maps(rows)[1]], 1)
            out[a:b] = 1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.head + self.intercept, -40, 40).astype(float)))
        return out


def log_odds(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per table row, the positive part of the smoothed log odds of a toxic text, given that the row occurs in it."""
    seen = [np.zeros(PAD + 1), np.zeros(PAD + 1)]
    for r, label in zip(rows, y, strict=True):
        seen[int(label)][np.unique(r)] += 1
    n0, n1 = max((y == 0).sum(), 1), max((y == 1).sum(), 1)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    total = seen[0] + seen[1]
    odds = np.maximum(odds, 0) * total / (total + 5)
    odds[PAD] = 0
    return odds


def train(texts: list[bytes], y: np.ndarray, langs: list[str | None], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 11) -> TextConvolution:
    """Adagrad on the log loss.  A tenth of the rows is kept back for the thresholds.  Without rows of both classes the score
    is a constant, the smoothed share of toxic rows."""
    rng = np.random.default_rng(seed)
    model = TextConvolution((rng.normal(0, 0.02, (PAD + 1, DIM))).astype(np.float32), [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), 0.0)
    model.table[PAD] = 0
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.head[:], model.intercept = 0, float(np.log(share / (1 - share)))
        return model
    kept_back = rng.random(len(y)) < 0.1
    rows = []
    for a, b in bytewords.groups(texts):
        r, first = word_rows(texts[a:b])
        rows += [r[first[i]:first[i + 1]] for i in range(b - a)]
    fit = np.flatnonzero(~kept_back)
    model.table[:, 0] = (log_odds([rows[i] for i in fit], y[fit]) / 4).astype(np.float32)
    for f in model.filters:
        f[:, 0, : FILTERS // 2] = 1 / len(f)
    model.intercept = float(np.log(y[fit].mean() / (1 - y[fit].mean())) - 0.5)
    squares = {"table": np.full(model.table.shape, 1e-3, np.float32), "head": np.full_like(model.head, 1e-3), "intercept": 1e-3,
               "filters": [np.full_like(f, 1e-3) for f in model.filters], "biases": [np.full_like(b, 1e-3) for b in model.biases]}
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            r = np.concatenate([rows[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in chosen])])
            x, maps = model.maps(r)
            spans = list(zip(*window_starts(first), strict=True))
            peaks = [np.stack([a + m[a:z].argmax(0) for a, z in spans]) for m in maps]
            pooled = [np.take_along_axis(m, p, 0) for m, p in zip(maps, peaks, strict=True)]
            hidden = np.maximum(np.concatenate(pooled, 1), 0)
            p = 1 / (1 + np.exp(-(hidden @ model.head + model.intercept)))
            err = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            back = (err[:, None] * model.head) * (hidden > 0)
            grad_rows, grads = [], []
            for k, f in enumerate(model.filters):
                delta, gf = back[:, k * FILTERS:(k + 1) * FILTERS], np.zeros_like(f)
                for j in range(len(f)):
                    where = peaks[k] + j
                    gf[j] = np.einsum("df,dfe->ef", delta, x[where])
                    ok = where < len(r)
                    touched = np.where(ok[..., None], r[np.minimum(where, len(r) - 1)], PAD)
                    g = delta[..., None] * f[j].T[None]
                    grad_rows.append(touched.reshape(-1))
                    grads.append(np.repeat(g.reshape(-1, DIM), 4, 0))
                step(f, squares["filters"][k], gf, rate)
                step(model.biases[k], squares["biases"][k], delta.sum(0), rate)
            step(model.head, squares["head"], hidden.T @ err, rate)
            g = float(err.sum())
            squares["intercept"] += g * g
            model.intercept -= rate * g / squares["intercept"] ** 0.5
            where, back_to = np.unique(np.concatenate(grad_rows), return_inverse=True)
            total = np.zeros((len(where), DIM), np.float32)
            np.add.at(total, back_to, np.concatenate(grads))
            total[where == PAD] = 0
            squares["table"][where] += total ** 2
            model.table[where] -= rate * total / np.sqrt(squares["table"][where])
    calibrate(model, [texts[i] for i in np.flatnonzero(kept_back)], y[kept_back], [langs[i] for i in np.flatnonzero(kept_back)])
    return model


def step(value: np.ndarray, squares: np.ndarray, grad: np.ndarray, rate: float) -> None:
    squares += grad ** 2
    value -= rate * grad / np.sqrt(squares)


def calibrate(model: TextConvolution, texts: list[bytes], y: np.ndarray, langs: list[str | None], least: int = 20) -> None:
    """Per language, the threshold in the middle of the range with the best F1; languages with fewer than `least` rows or without
    a toxic one use 0.5."""
    if not len(texts):
        return
    scores, langs = model.score(texts), np.array([x or "" for x in langs])
    for lang in np.unique(langs):
        s, t = scores[langs == lang], y[langs == lang]
        if len(s) < least or not t.any():
            continue
        cuts = np.append(np.unique(s), 1.0)
        middles = (cuts[1:] + cuts[:-1]) / 2
        f1 = np.array([2 * ((s >= c) & (t == 1)).sum() / max(((s >= c).sum() + t.sum()), 1) for c in middles])
        best = middles[f1 >= f1.max() - 1e-12]
        model.thresholds[str(lang)] = float(best[np.argmin(np.abs(best - 0.5))])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> TextConvolution:
    """Trains on at most `max_rows` labelled rows that are not held out; their whole texts reach the driver."""
    rows = labelled(docs, labels, label, max_rows, key, text, (lang,)).collect()
    rows.sort(key=lambda r: (r["text"], r["label"]))
    return train([r["text"].lower().encode() for r in rows], np.array([r["label"] for r in rows], float), [r[lang] for r in rows])


def classify(docs: DataFrame, model: TextConvolution, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, score (0 to 1), threshold (of the row's language; 0.5 for others and for null), flagged (score >= threshold).

    Null and empty texts get the score of a text without words.  Every row is scored, repeated ones alike; an empty table
    gives no rows; other columns are ignored.  The model, of fixed size (about 17 MB), is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(col(key).alias("k"), F.coalesce(col(lang), F.lit("")).cast("string").alias("l"), F.coalesce(col(text), F.lit("")).alias("t"))

    def run(batches):
        m = shared.value
        for b in batches:
            score = m.score([t.lower().encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()])
            threshold = np.array([m.thresholds.get(x, 0.5) for x in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(threshold), pa.array(score >= threshold)], ["k", "score", "threshold", "flagged"])

    return base.mapInArrow(run, f"k {base.schema['k'].dataType.simpleString()}, score double, threshold double, flagged boolean").withColumnRenamed("k", key)
