"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum of its rows' covariance: count, mean, eigenvalues and eigenvectors.  A row changes the covariance
by one term of rank one along its distance from the mean so far, and the new eigenvalues are the roots of a secular equation;
directions that the term does not touch, and all but one of those with equal eigenvalues, are deflated first.  Spectra of
tasks are combined in the same way: the second one's eigenvectors, and the distance of the means, are successive terms of
rank one.  FAN_IN of them meet in a task, level by level.

The result is a basis close to the eigenvectors.  A last pass over all rows projects them on it, centred at the exact mean, and
sums the products; the eigenvectors of that small matrix turn the basis into the final components (Rayleigh-Ritz), which
takes out what thousands of updates have left of rounding.

Entries are integers, floor(scale * c) + offset, so counts, sums and distances from the mean are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col, stored

FAN_IN = 16
LARGEST = float(1 << 60)  # scaled entries beyond it count as this
TINY = np.finfo(float).eps
ROUNDS = 80  # of the search for roots; ten are usual
ROWS = "part long, n long, mean array<double>, values array<double>, basis array<double>"


# ---------------------------------------------------------------- rank-one updates
def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) for rising, distinct d and positive z2, each as (number of the nearer pole, distance from it).

    All roots at once: the two sums of terms below and above a root are replaced by one pole each, which gives the next guess;
    one outside its bracket is replaced by the bracket's middle."""
    k = len(d)
    total = z2.sum()
    gap = np.append(np.diff(d), total)
    below = np.tri(k, dtype=bool).T  # [term, root]: poles up to the root's left one
    middle = 1 + (z2[:, None] / ((d[:, None] - d) - gap / 2)).sum(0)
    right = (middle < 0) & (np.arange(k) < k - 1)
    origin = np.arange(k) + right
    delta = d[:, None] - d[origin]
    left, high = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(np.arange(k) < k - 1, gap / 2, gap))
    x = (lo + hi) / 2
    open_ = np.arange(k)
    for _ in range(ROUNDS):
        t = z2[:, None] / (delta[:, open_] - x[open_])
        t2 = t / (delta[:, open_] - x[open_])
        b = below[:, open_]
        psi, phi = np.where(b, t, 0).sum(0), np.where(b, 0, t).sum(0)
        dpsi, dphi = np.where(b, t2, 0).sum(0), np.where(b, 0, t2).sum(0)
        w, now = 1 + psi + phi, x[open_]
        rising = w < 0  # the sum rises with x
        lo[open_], hi[open_] = np.where(rising, now, lo[open_]), np.where(rising, hi[open_], now)
        done = (np.abs(w) <= TINY * k * (1 + np.abs(psi) + phi)) | (hi[open_] - lo[open_] <= TINY * np.maximum(np.abs(lo[open_]), np.abs(hi[open_])))
        with np.errstate(all="ignore"):
            a1, a2 = left[open_] - now, high[open_] - now
            last = open_ == k - 1
            c = w - a1 * dpsi - np.where(last, 0, a2 * dphi)
            p = (a1 + a2) * w - a1 * a2 * (dpsi + dphi)
            q = a1 * a2 * w
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(last, a1 + a1 * a1 * dpsi / c, step)
        guess = now + step
        inside = (guess > lo[open_]) & ((guess < hi[open_]) | (last & (guess == hi[open_])))
        x[open_] = np.where(done, now, np.where(inside, guess, (lo[open_] + hi[open_]) / 2))
        open_ = open_[~done]
        if not len(open_):
            break
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of basis @ diag(values) @ basis.T + v @ v.T."""
    z = basis.T @ v
    size = max(float(values[-1]), float(z @ z), 1e-300)
    edges = np.flatnonzero(np.diff(values) > 8 * TINY * size) + 1
    if len(edges) < len(values) - 1:  # equal eigenvalues: turn their directions so that only one meets v
        values, basis, z = values.copy(), basis.copy(), z.copy()
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(values)).tolist(), strict=True):
            length = np.linalg.norm(z[a:b])
            if b - a > 1 and length > 0:
                u = z[a:b] / length
                u[-1] += 1.0 if u[-1] >= 0 else -1.0
                u /= np.linalg.norm(u)
                basis[:, a:b] -= 2 * np.outer(basis[:, a:b] @ u, u)
                z[a:b] -= 2 * u * (u @ z[a:b])
                z[a:b - 1] = 0
                values[a:b] = values[a:b].mean()
    keep = np.flatnonzero(z * z > (TINY * size) * TINY)
    if len(keep) == 0:
        return values, basis
    d, s = values[keep], z[keep]
    origin, x = secular_roots(d, s * s)
    away = (d[origin] - d[:, None]) + x  # [pole, root]: root - pole
    # The vector for which these roots are exact (Gu and Eisenstat), so the eigenvectors are orthogonal.
    k = len(d)
    poles = d[None, :] - d[:, None]  # [pole, other]: other - pole
    lower = np.tri(k, k, -1, dtype=bool)
    factor = np.where(lower, away / np.where(poles == 0, 1, poles), 1)
    upper = np.where(lower.T[:, 1:], away[:, :-1] / np.where(poles[:, 1:] == 0, 1, poles[:, 1:]), 1)
    s_hat = np.sqrt(np.abs(factor.prod(1) * upper.prod(1) * away[:, -1])) * np.where(s < 0, -1.0, 1.0)
    turn = s_hat[:, None] / -away
    turn /= np.linalg.norm(turn, axis=0)
    out_values, out_basis = values.copy(), basis.copy()
    out_values[keep] = d[origin] + x
    out_basis[:, keep] = basis[:, keep] @ turn
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_basis[:, order]


@dataclass
class Spectrum:
    """Count, mean, and the eigenvalues and eigenvectors of the covariance (divisor n)."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, row: np.ndarray) -> None:
        n, gap = self.n, row - self.mean
        self.n, self.mean = n + 1, self.mean + gap / (n + 1)
        if n:
            self.values, self.basis = rank_one(self.values * (n / (n + 1)), self.basis, gap * (np.sqrt(n) / (n + 1)))

    def merge(self, other: Spectrum) -> None:
        if self.n == 0 or other.n == 0:
            if self.n == 0:
                self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        n = self.n + other.n
        gap, share = other.mean - self.mean, other.n / n
        values, basis = self.values * (self.n / n), self.basis
        for e, u in zip(other.values, other.basis.T, strict=True):
            if e > 0:
                values, basis = rank_one(values, basis, u * np.sqrt(e * share))
        self.values, self.basis = rank_one(values, basis, gap * np.sqrt(self.n / n * share))
        self.n, self.mean = n, self.mean + gap * share


# ---------------------------------------------------------------- over tables
def vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """k, v (array of doubles) of the rows whose vector has as many entries as the longest one, all of them finite."""
    v = rows.select(col(key).alias("k"), col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    fine = v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    width = fine.agg(F.max(F.size("v"))).first()[0] or 0
    return fine.filter(F.size("v") == width) if width else fine.limit(0)


def matrix(column: pa.Array, scale: float, offset: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64) + offset).reshape(len(column), -1)


def folded(rows: DataFrame, merge: Callable[[Iterator[dict]], dict], label: str) -> dict | None:
    """One row out of many: FAN_IN rows (by `part`) meet in a task, until one is left."""
    schema = rows.schema
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        some = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = merge(some) | {"part": some[0]["part"] // FAN_IN}
        return pa.Table.from_pylist([{c: out[c] for c in names}], schema=table.schema)

    rows = stored(rows, label)
    span = rows.agg(F.max("part")).first()[0]
    if span is None:
        return None
    while span > 0:
        rows = stored(rows.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(run, schema), label)
        span //= FAN_IN
    only = rows.first()
    return only.asDict()


def spectra(v: DataFrame, width: int, scale: float, offset: int) -> DataFrame:
    """One spectrum per task."""
    def run(batches):
        from pyspark import TaskContext
        s = Spectrum.empty(width)
        for b in batches:
            for row in matrix(b.column(0), scale, offset):
                s.add(row.astype(float))
        if s.n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": s.n, "mean": s.mean.tolist(), "values": s.values.tolist(), "basis": s.basis.ravel().tolist()}])

    return v.select("v").mapInArrow(run, ROWS)


def merged_spectra(some: list[dict]) -> dict:
    out = None
    for r in some:
        width = len(r["mean"])
        s = Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]), np.array(r["basis"]).reshape(width, width))
        if out is None:
            out = s
        else:
            out.merge(s)
    return {"n": out.n, "mean": out.mean.tolist(), "values": out.values.tolist(), "basis": out.basis.ravel().tolist()}


def exact_sums(v: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """(rows, sum of every dimension), exactly."""
    at = v.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(scale) * F.col("c")))) + offset).cast("decimal(20,0)")).alias("s"))
    rows = sorted((r["i"], r["n"], int(r["s"])) for r in at.toLocalIterator())  # one row per dimension
    return (rows[0][1] if rows else 0), [r[2] for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where that fits, else as Python's integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    return x * n - np.array(sums, np.int64) if most < 1 << 61 else x.astype(object) * n - np.array(sums, object)


def projected_products(v: DataFrame, turn: np.ndarray, n: int, sums: list[int], scale: float, offset: int, label: str) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of products) over all rows of y = (x - S/n) @ turn."""
    shared = v.sparkSession.sparkContext.broadcast(turn)
    width = turn.shape[1]

    def run(batches):
        from pyspark import TaskContext
        s, p, some = np.zeros(width), np.zeros((width, width)), False
        for b in batches:
            y = centred(matrix(b.column(0), scale, offset), n, sums).astype(float) / n @ shared.value
            s, p, some = s + y.sum(0), p + y.T @ y, True
        if some:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "s": s.tolist(), "p": p.ravel().tolist()}])

    def merge(some):
        return {"s": np.sum([r["s"] for r in some], 0).tolist(), "p": np.sum([r["p"] for r in some], 0).tolist()}

    out = folded(v.select("v").mapInArrow(run, "part long, s array<double>, p array<double>"), merge, label)
    shared.destroy()
    return np.array(out["s"]), np.array(out["p"]).reshape(width, width)


@dataclass
class Whitener:
    """`components` has a unit eigenvector per column, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def scale(self) -> np.ndarray:
        """What projections are multiplied by: one over the deviation, 0 for directions in which nothing varies."""
        return np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0.0)


def fit(v: DataFrame, components: int, scale: float, offset: int) -> Whitener | None:
    """None if there are no vectors."""
    n, sums = exact_sums(v, scale, offset)
    if n == 0:
        return None
    width = len(sums)
    start = folded(spectra(v, width, scale, offset), merged_spectra, "white-spectra")
    basis = np.linalg.qr(np.array(start["basis"]).reshape(width, width)[:, ::-1])[0]
    _, products = projected_products(v, basis, n, sums, scale, offset, "white-products")
    values, turn = np.linalg.eigh((products + products.T) / (2 * n))
    values, vectors_ = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(products)) / n
    values = np.where(values > width * TINY * max(trace, 0), values, 0.0)[:components]
    model = Whitener(n, sums, values, vectors_[:, :components], trace, 0.0)
    s, p = projected_products(v, model.components * model.scale(), n, sums, scale, offset, "white-check")
    off = (p / n - np.outer(s / n, s / n) - np.eye(len(values)))[np.ix_(values > 0, values > 0)]
    model.identity_error = float(np.abs(off).max(initial=0.0))
    return model


def whiten(rows: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, n, deviation (decimal: sum over dimensions of (n*x - S)^2, exact), whitened (array, one value per component by
    falling eigenvalue), explained (array), identity_error.

    Rows are left out whose vector is null, holds a null, NaN or infinite entry, or has fewer entries than the longest one that does not.
    Repeated rows and keys all count; a null key stays null; other columns are ignored; an empty table gives no rows.  A vector
    may have fewer dimensions than `components`.  In directions in which nothing varies whitened and explained are 0, and the identity
    is not asked for there."""
    kind = rows.schema[key].dataType.simpleString()
    v = vectors(rows, key, vector)
    model = fit(v, components, scale, offset)
    if model is None:
        return v.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                        F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    shared = v.sparkSession.sparkContext.broadcast(model.components * model.scale())
    n, sums = model.n, model.sums
    wide = pa.decimal128(38, 0)

    def run(batches):
        from decimal import Decimal
        for b in batches:
            y = centred(matrix(b.column(1), scale, offset), n, sums)
            most = int(np.abs(y).max(initial=0))
            exact = y if y.dtype == object or most * most * max(y.shape[1], 1) < 1 << 62 else y.astype(object)
            out = y.astype(float) / n @ shared.value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Decimal(int(x)) for x in (exact * exact).sum(1)], wide), pa.array(list(out), pa.list_(pa.float64()))], ["k", "deviation", "whitened"])

    out = v.mapInArrow(run, f"k {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values])
    return out.select(F.col("k").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def by_component(white: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1; a deviation beyond 64 bits is null."""
    each = white.select(col(key), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation", "identity_error")
    return each.select(col(key), (F.col("at") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "c.whitened", "c.explained", "identity_error")
