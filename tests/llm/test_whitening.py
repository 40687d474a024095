from fractions import Fraction

import numpy as np
import pytest

from framescope.llm import whitening
from framescope.llm.whitening import Spectrum, by_component, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, k string, whitened int, deviation int"


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "k", 3, 4) for i, v in rows], SCHEMA)
    return make


def test_roots_and_updates_equal_a_direct_solution():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 17, 64):
        d, v = np.sort(rng.uniform(0, 10, width)), rng.normal(size=width)
        if width > 3:
            d[3:6] = d[3]  # equal eigenvalues
            d, v[1] = np.sort(d), 0.0  # a direction that is not touched
        basis = np.linalg.qr(rng.normal(size=(width, width)))[0]
        whole = basis @ np.diag(d) @ basis.T + np.outer(v, v)
        values, vectors = rank_one(d, basis, v)
        assert np.allclose(values, np.linalg.eigvalsh(whole), rtol=1e-12, atol=1e-12)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, whole, atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(width), atol=1e-13)
    d, z2 = np.array([0.0, 1e-9, 1.0]), np.array([1e-3, 1e-20, 4.0])
    origin, x = secular_roots(d, z2)
    assert np.all(np.diff(d[origin] + x) > 0)
    assert np.allclose(np.sort(d[origin] + x), np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))), atol=1e-14)


@pytest.mark.parametrize("kind", ["full", "few", "same", "repeated", "line"])
def test_merged_spectra_equal_the_covariance(kind):
    rng = np.random.default_rng(1)
    x = {"full": rng.normal(size=(400, 9)) * 300, "few": rng.normal(size=(4, 9)) * 300, "same": np.ones((50, 9)), "repeated": np.repeat(rng.normal(size=(3, 9)), 90, 0),
         "line": rng.normal(size=(300, 1)) * np.arange(9)}[kind] + 100_000
    whole = Spectrum.empty(9)
    for part in np.array_split(x, 3):
        s = Spectrum.empty(9)
        for row in part:
            s.add(row)
        whole.merge(s)
    v = np.cov(x.T, bias=True)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0), rtol=1e-14)
    assert np.allclose(whole.basis @ np.diag(whole.values) @ whole.basis.T, v, atol=1e-9 * max(v.max(), 1e-3))


def check(rows, got, components):
    kept = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    width = max(len(v) for _, v in kept)
    kept = [(i, v) for i, v in kept if len(v) == width]
    x = np.floor(1024 * np.array([np.array(v, np.float32) for _, v in kept], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    y = (x * n - sums) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    assert len(got) == n * min(components, width)
    exact = {}
    for (i, _), row in zip(kept, x.tolist(), strict=True):
        exact.setdefault(i, set()).add(int(sum(Fraction(n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True))))
    for r in got:
        assert r.n == n and r.deviation in exact[r.vec_id] and r.identity_error < 1e-4
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) <= 1e-9
    for c in range(len(e)):
        mine = {}
        for r in got:
            if r.component == c + 1:
                mine.setdefault(r.vec_id, []).append(r.whitened)
        if e[c] > 1e-9 * e[0]:
            want = {}
            for (i, _), p in zip(kept, y @ u[:, c] / np.sqrt(e[c]), strict=True):
                want.setdefault(i, []).append(p)
            flat = lambda d: np.concatenate([np.sort(np.abs(d[i])) for i in sorted(d, key=str)])
            assert np.allclose(flat(mine), flat(want), atol=1e-6)
            signs = {np.sign(a[0] * b[0]) for i, a in mine.items() if len(a) == 1 and abs((b := want[i])[0]) > 1e-6}
            assert len(signs) == 1
        else:
            assert all(w == 0 for ws in mine.values() for w in ws)


def test_equals_numpy(table, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * np.linspace(0.02, 0.5, 12)).tolist()) for i in range(600)]
    rows += [(5, rows[5][1]), (700, None), (701, [0.1] * 11), (702, [None] + [0.1] * 11), (703, [float("nan")] * 12), (704, [float("inf")] + [0.0] * 11), (None, rows[9][1]), (705, [])]
    check(rows, by_component(whiten(table(rows).repartition(5))).collect(), 8)


def test_fewer_dimensions_and_directions(table):
    rng = np.random.default_rng(3)
    rows = [(i, [a, 2 * a, 0.5]) for i, a in enumerate(rng.integers(-8, 8, 50) / 4)]
    check(rows, by_component(whiten(table(rows))).collect(), 8)
    same = by_component(whiten(table([(1, [0.5, 0.25]), (2, [0.5, 0.25])]))).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)] * 2


def test_large_entries_are_exact(table):
    rows = [(i, [float(np.float32(v)), 1.0]) for i, v in enumerate((1e12, -3e12, 7.0, 2.5e12))]
    got = {r.vec_id: int(r.deviation) for r in whiten(table(rows)).collect()}
    x = [[int(np.floor(1024 * float(np.float32(v)))) + 100_000 for v in vs] for _, vs in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((4 * a - b) ** 2 for a, b in zip(row, s, strict=True)) for i, row in enumerate(x)}
    assert all(r.deviation is None for r in by_component(whiten(table(rows))).collect())


def test_empty_tables(table):
    assert by_component(whiten(table([]))).count() == 0
    assert by_component(whiten(table([(1, None), (2, [])]))).count() == 0
