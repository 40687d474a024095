import numpy as np
import pytest

from framescope.llm import quality
from framescope.llm.registry import QUERIES


def test_statistics_by_hand():
    s = dict(zip(quality.STATISTICS, quality.statistics_of("Ab ab ab !! 12\nx | y\nx | y"), strict=True))
    want = {"words": np.log1p(11), "distinct_share": 7 / 11, "repeat_share": 1 / 11, "upper_share": 1 / 10, "line_repeat": 1 / 3,
            "exclaim_share": 2 / 26, "symbol_share": 4 / 26, "digit_share": 2 / 26, "letter_share": 10 / 26}
    assert {k: s[k] for k in want} == pytest.approx(want)
    assert all(np.isfinite(quality.statistics_of("")))


def test_rules_of_a_known_concept():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit_rules(x[:2000], y[:2000])
    p = 1 / (1 + np.exp(-(quality.matches(x[2000:], model.rules) @ np.array(model.weights) + model.intercept)))
    assert ((p >= 0.5) == y[2000:]).mean() > 0.97
    assert 0 < len(model.rules) < 250 and len(model.describe()) == len(model.rules)


def test_lasso_is_sparse_and_stationary():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 2, (500, 30)).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * m[:, 0] - 2 * m[:, 1])))).astype(float)
    w, b = quality.lasso_logistic(m, y, 0.02, 3000)
    grad = m.T @ (1 / (1 + np.exp(-(m @ w + b))) - y) / 500
    assert 0 < (np.abs(w) > 1e-8).sum() < 15
    assert np.all(np.abs(grad) <= 0.02 + 1e-4)
    assert np.allclose(grad[np.abs(w) > 1e-6], -0.02 * np.sign(w[np.abs(w) > 1e-6]), atol=1e-4)


def test_column_equals_numpy(frame, odd_rows, prose):
    rng = np.random.default_rng(2)
    x = np.array([quality.statistics_of(prose(int(n), i)) for i, n in enumerate(rng.integers(1, 80, 300))])
    model = quality.fit_rules(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    rows = odd_rows + [(i, prose(20, i)) for i in range(20)]
    got = quality.score(frame(rows), model, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        s = np.array([quality.statistics_of(r["text"] or "")])
        assert r["score"] == pytest.approx(float(1 / (1 + np.exp(-(quality.matches(s, model.rules) @ np.array(model.weights) + model.intercept)))[0]), abs=1e-5)
    kept = quality.keep_good(frame(rows), model, 0.5)
    assert kept.columns == frame(rows).columns
    assert kept.count() == sum(r["score"] >= 0.5 for r in got)


def test_constants_and_no_rows(frame, odd_rows):
    model = quality.fit_rules(np.zeros((0, len(quality.STATISTICS))), np.array([]))
    assert {r["score"] for r in quality.score(frame(odd_rows), model).collect()} == {0.5}
    assert quality.score(frame([]), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    r = QUERIES["op10_rule_ensemble_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.97
