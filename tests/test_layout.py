"""The layout kit against plain pandas, with one stream holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framescope.operators import layout, recurrence
from framescope.operators.quantiles import quantiles, quantiles_of


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    rows = []
    for sid, n in [(1, 700), (2, 90), (3, 1), (4, 17)]:
        for i in range(n):
            rows.append((sid, i, float(rng.normal()), int(rng.integers(-50, 50)), bool(rng.random() < 0.2)))
    return pd.DataFrame(rows, columns=["stream_id", "frame_index", "x", "k", "on"])


def by_stream(out, col):
    return out.sort_values(["stream_id", "frame_index"])[col].to_numpy()


def test_windowed_crosses_segments(short_segments, frame):
    df = short_segments.createDataFrame(frame)
    got = layout.windowed(df, {"m": lambda w: F.max("x").over(w.rowsBetween(-20, -2))}, before=20).toPandas()
    want = frame.groupby("stream_id")["x"].transform(lambda s: s.shift(2).rolling(19, min_periods=1).max())
    np.testing.assert_allclose(by_stream(got, "m"), want.to_numpy())
    assert len(got) == len(frame)


@pytest.mark.parametrize("kind,fn", [("sum", "cumsum"), ("max", "cummax"), ("min", "cummin")])
def test_running(short_segments, frame, kind, fn):
    df = short_segments.createDataFrame(frame)
    got = layout.running(df, {"r": (kind, F.col("k"))}).toPandas()
    want = getattr(frame.groupby("stream_id")["k"], fn)()
    np.testing.assert_array_equal(by_stream(got, "r"), want.to_numpy())


def test_running_last_and_next(short_segments, frame):
    df = short_segments.createDataFrame(frame)
    at = F.when(F.col("on"), F.col("frame_index"))
    got = layout.running(df, {"before": ("last", at)}, exclusive=True)
    got = layout.running(got, {"after": ("first", at)}, reverse=True, exclusive=True).toPandas()
    pos = frame["frame_index"].where(frame["on"])
    g = pos.groupby(frame["stream_id"])
    before = g.transform(lambda s: s.ffill().shift(1))
    after = g.transform(lambda s: s[::-1].ffill().shift(1)[::-1])
    np.testing.assert_array_equal(np.nan_to_num(by_stream(got, "before"), nan=-1), before.fillna(-1).to_numpy())
    np.testing.assert_array_equal(np.nan_to_num(by_stream(got, "after"), nan=-1), after.fillna(-1).to_numpy())


def test_clamped_linear_scan(short_segments, frame):
    df = short_segments.createDataFrame(frame)
    got = recurrence.scan(recurrence.clamped(df, 0.9, F.col("x"), -1.0, 2.0), recurrence.ClampedLinear, "y", 0.5).toPandas()
    want = []
    for _, g in frame.groupby("stream_id"):
        y = 0.5
        for x in g["x"]:
            y = min(2.0, max(-1.0, 0.9 * y + x))
            want.append(y)
    np.testing.assert_allclose(by_stream(got, "y"), want, atol=1e-12)


def test_finite_state_scan(short_segments, frame):
    df = short_segments.createDataFrame(frame)
    for s in range(3):
        df = df.withColumn(f"_to{s}", ((F.col("k") + 50 + s * (F.col("k") % 2 + 1)) % 3).cast("long"))
    got = recurrence.scan(df, recurrence.FiniteState(3), "state", 1).toPandas()
    want = []
    for _, g in frame.groupby("stream_id"):
        s = 1
        for k in g["k"]:
            s = int(np.fmod(k + 50 + s * (np.fmod(k, 2) + 1), 3))
            want.append(s)
    np.testing.assert_array_equal(by_stream(got, "state"), want)


def test_quantiles_are_exact(spark, frame):
    ps = {"a": 0.94, "b": 0.5, "c": 0.0, "d": 1.0}
    got = quantiles(spark.createDataFrame(frame), "x", ps).toPandas().sort_values("stream_id")
    for name, p in ps.items():
        want = frame.groupby("stream_id")["x"].apply(lambda s, p=p: np.quantile(s, p)).to_numpy()
        np.testing.assert_allclose(got[name].to_numpy(), want, atol=1e-12)


def test_quantiles_of_ties_nulls_and_index(spark, frame):
    df = spark.createDataFrame(frame).withColumn("some", F.when(F.col("on"), F.col("k")))
    got = quantiles_of(df, {"m": (F.col("some"), 0.5), "i": (F.col("k"), ("at", 0.9))}).toPandas().sort_values("stream_id")
    med = frame[frame["on"]].groupby("stream_id")["k"].median().reindex([1, 2, 3, 4]).to_numpy()
    np.testing.assert_allclose(got["m"].to_numpy(dtype=float), med)
    idx = frame.groupby("stream_id")["k"].apply(lambda s: np.sort(s)[int(0.9 * len(s))]).to_numpy()
    np.testing.assert_allclose(got["i"].to_numpy(), idx)


def test_rank_all_with_ties(spark, frame):
    df = spark.createDataFrame(frame.assign(id=np.arange(len(frame))))
    got = layout.rank_all(df, F.col("k"), F.col("id"), "r").toPandas().sort_values("id")
    want = frame.assign(id=np.arange(len(frame))).sort_values(["k", "id"]).assign(r=np.arange(1, len(frame) + 1)).sort_values("id")
    np.testing.assert_array_equal(got["r"].to_numpy(), want["r"].to_numpy())


def test_ranks_of_close_values_with_close_ties(spark):
    """A third of the rows has one value, the others are close, and so are the ties; no range holds much more than its share."""
    rng = np.random.default_rng(5)
    n = 120_000
    f = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, 1, 2), "v": np.where(rng.random(n) < 0.33, 7.0, 48000 + rng.random(n) * 1e-9), "id": rng.permutation(n) * 1e-9})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(f)
        held = layout.in_ranges(df, ["g", "v", "id"]).groupBy("_range").count().toPandas()["count"]
        assert len(held) == 8 and held.max() < 1.5 * held.mean()
        got = layout.rank_all(df, F.col("v"), F.col("id"), "r", ("g",)).toPandas().sort_values(["g", "v", "id"])
        assert (got["r"].to_numpy() == got.groupby("g").cumcount().to_numpy() + 1).all() and len(got) == n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranks_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, None, 2), (4, float("nan"), 3), (4, 2.0, 4), (4, -1.0, 5)], "g int, v double, id int")
    got = {r["id"]: r["r"] for r in layout.rank_all(df, F.col("v"), F.col("id"), "r", ("g",)).collect()}
    assert got == {2: 1, 1: 2, 5: 1, 4: 2, 3: 3}
    assert layout.rank_all(df.limit(0), F.col("v"), F.col("id"), "r").count() == 0


def test_dense_index(spark, frame):
    f = frame.assign(t=frame["frame_index"] * 7 + 3).drop(columns="frame_index").sample(frac=1, random_state=1)
    got = layout.dense_index(spark.createDataFrame(f), ["stream_id"], F.floor(F.col("t") / 100.0), ["t"]).toPandas()
    assert (got["frame_index"] * 7 + 3 == got["t"]).all()


def test_attach_matches_plain_join(short_segments, frame):
    df = short_segments.createDataFrame(frame)
    got = layout.stream_stats(df, [F.avg("x").alias("mu")]).toPandas()
    want = frame.groupby("stream_id")["x"].transform("mean")
    np.testing.assert_allclose(by_stream(got, "mu"), want.to_numpy())


def test_no_window_needs_a_whole_stream(short_segments, frame):
    """Every exchange of a windowed plan hashes on the segment too."""
    df = short_segments.createDataFrame(frame)
    out = layout.windowed(df, {"m": lambda w: F.lag("x").over(w)}, before=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_seg" in plan.split("hashpartitioning")[1].split(")")[0]


def test_decaying_arrays_have_no_reach(short_segments, frame):
    """One loud frame before hundreds of silent ones keeps its tail, in both directions and with a gain per value."""
    df = short_segments.createDataFrame([(s, i, [1e3, 1.0] if i == 5 else [0.0, 0.0]) for s in (1, 2) for i in range(300)], "stream_id long, frame_index long, x array<double>")
    from framescope.operators.smoothing import decayed_sum
    tail = {r["frame_index"]: r["y"] for r in decayed_sum(df, "x", 2, 0.5, "y").where("stream_id = 2").collect()}
    assert tail[299] == [1e3 * 0.5 ** 294, 0.5 ** 294] and tail[4] == [0.0, 0.0]
    back = {r["frame_index"]: r["y"][0] for r in decayed_sum(df, "x", 2, 0.9, "y", backward=True).where("stream_id = 1").collect()}
    assert np.isclose(back[0], 1e3 * 0.9 ** 5, rtol=1e-14) and back[6] == 0.0
    gains = F.when(F.col("frame_index") == 100, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.99)))
    each = {r["frame_index"]: r["y"] for r in decayed_sum(df, "x", 2, gains, "y").where("stream_id = 1").collect()}
    assert each[99][0] == 1e3 and each[100][0] == 0.0 and np.isclose(each[299][1], 0.99 ** 293, rtol=1e-12)


def test_scan_over_small_batches_and_given_starts(short_segments, frame):
    """Groups that go on over several Arrow batches, streams with a carried state, null keys."""
    short_segments.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(s, i, float((7 * i + (s or 0)) % 11 - 5)) for s in (1, 2, None) for i in range(40)]
        df = short_segments.createDataFrame(rows, "stream_id long, frame_index long, x double")
        starts = short_segments.createDataFrame([(2, 100.0)], "stream_id long, _in double")
        got = {(r["stream_id"], r["frame_index"]): r["y"] for r in recurrence.scan(recurrence.clamped(df, 1.0, F.col("x"), 0.0), recurrence.ClampedLinear, "y", 3.0, starts=starts).collect()}
    finally:
        short_segments.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in (1, 2, None):
        y = 100.0 if s == 2 else 3.0
        for i in range(40):
            y = max(0.0, y + float((7 * i + (s or 0)) % 11 - 5))
            assert got[s, i] == y
