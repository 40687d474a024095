"""Ordered rules that SQL cannot say, against loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framescope.operators import corpus, packetlog, planner, smoothing


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    rows = [(s, i, float(rng.random()), float(rng.random())) for s, n in [(1, 150), (2, 30), (3, 4)] for i in range(n)]
    return pd.DataFrame(rows, columns=["stream_id", "frame_index", "activity_probability", "music_prob"])


def switch_loop(v, m, i, reach=24):
    av, am = v[i:i + reach + 1], m[i:i + reach + 1]
    n = len(av)
    m0, v0 = (5, 1) if n > 15 else (0, 0)
    vp = av[v0]
    cnt = max(.1, vp)
    avg = cnt * am[m0]
    lo, hi = 1.0, 0.0
    t = 1
    while m0 + t < n:
        pv = av[v0 + t]
        lo = min((avg - 10 * (vp - pv)) / cnt, lo)
        hi = max((avg + 10 * (vp - pv)) / cnt, hi)
        cnt += max(.1, pv)
        avg += max(.1, pv) * am[m0 + t]
        t += 1
    music = avg / cnt
    lo, hi = max(0.0, min(music, lo)), min(1.0, max(music, hi))
    if n < 10:
        past = m[max(0, i - 15):i]
        a, b = min([lo, *past]), max([hi, *past])
        a, b = max(0.0, a - .1 * vp), min(1.0, b + .1 * vp)
        lo, hi = lo + (1 - .1 * n) * (a - lo), hi + (1 - .1 * n) * (b - hi)
    return music, lo, hi


def test_switch_thresholds(short_segments, frame):
    got = smoothing.switch_thresholds(short_segments.createDataFrame(frame)).toPandas().sort_values(["stream_id", "frame_index"])
    want = []
    for _, g in frame.groupby("stream_id"):
        v, m = g["activity_probability"].tolist(), g["music_prob"].tolist()
        want += [switch_loop(v, m, i) for i in range(len(v))]
    np.testing.assert_allclose(got[["smooth_music", "switch_low", "switch_high"]].to_numpy(), np.array(want), atol=1e-9)


def test_bucket_level_is_never_negative(short_segments, frame):
    df = short_segments.createDataFrame(frame).withColumn("x", (F.col("music_prob") * 400 - 200).cast("int"))
    got = packetlog.leaky_bucket(df, F.col("x")).toPandas().sort_values(["stream_id", "frame_index"])
    assert (got["level"] >= 0).all() and (got["adjust"] >= 0).all()
    for _, g in got.groupby("stream_id"):
        level = 0
        for x, lv, adj in zip(g["music_prob"] * 400 - 200, g["level"], g["adjust"]):
            nxt = level + int(x)
            assert adj == max(0, -nxt) // 64
            level = max(0, nxt)
            assert lv == level


def test_steal_reach_covers_the_curve():
    r = planner.steal_reach()
    assert 1 - 0.6 * 0.85 ** (r - 1) >= 0.98 - 1e-12


def test_plan_properties(spark, sf):
    from framescope.plans import load
    p = load.QUERIES["h05_current_plan"](spark, sf).toPandas()
    assert p["scale"].between(0.5, 1.35).all() and (p["target_bitrate_bps"] >= 6000).all()
    assert (p.groupby("stream_id")["scale"].mean() - 1).abs().max() < 0.05
    e = load.QUERIES["h05_early_plan"](spark, sf).toPandas()
    np.testing.assert_allclose(e.groupby("stream_id")["scale"].mean(), 1, atol=1e-5)
    w = load.QUERIES["w08_tonal_steal"](spark, sf).toPandas()
    assert w["ceiling"].min() >= 0.40


def test_augmented_signal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 20000, 64).tolist(), rng.normal(0, 5000, 64).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, speech array<double>, noise array<double>")
    got = corpus.apply_augmentation(corpus.augmentation(df, F.col("id"), 7, 64), "speech", "noise").toPandas()
    again = corpus.augmentation(df, F.col("id"), 7, 64).toPandas()
    assert got["speech_gain"].tolist() == again["speech_gain"].tolist()
    for r in got.itertuples():
        x, n = np.array(r.speech), np.array(r.noise)
        if r.stays_clean:
            want = x
        else:
            want = np.where(np.arange(64) < r.start, 0, x * r.speech_gain) + n * r.noise_gain
            want = np.clip(want, -32767, 32767) if r.clips else want
            want = np.floor(.5 + want) if r.quantises else want
        np.testing.assert_allclose(r.mixed, want, atol=1e-9)
    assert 0.1 < got["stays_clean"].mean() < 0.4 and 0.1 < got["clips"].mean() < 0.4


def test_no_silence_gate_run_is_longer_than_twenty(spark, sf):
    from framescope.plans import load
    g = load.QUERIES["w16_silence_gate"](spark, sf).toPandas().sort_values(["stream_id", "frame_index"])
    for _, s in g.groupby("stream_id"):
        run = 0
        for v in s["gated"]:
            run = run + 1 if v else 0
            assert run <= 20
