"""Signal metrics: properties, and NumPy re-statements of those that SQL cannot say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.operators import metrics as M

BANDS = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 6), (6, 9), (9, 14), (14, 22), (22, 33)]
N = 40


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(3)
    ref = rng.normal(0, 0.2, (2, N, 64))
    dec = ref + rng.normal(0, 0.02, ref.shape)
    return ref, dec


def frames(spark, ref, dec, right=None):
    rows = []
    for s in range(len(ref)):
        for i in range(ref.shape[1]):
            row = [s, "c", i, ref[s, i].tolist(), dec[s, i].tolist()]
            if right is not None:
                row += [right[0][s, i].tolist(), right[1][s, i].tolist()]
            rows.append(tuple(row))
    schema = "stream_id long, candidate string, frame_index long, pcm array<double>, dec array<double>"
    return spark.createDataFrame(rows, schema + (", r_pcm array<double>, r_dec array<double>" if right is not None else ""))


def items(f, cuts=M.Cuts(32, (64, 32), (68, 32))):
    return M.item_metrics(M.frame_measures(f), M.spectral_measures(f, cuts), M.flux_measures(f, cuts))


@pytest.mark.parametrize("cuts", [M.Cuts(32, (64, 32), (68, 32)), M.Cuts(32, (100, 13), (50, 32)), M.Cuts(960)])
def test_windows_of_the_downmix(short_segments, cuts):
    """Against loops over whole signals, for windows of odd sizes and at the full 2048:1024 and 2048:960."""
    rng = np.random.default_rng(5)
    count, half = 21, cuts.frame
    ref = rng.normal(0, 0.2, (2, count * half))
    dec = ref + rng.normal(0, 0.02, ref.shape)
    rows = [(1, "c", i, np.concatenate(ref[:, i * half:(i + 1) * half]).tolist(), np.concatenate(dec[:, i * half:(i + 1) * half]).tolist()) for i in range(count)]
    got = items(short_segments.createDataFrame(rows, "stream_id long, candidate string, frame_index long, pcm array<double>, dec array<double>"), cuts).first()
    x, y = ref.mean(axis=0), dec.mean(axis=0)

    def spectra(size, hop):
        starts = range(0, len(x) - size, hop)
        return [np.array([np.abs(np.fft.rfft(v[s:s + size] * np.hanning(size))) for s in starts]) for v in (x, y)]

    a, b = spectra(*cuts.spectrum)
    gap = np.log10(a ** 2 + 1e-12) - np.log10(b ** 2 + 1e-12)
    w = np.array(M.perceptual_weights(cuts.spectrum[0] // 2 + 1)) / np.sqrt(np.maximum(a, 1e-6))
    w /= w.mean(axis=1, keepdims=True)
    assert got["lsd"] == pytest.approx(np.sqrt(((10 * gap) ** 2).mean(axis=1)).mean(), rel=1e-9)
    assert got["perceptual_spectral"] == pytest.approx(np.sqrt(((gap * w) ** 2).mean(axis=1)).mean(), rel=1e-9)
    a, b = (np.maximum(m[1:] - m[:-1], 0) for m in spectra(*cuts.flux))
    assert got["flux_mse"] == pytest.approx(((a - b) ** 2).mean(axis=1).mean(), rel=1e-9)
    env = [np.sqrt((v.reshape(count, half) ** 2).mean(axis=1)) for v in (x, y)]
    assert got["env_corr"] == pytest.approx(np.corrcoef(*env)[0, 1], rel=1e-9)


def test_identical_signals(short_segments, signals):
    ref, _ = signals
    f = frames(short_segments, ref, ref)
    row = items(f).first()
    assert row["snr"] >= 100 and row["lsd"] < 1e-9 and row["perceptual_spectral"] < 1e-9 and row["stereo_image_error"] < 1e-9
    q = M.quality_index(f, [("pcm", "dec")], BANDS).first()
    assert q["quality"] == pytest.approx(100) and q["passed"]
    assert M.vocoder_index(f, "pcm", "dec", BANDS).first()["err4"] == pytest.approx(0, abs=1e-9)
    assert M.multi_resolution_distance(f, "pcm", "dec", [64, 32]).first()["distance"] == pytest.approx(0, abs=1e-6)


def test_spectral_distance_is_symmetric(short_segments, signals):
    ref, dec = signals
    a = items(frames(short_segments, ref, dec)).orderBy("stream_id").toPandas()
    b = items(frames(short_segments, dec, ref)).orderBy("stream_id").toPandas()
    np.testing.assert_allclose(a["lsd"], b["lsd"], rtol=1e-12)


def stereo_loop(ref, dec, talk=0.01, gain=32768.0):
    """ref, dec: (2 channels, frames, 64)."""
    w = np.hanning(64)
    X, Y = (np.abs(np.fft.rfft(v * gain * w, axis=2)) ** 2 + 1e5 for v in (ref, dec))
    xb = np.stack([X[:, :, lo:hi].mean(axis=2) for lo, hi in BANDS], axis=2)
    for i in range(xb.shape[1]):
        for b in range(1, 9):
            xb[:, i, b] += 0.1 * xb[:, i, b - 1]
        for b in range(7, -1, -1):
            xb[:, i, b] += 0.03 * xb[:, i, b + 1]
        if i:
            xb[:, i] += 0.5 * xb[:, i - 1]
        left, right = xb[0, i].copy(), xb[1, i].copy()
        xb[0, i] += talk * right
        xb[1, i] += talk * left
        for b, (lo, hi) in enumerate(BANDS):
            X[:, i, lo:hi] += 0.1 * xb[:, i, b, None]
            Y[:, i, lo:hi] += 0.1 * xb[:, i, b, None]
    X[:, 1:], Y[:, 1:] = X[:, 1:] + X[:, :-1].copy(), Y[:, 1:] + Y[:, :-1].copy()
    err = 0
    for i in range(X.shape[1]):
        ef = 0
        for lo, hi in BANDS:
            re = Y[:, i, lo:hi] / X[:, i, lo:hi]
            ef += ((re - np.log(re) - 1).sum() / ((hi - lo) * 2)) ** 2
        err += (ef / 9) ** 4
    return (err / X.shape[1]) ** (1 / 16)


def test_stereo_quality_index(short_segments, signals):
    ref, dec = signals
    rng = np.random.default_rng(9)
    r_ref = rng.normal(0, 0.3, ref.shape)
    r_dec = r_ref + rng.normal(0, 0.05, ref.shape)
    f = frames(short_segments, ref, dec, (r_ref, r_dec))
    got = M.quality_index(f, [("pcm", "dec"), ("r_pcm", "r_dec")], BANDS).orderBy("stream_id").toPandas()["error"]
    want = [stereo_loop(np.stack([ref[s], r_ref[s]]), np.stack([dec[s], r_dec[s]])) for s in range(2)]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def vocoder_loop(x, y, gain=32768.0, rate=16000):
    used, w = 33, np.hanning(64)
    X, Y = (np.abs(np.fft.rfft(v * gain * w, axis=1)) ** 2 for v in (x, y))
    f = rate * np.arange(used) / (2.0 * used)
    d = ((8.288e-8 * f) / (3.4225e-16 * f ** 4 + 1) + .009694 / (5.476e-7 * f * f + 1) + 1e-4) * rate / (2.0 * used)
    R, L = .1 ** d, 0.0031623 ** d
    norm = np.ones(used)
    for j in range(1, used):
        norm[j] = 1 + R[j] * norm[j - 1]
    for j in range(used - 2, -1, -1):
        norm[j] += L[j] * norm[j + 1]
    n = len(X)
    for m in (X, Y):
        for j in range(1, used):
            m[:, j] += R[j] * m[:, j - 1]
        for j in range(used - 2, -1, -1):
            m[:, j] += L[j] * m[:, j + 1]
        m /= norm
    for i in range(n):
        top = X[i].max()
        X[i], Y[i] = np.maximum(1e-8 * top, X[i]), np.maximum(1e-8 * top, Y[i])
        if i:
            X[i] += .5 * X[i - 1]
            Y[i] += .5 * Y[i - 1]
    for i in range(n - 3, -1, -1):
        X[i] += .1 * X[i + 1]
        Y[i] += .1 * Y[i + 1]
    th = .1 / (.15 * .15 + (np.arange(used) * np.pi / 960) ** 2)
    err4 = err16 = t2 = 0
    for i in range(n):
        e2 = e4 = t = 0
        for lo, hi in BANDS:
            w_ = 1 / (hi - lo)
            s = slice(lo, hi)
            a = ((Y[i, s] + th[s]) ** .2 - (X[i, s] + th[s]) ** .2) ** 2
            b = ((Y[i, s] + 10 * th[s]) ** .2 - (X[i, s] + 10 * th[s]) ** .2) ** 2
            e2 += (w_ * a).sum() * w_
            e4 += ((w_ * b).sum() * w_) ** 2
            t += (w_ * (X[i, s] + th[s]) ** .4).sum() * w_
        err4 += (e2 / 9) ** 2
        err16 += ((e4 / 9) ** 2) ** 2
        t2 += t / 9
    return 100 * (err4 / n) ** .25 / t2 ** .5, 100 * (err16 / n) ** (1 / 16) / t2 ** .5


def test_vocoder_index(short_segments, signals):
    ref, dec = signals
    got = M.vocoder_index(frames(short_segments, ref, dec), "pcm", "dec", BANDS).orderBy("stream_id").toPandas()
    want = np.array([vocoder_loop(ref[s], dec[s]) for s in range(2)])
    np.testing.assert_allclose(got[["err4", "err16"]].to_numpy(), want, rtol=1e-9)


def peak_loop(x, y, frame=31, lo=4, hi=32):
    def corr(v):
        f = (v[1:] - .8 * v[:-1]) * 32768
        cur = f[hi:hi + frame]
        return [cur @ f[hi - k:hi - k + frame] / np.sqrt((cur @ cur) * (f[hi - k:hi - k + frame] @ f[hi - k:hi - k + frame]) + frame) for k in range(hi + 1)]
    cx, cy = corr(x), corr(y)
    best = max(range(lo, hi + 1), key=lambda k: cx[k])
    return abs(cx[best] - cy[best]) if cx[best] > .7 else None


def test_pitch_peak_error(spark, signals):
    rng = np.random.default_rng(4)
    ref = np.stack([np.sin(2 * np.pi * (np.arange(64) + i) / (9 + i % 7)) for i in range(N)])[None]
    ref = ref + rng.normal(0, 0.02, ref.shape)      # a pure tone peaks equally at every multiple of its period
    dec = ref + rng.normal(0, 0.3, ref.shape)
    got = M.pitch_peak_error(frames(spark, ref, dec), "pcm", "dec", 31, 4, 32).first()["pitch_error"]
    want = [v for v in (peak_loop(x, y) for x, y in zip(ref[0], dec[0])) if v is not None]
    assert len(want) > 10 and got == pytest.approx(np.mean(want), rel=1e-9)
    noise, same = signals
    assert M.pitch_peak_error(frames(spark, noise, same), "pcm", "dec", 31, 4, 32).count() == 2


def counted(frames):
    """The frames, and a count of how many were made."""
    made = frames.sparkSession.sparkContext.accumulator(0)

    def body(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return frames.mapInArrow(body, frames.schema), made


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33])
def test_vocoder_index_makes_frames_twice(short_segments, signals, n):
    """Streams that end at borders of segments; the frames are made once for the segments' decays and once for the errors."""
    ref, dec = (x[:, :n] for x in signals)
    f, made = counted(frames(short_segments, ref, dec))
    got = M.vocoder_index(f, "pcm", "dec", BANDS).orderBy("stream_id").toPandas()
    np.testing.assert_allclose(got[["err4", "err16"]].to_numpy(), [vocoder_loop(ref[s], dec[s]) for s in range(2)], rtol=1e-9)
    assert made.value == 2 * 2 * n


def test_pitch_peaks_of_missing_frames_without_lambdas(spark, signals):
    """A frame's correlations are made in one kernel, not sample by sample in nested lambdas; missing frames are left out."""
    ref = np.stack([np.sin(2 * np.pi * (np.arange(64) + i) / (9 + i % 7)) for i in range(N)])[None] + signals[1][:1] / 10
    dec = ref + signals[0][:1]
    f = frames(spark, ref, dec)
    some = f.withColumn("pcm", F.when(F.col("frame_index") % 5 != 2, F.col("pcm"))).withColumn("dec", F.when(F.col("frame_index") % 7 != 3, F.col("dec")))
    out = M.pitch_peak_error(some, "pcm", "dec", 31, 4, 32)
    want = [v for i, v in enumerate(peak_loop(x, y) for x, y in zip(ref[0], dec[0])) if v is not None and i % 5 != 2 and i % 7 != 3]
    assert len(want) > 10 and out.first()["pitch_error"] == pytest.approx(np.mean(want), rel=1e-9)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_high_rate_index_makes_frames_three_times(short_segments, signals):
    """Once for the segments' decays, once for the errors, once for rms; the same with segments of 16 frames, of which the last begins with the
    last frame, as with one segment."""
    ref, dec = (x[:, :33] for x in signals)
    f, made = counted(frames(short_segments, ref, dec))
    got = M.high_rate_index(f, [("pcm", "dec")], BANDS).orderBy("stream_id").toPandas()
    assert made.value == 3 * 2 * 33
    short_segments.conf.set("spark.framescope.segmentFrames", "4096")
    want = M.high_rate_index(f, [("pcm", "dec")], BANDS).orderBy("stream_id").toPandas()
    np.testing.assert_allclose(got[["err4", "err16", "rms"]], want[["err4", "err16", "rms"]], rtol=1e-9)


def test_power_of_long_tables_is_made_in_pieces(monkeypatch):
    """No more than PIECE numbers are transformed at a time, however many frames a task gets."""
    import pyarrow as pa
    from framescope.functions import spectral
    sizes, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, **kw: sizes.append(x.size) or rfft(x, **kw))
    x = np.random.default_rng(2).normal(0, 1, (5000, 64))
    rows = [None if i % 9 == 4 else r for i, r in enumerate(x.tolist())]
    got = spectral.power_bins(pa.array(rows, pa.list_(pa.float64())), 64, 20, "raised", 3.0)
    assert len(sizes) > 1 and max(sizes) <= spectral.PIECE
    want = np.abs(rfft(x * 3.0 * np.hanning(64), axis=1)[:, :20]) ** 2
    want[4::9] = 0
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_masked_indices_make_frames_twice(short_segments, signals):
    """Once for the segments' decays and once for the errors, with one channel or two; a frame before them that is missing leaves no NaN."""
    ref, dec = (x[:, :33] for x in signals)
    f, made = counted(frames(short_segments, ref, dec, (dec, ref)))
    M.quality_index(f, [("pcm", "dec"), ("r_pcm", "r_dec")], BANDS).collect()
    assert made.value == 2 * 2 * 33
    M.index16(f, "pcm", "dec", BANDS).collect()
    assert made.value == 4 * 2 * 33
    late = frames(short_segments, ref, dec).withColumns({c: F.when(F.col("frame_index") > 0, F.col(c)) for c in ("pcm", "dec")})
    got = M.quality_index(late, [("pcm", "dec")], BANDS).orderBy("stream_id").toPandas()["error"]
    want = M.quality_index(frames(short_segments, ref[:, 1:], dec[:, 1:]), [("pcm", "dec")], BANDS).orderBy("stream_id").toPandas()["error"]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_multi_resolution_distance(spark, signals):
    ref, dec = signals
    got = M.multi_resolution_distance(frames(spark, ref, dec), "pcm", "dec", [32, 16]).orderBy("stream_id").toPandas()["distance"]

    def bank(n, fs=16000):
        i, o = np.arange(n + 1) / n * fs / 2, np.arange(n) / n * fs / 2
        e = 24.7 + .108 * i
        delta = np.abs(i[None] - o[:, None]) / e
        c = delta < .5
        r = 10 ** ((-12 * c * delta ** 2 + (1 - c) * (3 - 12 * delta)) / 10)
        return r / r.sum(axis=1, keepdims=True)

    def stft(x, n):
        p = np.pad(x, n // 2, mode="reflect")
        w = np.sin(np.pi * np.arange(n) / n) ** 2
        return np.array([np.abs(np.fft.rfft(p[k:k + n] * w)) for k in range(0, len(p) - n + 1, n // 2)])

    for s in range(2):
        emph = [[np.concatenate([[f[0]], f[1:] - .85 * f[:-1]]) for f in v[s]] for v in (ref, dec)]
        total = 0
        for n in (32, 16):
            b, l1, cells, xy, xx, yy = bank(n // 2), 0, 0, 0, 0, 0
            for x, y in zip(*emph):
                X, Y = stft(x, n), stft(y, n)
                d = np.abs(np.log(X @ b.T + 1e-9) - np.log(Y @ b.T + 1e-9))
                l1, cells, xy, xx, yy = l1 + d.sum(), cells + d.size, xy + (X * Y).sum(), xx + (X * X).sum(), yy + (Y * Y).sum()
            total += 2 * l1 / cells + 1 - xy / np.sqrt(xx * yy + 1e-9)
        x, y = (np.concatenate(e) for e in emph)
        want = 10 * (total / 2 + 10 * (((x - y) ** 2).mean() / (np.sqrt((y ** 2).mean()) + 1e-6))) / 13
        assert got[s] == pytest.approx(want, rel=1e-9)


def test_masked_index_ignores_inactive_frames(spark, signals):
    ref, dec = signals
    f = frames(spark, ref, dec).withColumn("on", (F.col("frame_index") < 10).cast("int"))
    all_ = M.index16(f, "pcm", "dec", BANDS).first()["error"]
    some = M.index16(f, "pcm", "dec", BANDS, active="on").first()["error"]
    assert some != all_ and some > 0


def test_perceptual_weights_agree(spark):
    from framescope.functions import scalar as S
    hz = [750.0 * k for k in range(33)]
    w = spark.createDataFrame([(h,) for h in hz], "hz double").select(S.perceptual_weight("hz").alias("w")).toPandas()["w"]
    np.testing.assert_allclose(w / w.max(), M.perceptual_weights(33), rtol=1e-12)


def test_arrays_frequency_mask(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    got = spark.createDataFrame([(x,)], "x array<double>").select(A.frequency_mask("x", 4).alias("y")).first()["y"]
    up = list(x)
    for i in range(1, 4):
        up[i] += .1 * up[i - 1]
    for i in range(2, -1, -1):
        up[i] += .03 * up[i + 1]
    assert got == pytest.approx(up)

