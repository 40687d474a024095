"""Reference against decoded signals: error metrics per frame, per item and per candidate."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.functions import spectral
from framescope.operators import features, layout, recurrence
from framescope.operators.quantiles import quantiles

SONG = ("stream_id", "candidate")
DELTAS = {"snr": "snr_delta", "lsd": "lsd_delta", "perceptual_spectral": "perceptual_spectral_delta",
          "stereo_image_error": "stereo_image_delta", "flux_mse": "flux_mse_delta"}
# Weights of the two ranking scores.
SCORE_SIMPLE = {"attack_mean_delta": 6.0, "overall_mean_delta": 3.0, "lsd_delta": 0.6, "flux_mse_delta": 0.8, "snr_delta": -0.25}
SCORE_SPECTRAL = {"attack_mean_delta": 1.5, "calm_mean_delta": 1.0, "perceptual_spectral_delta": 18.0, "lsd_delta": 7.5,
                  "stereo_image_delta": 3.0, "flux_mse_delta": 0.8, "snr_delta": -0.5}
# Level, knee and steps of the shaped thresholds of the high-rate and the vocoder index.
THRESHOLD_LEVEL, THRESHOLD_KNEE, HIGH_RATE_STEPS, VOCODER_STEPS = 0.1, 0.15, 240, 960
# Leakage of masking bands to the next one above and below.
MASK_UP, MASK_DOWN = 0.1, 0.03
# Smallest values, carry from later frames and middle of the band weights of the high-rate index.
HIGH_RATE_FLOOR, HIGH_RATE_LEAST, HIGH_RATE_BACKWARD, HIGH_RATE_MIDDLE = 3.16e-10, 1e-6, 0.1, 22
# Fixed values of the vocoder index: loudness exponent, spreading to higher and lower bins, carry from earlier and later
# frames, floor under a frame's maximum.
LOUDNESS, SPREAD_UP, SPREAD_DOWN, CARRY_FORWARD, CARRY_BACKWARD, VOCODER_FLOOR = 0.2, 0.1, 0.0031623, 0.5, 0.1, 1e-8
# Coefficients of the derivative of the Bark scale.
BARK_SLOPE = (8.288e-8, 3.4225e-16, 0.009694, 5.476e-7, 1e-4)


def shaped_threshold(j, steps: int):
    return THRESHOLD_LEVEL / (THRESHOLD_KNEE ** 2 + (j * math.pi / steps) ** 2)


def perceptual_weights(bins: int, rate: float = 48000.0) -> list[float]:
    """The weights of functions.scalar.perceptual_weight over the bins of one spectrum (a constant)."""
    hz = np.arange(bins) * rate / (2.0 * (bins - 1))
    f2 = np.maximum(hz, 1.0) ** 2
    den = (f2 + 20.6 ** 2) * np.sqrt((f2 + 107.7 ** 2) * (f2 + 737.9 ** 2)) * (f2 + 12194.0 ** 2)
    db = 20 * np.log10(np.maximum(12194.0 ** 2 * f2 ** 2 / np.maximum(den, 1e-20), 1e-20)) + 2
    w = 10 ** (db / 20) * (1 + 0.45 * np.exp(-0.5 * ((hz - 3200) / 1400) ** 2))
    return (w / w.max()).tolist()


# ------------------------------------------------------------------ per frame and per window
@dataclass(frozen=True)
class Cuts:
    """Samples a frame and channel, and size and hop of the windows for spectra and for flux.  Attack frames are those of the flux, whose
    hop is a frame's length."""

    frame: int = 960
    spectrum: tuple[int, int] = (2048, 1024)
    flux: tuple[int, int] = (2048, 960)
    rate: float = 48000.0


def channel(col: str, right: bool):
    """Stereo frames hold the left channel in the first half and the right in the second."""
    half = F.floor(F.size(col) / S.d(2)).cast("int")
    return F.slice(F.col(col), half + 1 if right else F.lit(1), half)


def downmixed(frames: DataFrame, ref: str = "pcm", dec: str = "dec") -> DataFrame:
    mono = [F.zip_with(channel(c, False), channel(c, True), lambda x, y: S.d(0.5) * (x + y)).alias(out) for c, out in ((ref, "_ref"), (dec, "_dec"))]
    return frames.select(*SONG, "frame_index", *mono)


def frame_measures(frames: DataFrame, ref: str = "pcm", dec: str = "dec") -> DataFrame:
    """mse, power, envelopes of the downmix and stereo image of every frame, without a shuffle."""
    mono = {c: F.zip_with(channel(c, False), channel(c, True), lambda x, y: S.d(0.5) * (x + y)) for c in (ref, dec)}
    return frames.select(
        *SONG, "frame_index", A.mean_sq_diff(ref, dec).alias("mse"), (A.energy(ref) / F.size(ref)).alias("power"),
        A.rms(mono[ref]).alias("env_ref"), A.rms(mono[dec]).alias("env_dec"),
        F.abs(F.log1p(side_ratio(ref)) - F.log1p(side_ratio(dec))).alias("image"))


def spectral_measures(frames: DataFrame, cuts: Cuts = Cuts(), ref: str = "pcm", dec: str = "dec") -> DataFrame:
    """lsd and pse of every window of the downmix; spectra never leave the kernel."""
    size, hop = cuts.spectrum
    w = features.windows(downmixed(frames, ref, dec), {"_ref": "_r", "_dec": "_d"}, cuts.frame, size, hop, 0, SONG)
    return spectral.distances(w, "_r", "_d", size, perceptual_weights(size // 2 + 1, cuts.rate))


def flux_measures(frames: DataFrame, cuts: Cuts = Cuts(), ref: str = "pcm", dec: str = "dec") -> DataFrame:
    """flux_err and ref_flux of every window of the downmix."""
    size, hop = cuts.flux
    w = features.windows(downmixed(frames, ref, dec), {"_ref": "_r", "_dec": "_d"}, cuts.frame, size, hop, hop, SONG)
    return spectral.flux_changes(w, "_r", "_d", size)


def side_ratio(col: str):
    half = F.floor(F.size(col) / S.d(2)).cast("int")
    left, right = channel(col, False), channel(col, True)
    mid = A.energy(F.zip_with(left, right, lambda x, y: S.d(0.5) * (x + y))) / half
    side = A.energy(F.zip_with(left, right, lambda x, y: S.d(0.5) * (x - y))) / half
    return side / F.greatest(mid, S.d(1e-12))


def item_metrics(measures: DataFrame, spectra: DataFrame, flux: DataFrame) -> DataFrame:
    whole = measures.groupBy(*SONG).agg(
        (S.d(10) * S.log10(F.avg("power") / F.greatest(F.avg("mse"), S.d(1e-20)))).alias("snr"),
        F.corr("env_ref", "env_dec").alias("env_corr"), F.avg("image").alias("stereo_image_error"))
    by_window = spectra.groupBy(*SONG).agg(F.avg("lsd").alias("lsd"), F.avg("pse").alias("perceptual_spectral"))
    return whole.join(by_window, list(SONG), "left").join(flux.groupBy(*SONG).agg(F.avg("flux_err").alias("flux_mse")), list(SONG), "left")


def against_baseline(measures: DataFrame, flux: DataFrame, baseline: str, quantile: float = 0.95) -> DataFrame:
    """Mean error differences over all, attack and calm frames, and counts of better and worse ones.  Frames that start no flux window are
    not compared."""
    rises = flux.where(F.col("candidate") == baseline).select("stream_id", F.col("window").alias("frame_index"), "ref_flux")
    attack = layout.attach(rises, quantiles(rises, "ref_flux", {"_limit": quantile}))
    attack = attack.select("stream_id", "frame_index", (F.col("ref_flux") >= F.col("_limit")).alias("attack"))
    base = measures.where(F.col("candidate") == baseline).select("stream_id", "frame_index", F.col("mse").alias("_base")).join(attack, ["stream_id", "frame_index"])
    d = F.col("mse") - F.col("_base")
    return measures.join(base, ["stream_id", "frame_index"]).groupBy(*SONG).agg(
        F.avg(d).alias("overall_mean_delta"), F.avg(F.when(F.col("attack"), d)).alias("attack_mean_delta"),
        F.coalesce(F.avg(F.when(~F.col("attack"), d)), S.d(0)).alias("calm_mean_delta"),
        F.count_if(F.col("mse") < F.col("_base")).alias("frames_better_than_baseline"),
        F.count_if(F.col("_base") < F.col("mse")).alias("frames_worse_than_baseline"))


def weighted_score(weights: dict[str, float]):
    out = S.d(0)
    for k, w in weights.items():
        out = out + S.d(w) * F.col(k)
    return out


def song_metrics(frames: DataFrame, baseline: str, cuts: Cuts = Cuts(), weights=SCORE_SPECTRAL) -> DataFrame:
    """One row per song and candidate: measures, differences from the baseline candidate, score."""
    m, flux = layout.cut_lineage(frame_measures(frames)), layout.cut_lineage(flux_measures(frames, cuts))
    items = layout.cut_lineage(item_metrics(m, spectral_measures(frames, cuts), flux))
    base = items.where(F.col("candidate") == baseline).select("stream_id", *[F.col(k).alias(f"_{k}") for k in DELTAS])
    out = items.join(base, "stream_id").join(against_baseline(m, flux, baseline), list(SONG))
    for k, name in DELTAS.items():
        out = out.withColumn(name, F.col(k) - F.col(f"_{k}")).drop(f"_{k}")
    return out.withColumn("score", weighted_score(weights))


# ------------------------------------------------------------------ quality index
def mask_bands(power: np.ndarray, bands, floor: float = 0.0, down_from: int | None = None) -> np.ndarray:
    """Band means of power spectra, one row per frame, not below `floor` times a frame's largest; energy leaks as in functions.arrays.frequency_mask."""
    m = np.stack([power[:, lo:hi].sum(axis=1) / (hi - lo) for lo, hi in bands], axis=1)
    if floor:
        m = np.maximum(m, floor * m.max(axis=1, keepdims=True))
    for b in range(1, len(bands)):
        m[:, b] += MASK_UP * m[:, b - 1]
    for b in range(len(bands) - 2 if down_from is None else down_from, -1, -1):
        m[:, b] += MASK_DOWN * m[:, b + 1]
    return m


def masked_pairs(frames: DataFrame, pairs, bands, keys, gain, offset, window, floor=0.0, down_from=None, talk=0.0, backward=None, factor=0.5, average_first=True) -> DataFrame:
    """X<i>, Y<i> of every frame: power bins of reference and test of channel i with what the reference's bands mask, summed over this frame and
    the one before (the first frame has none: it stands for itself, or is left out without `average_first`).  Masking bands decay from the
    frames before, by `factor`, and with `backward` from those after; `talk` is what channels take from each other.

    A missing frame counts as zeros if the other one, another channel or the frame before tells the length, else X and Y are null; a frame of
    which all references are missing masks nothing."""
    n, channels, used = len(bands), len(pairs), bands[-1][1]
    refs = [ref for ref, _ in pairs]
    # channels leak into each other before the next frame decays, so sum and difference of the channels each follow a plain decay of their own
    apart = channels == 2 and talk and backward is None
    forward = np.repeat([factor * (1 + talk), factor * (1 - talk)], n) if apart else np.full(n * channels, factor)
    spread = np.repeat(np.arange(n), [hi - lo for lo, hi in bands])
    array = T.ArrayType(T.DoubleType())
    names = [f"{c}{i}" for i in range(channels) for c in "XY"]
    schema = T.StructType([*[frames.schema[k] for k in (*keys, "frame_index")], *[T.StructField(c, array) for c in names]])

    def there(table, columns):
        return {c: ~np.asarray(table[c].combine_chunks().is_null()) for c in columns}

    def power(table, c, width):
        return spectral.power_bins(table[c].combine_chunks(), width, used, window, gain) + offset

    def values(table):
        width = spectral.one_length([table[c].combine_chunks() for c in refs])
        m = [mask_bands(power(table, c, width), bands, floor, down_from) for c in refs]
        if apart:
            m = [(m[0] + m[1]) * (1 + talk), (m[0] - m[1]) * (1 - talk)]
        m = np.concatenate(m, axis=1)
        m[~np.any(list(there(table, refs).values()), axis=0)] = 0.0
        return m

    def use(table, y, own):
        both = [c for pair in pairs for c in pair]
        has = there(table, both)
        width = spectral.one_length([table[c].combine_chunks() for c in both])
        m = [y[:, i * n:(i + 1) * n] for i in range(channels)]
        if apart:
            m = [(m[0] + m[1]) * 0.5, (m[0] - m[1]) * 0.5]
        elif channels == 2 and talk:
            m = [m[0] + talk * m[1], m[1] + talk * m[0]]
        known = np.any(list(has.values()), axis=0)
        known[1:] |= known[:-1].copy()
        keep = own if average_first else own & np.concatenate([[False], has[refs[0]][:-1]])
        out = []
        for (ref, dec), bands_of in zip(pairs, m):
            masks = 0.1 * bands_of[:, spread]
            for c in (ref, dec):
                now = power(table, c, width) + masks
                both_frames = now.copy()
                both_frames[1:][has[ref][:-1]] += now[:-1][has[ref][:-1]]
                out.append(spectral.to_lists(both_frames[keep & known], known[keep]))
        return pa.Table.from_arrays([*[table[c].filter(pa.array(keep)) for c in (*keys, "frame_index")], *out], schema.names)

    return recurrence.decayed_segments(frames.select(*keys, "frame_index", *[c for pair in pairs for c in pair]), refs, values, use, schema, forward, backward, True, keys)


def _ratio_error(x, y):
    return F.zip_with(y, x, lambda b, a: b / a - F.log(b / a) - S.d(1))


def quality_index(frames: DataFrame, pairs, bands, keys=SONG, gain: float = 32768.0, soft_bins=(79, 80, 81)) -> DataFrame:
    """Masked band errors, 16th-root mean over frames, quality in percent; passes if not negative."""
    n, channels = len(bands), len(pairs)
    f = masked_pairs(frames, pairs, bands, keys, gain, 1e5, "raised", talk=0.01)
    used = bands[-1][1]
    soft = [1.0] * used
    for b in soft_bins:
        if b < used:
            soft[b] *= 0.1 * (0.1 if b == soft_bins[len(soft_bins) // 2] else 1.0)
    im = None
    for i in range(channels):
        e = F.zip_with(_ratio_error(F.col(f"X{i}"), F.col(f"Y{i}")), A.lits(soft), lambda v, s: v * s)
        im = e if im is None else A.add(im, e)
    per_band = A.scale(A.band_means("_im", bands), S.d(1.0 / channels))
    f = f.withColumn("_im", im).withColumn("_ef", A.energy(per_band) / S.d(n))
    err = F.pow(F.avg(F.pow("_ef", S.d(4))), S.d(1 / 16))
    out = f.groupBy(*keys).agg(err.alias("error"))
    q = S.d(100) * (S.d(1) - S.d(0.5) * F.log1p(F.col("error")) / S.d(math.log(1.13)))
    return out.withColumn("quality", q).withColumn("passed", F.col("quality") >= 0)


def high_rate_index(frames: DataFrame, pairs, bands, keys=SONG, gain: float = 32768.0) -> DataFrame:
    """err4, err16 and rms: dynamic-range floor, masking in both time directions, shaped thresholds."""
    n, channels = len(bands), len(pairs)
    f = masked_pairs(frames, pairs, bands, keys, gain, 0.0, "raised", HIGH_RATE_FLOOR, n - 3, HIGH_RATE_LEAST, HIGH_RATE_BACKWARD)
    used = bands[-1][1]
    thresh = [shaped_threshold(j, HIGH_RATE_STEPS) for j in range(used)]
    weights = [0.5 + 0.5 * math.tanh(0.5 * (HIGH_RATE_MIDDLE - b)) for b in range(n)]

    def bands_error(k):
        im = None
        for i in range(channels):
            t = A.lits([k * v for v in thresh])
            e = _ratio_error(A.add(f"X{i}", t), A.add(f"Y{i}", t))
            im = e if im is None else A.add(im, e)
        return im

    f = f.withColumn("_i2", bands_error(1.0)).withColumn("_i4", bands_error(10.0))
    w = A.lits([v / channels for v in weights])
    b2 = F.zip_with(A.band_means("_i2", bands), w, lambda e, k: e * k)
    b4 = F.zip_with(A.band_means("_i4", bands), w, lambda e, k: e * k)
    f = f.withColumn("_e2", A.total(b2) / S.d(n)).withColumn("_e4", F.pow(A.energy(b4) / S.d(n), S.d(2)))
    out = f.groupBy(*keys).agg(F.pow(F.avg(F.pow("_e2", S.d(2))), S.d(0.25)).alias("err4"),
                               F.pow(F.avg(F.pow("_e4", S.d(2))), S.d(1 / 16)).alias("err16"))
    sq = sum(A.mean_sq_diff(r, d) for r, d in pairs) / S.d(channels)
    rms = frames.groupBy(*keys).agg(F.sqrt(F.avg(sq)).alias("rms"))
    return out.join(rms, list(keys))


def index16(frames: DataFrame, ref: str, dec: str, bands, keys=SONG, gain: float = 32768.0, active: str | None = None, factor: float = 0.5) -> DataFrame:
    """Log-ratio band errors of neighbouring frame pairs, 6th-root mean of cubes."""
    mask = frames.select(*keys, "frame_index", active) if active else None
    f = masked_pairs(frames, [(ref, dec)], bands, keys, gain, 1e5, "hamming", factor=factor, average_first=False)
    if mask is not None:
        f = f.join(mask, [*keys, "frame_index"]).where(F.col(active) > 0)
    im = F.zip_with("Y0", "X0", lambda y, x: F.pow(F.log(y / x), S.d(2)))
    f = f.withColumn("_im", im).withColumn("_ef", A.mean(A.band_means("_im", bands)))
    return f.groupBy(*keys).agg(F.pow(F.avg(F.pow(F.abs("_ef"), S.d(3))), S.d(1 / 6)).alias("error"))


def feature_errors(pairs: DataFrame, ref: str, test: str, n: int, keys=("stream_id",)) -> DataFrame:
    """Column-wise squared errors; the pitch column (last but one) only counts on voiced rows (last > 0.2)."""
    keys = list(keys)
    e = F.zip_with(ref, test, lambda x, y: (x - y) * (x - y))
    voiced = F.col(ref)[n - 1] > S.d(0.2)
    cols = [F.avg(F.col("_e")[i]).alias(f"_m{i}") for i in range(n) if i != n - 2]
    out = pairs.withColumn("_e", e).groupBy(*keys).agg(
        *cols, F.avg(F.when(voiced, F.abs(F.col(ref)[n - 2] - F.col(test)[n - 2]))).alias("pitch_error"))
    names = [f"_m{i}" for i in range(n) if i != n - 2]
    return out.select(*keys, F.sqrt(sum(F.col(c) for c in names)).alias("total_error"),
                      F.sqrt(F.greatest(*names)).alias("max_error"), "pitch_error")


def highband_distortion(frames: DataFrame, ref: str, test: str, bands, cut_bin: int, top: int = 4, keys=SONG) -> DataFrame:
    """Per band: 4th-root energies floored 30 dB under the band's largest, L2 norm over time; the test
    passes where no top band is worse than the low-passed reference."""
    keys = list(keys)
    f = spectral.spectra(frames, {ref: "_r", test: "_t"}, window="raised")
    sq = {c: F.transform(c, lambda x: x * x) for c in ("_rmag", "_tmag")}
    bins = bands[-1][1]
    keep = A.lits([1.0 if k < cut_bin else 0.0 for k in range(bins)])
    low = F.zip_with(F.slice(sq["_rmag"], 1, bins), keep, lambda x, k: x * k)
    f = f.select(*keys, "frame_index", F.posexplode(F.arrays_zip(
        A.band_sums(sq["_rmag"], bands).alias("r"), A.band_sums(sq["_tmag"], bands).alias("t"), A.band_sums(low, bands).alias("l"))).alias("band", "v"))
    f = f.select(*keys, "frame_index", "band", "v.r", "v.t", "v.l").where(F.col("band") >= len(bands) - top)
    stats = f.groupBy(*keys, "band").agg((F.max("r") * S.d(1e-3)).alias("_floor"), F.count(F.lit(1)).alias("_n"))
    f = layout.attach(f, stats, [*keys, "band"])

    def root(c):
        return F.pow(F.greatest(F.col(c), F.col("_floor")), S.d(0.25))

    def norm(c):
        return S.d(1000) * F.sqrt(F.sum(F.pow((root("r") - root(c)) / F.col("_n"), S.d(2))))

    out = f.groupBy(*keys, "band").agg(norm("t").alias("test_distortion"), norm("l").alias("low_passed_distortion"))
    return out.withColumn("passed", F.col("test_distortion") <= F.col("low_passed_distortion"))


def multi_resolution_distance(frames: DataFrame, ref: str, dec: str, sizes, keys=SONG, rate: int = 16000) -> DataFrame:
    """Smoothed log-magnitude and spectral-correlation distances over several FFT sizes, plus a
    normalised squared error, on frames long enough for the largest size."""
    keys = list(keys)
    f = frames.select(*keys, "frame_index", A.pre_emphasis(ref).alias("_r"), A.pre_emphasis(dec).alias("_d"))
    t = spectral.multi_resolution_terms(f, "_r", "_d", sizes, [*keys, "frame_index"], rate)
    per_size = t.groupBy(*keys, "fft_size").agg(
        (F.sum("log_l1") / F.sum("cells")).alias("log_l1"),
        (S.d(1) - F.sum("xy") / F.sqrt(F.sum("xx") * F.sum("yy") + S.d(1e-9))).alias("decorrelation"))
    spec = per_size.groupBy(*keys).agg((F.avg(S.d(2) * F.col("log_l1") + F.col("decorrelation"))).alias("_s"))
    err = f.groupBy(*keys).agg((F.avg(A.mean_sq_diff("_r", "_d"))
                                / (F.sqrt(F.avg(A.energy("_d") / F.size("_d"))) + S.d(1e-6))).alias("_t"))
    return spec.join(err, keys).select(*keys, (S.d(10) * (F.col("_s") + S.d(10) * F.col("_t")) / S.d(13)).alias("distance"))


# ------------------------------------------------------------------ vocoder variant
def bark_per_bin(bins: int, rate: int) -> np.ndarray:
    """Width of a bin on the Bark scale: the scale's derivative times the bin's width."""
    hz = rate * np.arange(bins) / (2.0 * bins)
    a, b, c, d, e = BARK_SLOPE
    return (a * hz / (b * hz ** 4 + 1) + c / (d * hz ** 2 + 1) + e) * rate / (2.0 * bins)


def spread_powers(powers: list[np.ndarray], rate: int) -> list[np.ndarray]:
    """Power spectra, one row per frame, after spreading to higher and lower bins, not below a small share of the first one's largest bin."""
    bins = powers[0].shape[1]
    bark = bark_per_bin(bins, rate)
    up, down = SPREAD_UP ** bark, SPREAD_DOWN ** bark

    def spread(power):
        for j in range(1, bins):
            power[:, j] += up[j] * power[:, j - 1]
        for j in range(bins - 2, -1, -1):
            power[:, j] += down[j] * power[:, j + 1]
        return power

    level = spread(np.ones((1, bins)))
    out = [spread(p) / level for p in powers]
    floor = VOCODER_FLOOR * out[0].max(axis=1, keepdims=True)
    return [np.maximum(floor, x) for x in out]


def vocoder_index(frames: DataFrame, ref: str, dec: str, bands, keys=SONG, gain: float = 32768.0, rate: int = 16000) -> DataFrame:
    """err4 and err16 on loudness-compressed spectra with spreading along frequency and time."""
    keys = list(keys)
    n, used = len(bands), bands[-1][1]
    schema = T.StructType([*[frames.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_a", "_b")]])

    def values(table):
        samples = [table[c].combine_chunks() for c in (ref, dec)]
        width = spectral.one_length(samples)
        return np.concatenate(spread_powers([spectral.power_bins(c, width, used, "raised", gain) for c in samples], rate), axis=1)

    def use(table, y, own):
        every = np.ones(len(y), bool)
        return pa.Table.from_arrays([*[table[k] for k in keys], spectral.to_lists(y[:, :used], every), spectral.to_lists(y[:, used:], every)], schema.names)

    f = recurrence.decayed_segments(frames.select(*keys, "frame_index", ref, dec), [ref, dec], values, use, schema, np.full(2 * used, CARRY_FORWARD), CARRY_BACKWARD, keys=keys)
    steps = [shaped_threshold(j, VOCODER_STEPS) for j in range(used)]
    per_band = A.lits([1.0 / (hi - lo) for lo, hi in bands])

    def loud(c, k, power):
        return F.zip_with(c, A.lits([k * v for v in steps]), lambda x, t: F.pow(x + t, S.d(power)))

    def pooled(values):
        return F.zip_with(A.band_means(values, bands), per_band, lambda m, w: m * w)

    def error(k):
        return F.zip_with(loud("_b", k, LOUDNESS), loud("_a", k, LOUDNESS), lambda y, x: (y - x) * (y - x))

    # named first, else every band would make the values of all bins again
    f = f.select(*keys, error(1).alias("_d2"), error(10).alias("_d4"), loud("_a", 1, 2 * LOUDNESS).alias("_l2"))
    f = f.select(*keys, (A.total(pooled("_d2")) / S.d(n)).alias("_e2"), (A.energy(pooled("_d4")) / S.d(n)).alias("_e4"), (A.total(pooled("_l2")) / S.d(n)).alias("_t2"))
    scale = F.sqrt(F.sum("_t2"))
    return f.groupBy(*keys).agg((S.d(100) * F.pow(F.avg(F.pow("_e2", S.d(2))), S.d(0.25)) / scale).alias("err4"),
                                (S.d(100) * F.pow(F.avg(F.pow("_e4", S.d(4))), S.d(1 / 16)) / scale).alias("err16"))


def pitch_peak_error(frames: DataFrame, ref: str, dec: str, frame: int, lo: int, hi: int, keys=SONG, gain: float = 32768.0) -> DataFrame:
    """Difference of the correlation peak at the reference's best lag, over frames where it is above .7.
    Each row holds frame + hi + 1 samples ending with the frame; the first one only feeds the filter."""
    keys = list(keys)
    schema = T.StructType([*[frames.schema[k] for k in keys], T.StructField("_top", T.DoubleType()), T.StructField("_other", T.DoubleType())])
    size, step = frame + hi + 1, max(1, spectral.PIECE // (frame + hi + 1))

    def correlations(column):
        """Normalised correlations for lags 0 to hi, summed in the order of samples, and which rows have samples."""
        has = ~np.asarray(column.is_null())
        if has.any() and pc.min(pc.list_value_length(column)).as_py() < size:
            raise ValueError(f"frames of fewer than {size} samples")
        x = np.zeros((len(column), size))
        x[has] = spectral.rows_of(column.drop_null(), size, False)
        x *= gain
        x = x[:, 1:] - x[:, :-1] * 0.8
        product, power = np.zeros((2, len(x), hi + 1))
        for i in range(frame):
            past = x[:, i:i + hi + 1][:, ::-1]
            product += x[:, hi + i, None] * past
            power += past * past
        return product / np.sqrt(power[:, :1] * power + frame), has

    def body(batches):
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                (x, has), (y, also) = correlations(b.column(ref)), correlations(b.column(dec))
                at = np.arange(len(x)), lo + np.argmax(x[:, lo:], axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(x[at], mask=~has), pa.array(y[at], mask=~(has & also))], schema.names)

    f = frames.select(*keys, ref, dec).mapInArrow(body, schema)
    return f.groupBy(*keys).agg(F.avg(F.when(F.col("_top") > S.d(0.7), F.abs(F.col("_top") - F.col("_other")))).alias("pitch_error"))
