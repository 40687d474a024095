"""Expressions over array columns: one array is one frame, so sizes are fixed and small."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.functions.scalar import SCALES

# Band edges in Hz or bins, and band weights.
BARK_EDGES_HZ = [0, 100, 300, 630, 1270, 2700, 4400, 7700, 15500, 24000]
FLUX_WEIGHTS = [0.30, 0.50, 0.80, 1.20, 1.50, 1.40, 0.90, 0.50, 0.20]
INDEX_BANDS = [0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 68, 80, 96, 120, 156, 200]
HIGH_RATE_BANDS = [0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 68, 80, 96, 120, 156, 200,
                   240, 280, 320, 360, 400, 440, 480]
INDEX16_BANDS = [0, 2, 4, 6, 7, 9, 11, 13, 15, 18, 22, 26, 31, 36, 43, 51, 60, 75]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x)


def energy(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x * x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def mean(arr) -> Column:
    return total(arr) / F.size(_c(arr))


def scale(arr, k) -> Column:
    return F.transform(_c(arr), lambda x: x * k)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def mean_sq_diff(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))) / F.size(_c(a))


def lits(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bark_ranges(fft_size: int, rate: float = 48000.0, edges=BARK_EDGES_HZ) -> list[tuple[int, int]]:
    """First bin at or above each edge; a band holds at least one bin."""
    last = fft_size // 2 + 1

    def first_at(hz):
        return min(last, -int(-hz * fft_size // rate))
    out = []
    for lo, hi in zip(edges, edges[1:]):
        start = first_at(lo)
        out.append((start, max(first_at(hi), start + 1)))
    return out


def ranges(edges) -> list[tuple[int, int]]:
    return list(zip(edges, edges[1:]))


def band_sums(arr, bands) -> Column:
    return F.array(*[total(F.slice(_c(arr), lo + 1, hi - lo)) for lo, hi in bands])


def band_means(arr, bands) -> Column:
    return F.array(*[total(F.slice(_c(arr), lo + 1, hi - lo)) / float(hi - lo) for lo, hi in bands])


def spread_bands(bands_arr, bands) -> Column:
    """Back from bands to bins."""
    return F.flatten(F.array(*[F.array_repeat(_c(bands_arr)[i], hi - lo) for i, (lo, hi) in enumerate(bands)]))


def frequency_mask(bands_arr, n: int, up: float = 0.1, down: float = 0.03, down_from: int | None = None) -> Column:
    """Energy leaks to the next band above by `up`, then to the one below by `down`.
    `down_from`: highest band index that receives from above."""
    last = n - 2 if down_from is None else down_from
    rise = F.aggregate(_c(bands_arr), F.array().cast("array<double>"),
                       lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) * up)))
    fixed = F.slice(rise, last + 2, n - last - 1)
    part = F.reverse(F.slice(rise, 1, last + 1))
    fall = F.aggregate(part, F.array(fixed[0]), lambda a, x: F.concat(a, F.array(x + F.element_at(a, -1) * down)))
    return F.concat(F.reverse(F.slice(fall, 2, last + 1)), fixed)


def cross_talk(own, other, share: float = 0.01) -> Column:
    return F.zip_with(_c(own), _c(other), lambda x, y: x + y * share)


def positive_diff(cur, prev) -> Column:
    return F.zip_with(_c(cur), _c(prev), lambda x, y: F.greatest(x - y, F.lit(0.0)))


def pre_emphasis(arr, last=None, k: float = 0.85) -> Column:
    """x_i - k*x_(i-1); `last` is the sample before the frame (0 if there is none)."""
    n = F.size(_c(arr))
    prev = F.concat(F.array(F.lit(0.0) if last is None else last), F.slice(_c(arr), F.lit(1), n - 1))
    return F.zip_with(_c(arr), prev, lambda x, p: x - p * k)


def rms(arr, floor: float = 0.0) -> Column:
    return F.sqrt(energy(arr) / F.size(_c(arr)) + F.lit(floor))


def loudness_db(arr, floor: float = 1e-12) -> Column:
    return F.lit(20.0) * F.log10(rms(arr, floor))


def entropy_share(arr, n: int) -> Column:
    """Normalised entropy of non-negative values: 0 one band, 1 flat."""
    all_ = total(arr) + F.lit(1e-12)
    import math
    return -total(F.transform(_c(arr), lambda x: x / all_ * F.log2(x / all_ + F.lit(1e-12)))) / F.lit(math.log2(n))


def autocorrelation(signal, frame: int, max_lag: int, floor: float) -> Column:
    """Normalised correlation for lags 0..max_lag; the last `frame` samples are the frame."""
    x = _c(signal)
    cur = F.slice(x, max_lag + 1, frame)

    def at(lag):
        past = F.slice(x, F.lit(max_lag + 1) - lag, F.lit(frame))
        return dot(cur, past) / F.sqrt(energy(cur) * energy(past) + F.lit(floor))

    return F.transform(F.sequence(F.lit(0), F.lit(max_lag)), at)


def distance(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def compressed_log(arr, first: float = -2.0, floor: float = 1e-9, drop: float = 0.0, follow_drop: float = 2.5) -> Column:
    """Running over bands: not below (largest so far - drop) nor a follower falling 2.5 per band."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(first).alias("top"), F.lit(first).alias("fol"))

    def step(a, x):
        v = F.greatest(a.top - drop, a.fol - follow_drop, F.log10(x + F.lit(floor)))
        return F.struct(F.concat(a.out, F.array(v)).alias("out"), F.greatest(a.top, v).alias("top"),
                        F.greatest(a.fol - follow_drop, v).alias("fol"))

    return F.aggregate(_c(arr), start, step, lambda a: a.out)


def log_bands(arr) -> Column:
    return F.transform(_c(arr), lambda x: F.log(x + F.lit(1e-9)))


def matvec(arr, rows) -> Column:
    """Small constant matrix times an array column."""
    return F.array(*[dot(_c(arr), lits(r)) for r in rows])


def dct_rows(n: int, keep: int | None = None) -> list[list[float]]:
    """Orthonormal DCT-II."""
    import math
    out = []
    for k in range(keep or n):
        s = math.sqrt((1.0 if k == 0 else 2.0) / n)
        out.append([s * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)])
    return out


def filter_bank(num_bands: int, n_fft: int, rate: int, scale_name: str = "bark") -> list[list[float]]:
    """Hat functions over the FFT bins, one per centre: each is 1 at its own centre, 0 at the others and linear between them.
    Inner centres are whole steps of (top / num_bands) on the perceptual scale, the outer ones the ends of the spectrum."""
    import numpy as np
    to_scale, to_hz = SCALES[scale_name]
    bins = np.arange(n_fft // 2 + 1)
    low, high = to_scale(0.0), to_scale(rate / 2)
    inner = to_hz(low + (high - low) * np.arange(1, num_bands - 1) / num_bands)
    centres = np.concatenate([[0.0], inner * n_fft / rate, [bins[-1]]])
    return [np.interp(bins, centres, peak).tolist() for peak in np.eye(num_bands)]
