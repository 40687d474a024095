"""Column builders for frame, pitch, rate and packet-header rules.  All stay in codegen."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIFFICULTY_WEIGHTS = {"activity": 0.28, "noisiness": 0.20, "tonality": 0.16, "bandwidth": 0.14,
                      "activity_probability": 0.12, "tonality_slope": 0.10, "transient": 0.10}
SEGMENT_CLASSES = [(0.82, "killer"), (0.67, "hard"), (0.50, "active"), (0.32, "steady")]
BANDWIDTHS = ["NB", "MB", "WB", "SWB", "FB"]
AGE_STEP_TABLE = [0, 2, 3, 4, 6, 8, 12, 16]
# total rate, then low-band share for 10 ms, 20 ms, 10 ms + redundancy, 20 ms + redundancy
RATE_SPLIT_TABLE = [
    (0, 0, 0, 0, 0),
    (12000, 10000, 10000, 11000, 11000),
    (16000, 13500, 13500, 15000, 15000),
    (20000, 16000, 16000, 18000, 18000),
    (24000, 18000, 18000, 21000, 21000),
    (32000, 22000, 22000, 28000, 28000),
    (64000, 38000, 38000, 50000, 50000),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def d(x: float) -> Column:
    return F.lit(float(x))


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(d(lo), F.least(_c(x), d(hi)))


# ------------------------------------------------------------ frame telemetry
def frame_difficulty() -> Column:
    w = DIFFICULTY_WEIGHTS
    terms = {
        "activity": clamp("activity", 0, 1),
        "noisiness": clamp("noisiness", 0, 1),
        "tonality": clamp("tonality", 0, 1),
        "bandwidth": clamp(F.col("bandwidth") / d(20), 0, 1),
        "activity_probability": clamp("activity_probability", 0, 1),
        "tonality_slope": clamp(F.abs("tonality_slope") * d(4), 0, 1),
        "transient": clamp(F.col("activity") * (d(1.1) - d(0.5) * F.col("tonality")), 0, 1),
    }
    total = sum((d(w[k]) * v for k, v in list(terms.items())[1:]), d(w["activity"]) * terms["activity"])
    return F.when(F.col("analysis_valid") == 0, d(0)).otherwise(clamp(total, 0, 1))


def classify_segment(score) -> Column:
    out = None
    for limit, name in SEGMENT_CLASSES:
        test = _c(score) >= d(limit)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("easy")


def transient_weight() -> Column:
    return clamp(d(0.55) * F.col("activity") + d(0.45) * F.col("noisiness"), 0, 1)


def calm_base(base: float = 0.88) -> Column:
    calm = clamp(d(0.7) * F.col("tonality") + d(0.3) * (d(1) - F.col("noisiness")), 0, 1)
    return d(base) + d(1 - base) * calm


def target_bitrate(requested, scale) -> Column:
    return F.greatest(F.lit(6000).cast("long"), F.rint(_c(requested) * _c(scale)).cast("long"))


def raw_scale(silent, flux, onset, broadband, strong, medium, onset_limit) -> Column:
    tw = transient_weight()
    peak = F.greatest(d(1), d(1.05) + d(0.30) * (d(0.7) * tw + d(0.3) * _c(broadband)))
    return (F.when(_c(silent), d(0.75))
            .when((_c(flux) >= _c(strong)) | (_c(onset) >= _c(onset_limit)), peak)
            .when(_c(flux) >= _c(medium), F.greatest(d(1), d(1.05) + d(0.05) * tw))
            .otherwise(d(1)))


def kbps(total_bytes, frames, frame_samples, sample_rate: int = 48000) -> Column:
    return (_c(total_bytes).cast("double") * d(8) * d(sample_rate)
            / _c(frames).cast("double") / _c(frame_samples).cast("double") / d(1000))


def log10(x) -> Column:
    """-inf of zero and NaN of negative numbers, as in IEEE 754; Spark's own gives null for both."""
    x = _c(x)
    return F.when(x > d(0), F.log10(x)).when(x == d(0), d("-inf")).when(x < d(0), d("nan"))


def db20(x) -> Column:
    return d(20) * log10(x)


def power_db(x, floor: float = 1e-12) -> Column:
    return d(10) * log10(_c(x) + d(floor))


# ------------------------------------------------------------ scales
def pitch_cents(hz) -> Column:
    return F.rint(d(1200) * F.log2(_c(hz) / d(62.5) + d(1e-8))).cast("long")


def pitch_class(hz) -> Column:
    raw = F.rint(d(60) * F.log2(_c(hz) / d(62.5)))
    return F.when(_c(hz) > 0, F.greatest(d(0), F.least(raw, d(179)))).otherwise(d(0)).cast("long")


def period_cents(period) -> Column:
    return d(1200) * F.log2(d(256) / _c(period))


def lin2ulaw(x) -> Column:
    u = F.signum(_c(x)) * (d(128) * F.log(d(1) + d(255.0 / 32768.0) * F.abs(_c(x))) / d(math.log(256)))
    return F.greatest(d(0), F.least(d(128) + F.rint(u), d(255)))


def ulaw2lin(u) -> Column:
    v = _c(u) - d(128)
    return F.signum(v) * d(32768.0 / 255.0) * (F.exp(F.abs(v) / d(128) * d(math.log(256))) - d(1))


# Constants of the two perceptual scales.
BARK_STEP, BARK_HZ = 6.0, 600.0
ERB_STEP, ERB_SLOPE = 24.7, 4.37


def bark(f) -> Column:
    return d(BARK_STEP) * F.asinh(_c(f) / d(BARK_HZ))


def inv_bark(b) -> Column:
    return d(BARK_HZ) * F.sinh(_c(b) / d(BARK_STEP))


def erb(f) -> Column:
    return d(ERB_STEP) * (d(ERB_SLOPE) * _c(f) + d(1))


def inv_erb(e) -> Column:
    return (_c(e) / d(ERB_STEP) - d(1)) / d(ERB_SLOPE)


#: The same scales for numbers and numpy arrays: (from Hz, to Hz).
SCALES = {
    "bark": (lambda hz: BARK_STEP * np.arcsinh(hz / BARK_HZ), lambda b: BARK_HZ * np.sinh(b / BARK_STEP)),
    "erb": (lambda hz: ERB_STEP * (ERB_SLOPE * hz + 1), lambda e: (e / ERB_STEP - 1) / ERB_SLOPE),
}


def perceptual_weight(hz) -> Column:
    """Before division by the largest value over the bins in use."""
    f2 = F.pow(F.greatest(_c(hz), d(1)), d(2))
    num = d(12194.0 ** 2) * F.pow(f2, d(2))
    den = ((f2 + d(20.6 ** 2)) * F.sqrt((f2 + d(107.7 ** 2)) * (f2 + d(737.9 ** 2))) * (f2 + d(12194.0 ** 2)))
    a_db = d(20) * F.log10(F.greatest(num / F.greatest(den, d(1e-20)), d(1e-20))) + d(2)
    bump = d(1) + d(0.45) * F.exp(d(-0.5) * F.pow((_c(hz) - d(3200)) / d(1400), d(2)))
    return F.pow(d(10), a_db / d(20)) * bump


def spreading_decay(i, bins: int, rate: int, base: float) -> Column:
    """base = 0.1 towards high bins, 0.0031623 towards low ones."""
    f = d(rate) * _c(i) * d(1 / (2.0 * bins))
    slope = (d(8.288e-8) * f / (d(3.4225e-16) * F.pow(f, d(4)) + d(1))
             + d(0.009694) / (d(5.476e-7) * f * f + d(1)) + d(1e-4))
    return F.pow(d(base), slope * d(rate * (1 / (2.0 * bins))))


def quantizer_level(q0: int, step: int, qmax: int, age) -> Column:
    return F.least(F.lit(q0) + F.floor((F.lit(AGE_STEP_TABLE[step]) * _c(age) + F.lit(8)) / d(16)), F.lit(qmax)).cast("long")


def level_lambda(level, lo: float = 0.0002, hi: float = 0.0135, levels: int = 16) -> Column:
    return d(lo) * F.exp(_c(level) / d((levels - 1) / math.log(hi / lo)))


def rate_split(rate, frame20ms: bool, redundancy: bool) -> Column:
    """Low-band share of a total rate: piecewise linear, half of what exceeds the table.
    Integer division truncates."""
    col = 1 + int(frame20ms) + 2 * int(redundancy)
    r = _c(rate)
    top = RATE_SPLIT_TABLE[-1]
    out = None
    for a, b in zip(RATE_SPLIT_TABLE, RATE_SPLIT_TABLE[1:]):
        val = F.floor((F.lit(a[col]) * (F.lit(b[0]) - r) + F.lit(b[col]) * (r - F.lit(a[0]))) / d(b[0] - a[0]))
        out = F.when(r < b[0], val) if out is None else out.when(r < b[0], val)
    return out.otherwise(F.lit(top[col]) + F.floor((r - F.lit(top[0])) / d(2))).cast("long")


def quantize16(x) -> Column:
    return F.greatest(d(-32767), F.least(F.floor(d(0.5) + _c(x)).cast("double"), d(32767)))


def clip16(x) -> Column:
    return F.greatest(d(-32767), F.least(_c(x), d(32767)))


# ------------------------------------------------------------ packet headers
def first_byte(payload) -> Column:
    return F.conv(F.hex(F.substring(_c(payload), 1, 1)), 16, 10).cast("int")


def packet_mode(toc) -> Column:
    t = _c(toc)
    return (F.when(t.bitwiseAND(128) != 0, "transform")
            .when(t.bitwiseAND(96) == 96, "hybrid").otherwise("speech"))


def packet_bandwidth(toc) -> Column:
    t = _c(toc)
    two = F.shiftright(t, 5).bitwiseAND(3)
    names = F.array(*[F.lit(b) for b in BANDWIDTHS])
    return (F.when((t.bitwiseAND(128) != 0) & (two == 0), "NB")
            .when(t.bitwiseAND(128) != 0, F.element_at(names, two + 2))
            .when(t.bitwiseAND(96) == 96, F.when(t.bitwiseAND(16) != 0, "FB").otherwise("SWB"))
            .otherwise(F.element_at(names, two + 1)))


def packet_channels(toc) -> Column:
    return F.when(_c(toc).bitwiseAND(4) != 0, 2).otherwise(1)


def samples_per_frame(toc, rate: int = 48000) -> Column:
    t = _c(toc)
    k = F.shiftright(t, 3).bitwiseAND(3)
    step = F.pow(d(2), k.cast("double"))
    return (F.when(t.bitwiseAND(128) != 0, F.floor(d(rate) * step / d(400)))
            .when(t.bitwiseAND(96) == 96, F.when(t.bitwiseAND(8) != 0, rate // 50).otherwise(rate // 100))
            .when(k == 3, rate * 60 // 1000)
            .otherwise(F.floor(d(rate) * step / d(100)))).cast("long")


def frames_per_packet(toc, second, length) -> Column:
    code = _c(toc).bitwiseAND(3)
    return (F.when(_c(length) < 1, -1).when(code == 0, 1).when(code != 3, 2)
            .when(_c(length) < 2, -4).otherwise(_c(second).bitwiseAND(63)))


def samples_per_packet(toc, second, length, rate: int = 48000) -> Column:
    """More than 120 ms is invalid (-4)."""
    n = frames_per_packet(toc, second, length)
    total = n * samples_per_frame(toc, rate)
    return F.when(n < 0, n.cast("long")).when(total * 25 > rate * 3, F.lit(-4).cast("long")).otherwise(total)


def low_rate_copy_flag(toc, frame_byte, first_size) -> Column:
    """Does the first frame carry a low-rate copy of earlier speech?  Takes its first byte and its size; null without a size."""
    frames = F.greatest(F.floor(samples_per_frame(toc) / d(960)), F.lit(1))
    b = _c(frame_byte)

    def bit(pos):
        return F.floor(b / F.pow(d(2), pos.cast("double"))).cast("long").bitwiseAND(1)

    own = bit(F.lit(7) - frames)
    other = F.when(packet_channels(toc) == 2, bit(F.lit(6) - F.lit(2) * frames)).otherwise(0)
    return (F.when((_c(toc).bitwiseAND(128) != 0) | (_c(first_size) == 0), 0)
            .when(_c(first_size).isNotNull(), F.greatest(own, other)).cast("int"))


# ------------------------------------------------------------ predicates
def voicing_gate(voiced, rms, rms_max, pitch, female) -> Column:
    return (_c(voiced) & (_c(rms) > d(0.05) * _c(rms_max)) & (_c(pitch) >= d(65)) & (_c(pitch) <= d(500))
            & (~_c(female) | (_c(pitch) >= d(125))))


def confidence_gate(confidence, pitch, rate: int = 16000, min_period: int = 32, max_period: int = 256) -> Column:
    outside = (_c(pitch) < d(rate / max_period)) | (_c(pitch) > d(rate / min_period))
    return F.when((_c(confidence) < d(0.4)) | outside, d(0)).otherwise(_c(confidence))


def run_id_is_uuid(name) -> Column:
    return _c(name).rlike("^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$")


def within_thresholds(pairs) -> Column:
    out = F.lit(True)
    for value, limit in pairs:
        out = out & (_c(value) <= d(limit))
    return out


# ------------------------------------------------------------ reproducible draws
def draw(ident, seed: int, name: str) -> Column:
    """Uniform in [0,1): depends only on the row's id, the seed and the name of the draw."""
    digest = F.md5(F.concat_ws("|", _c(ident).cast("string"), F.lit(str(seed)), F.lit(name)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / d(4294967296)


def draw_int(ident, seed: int, name: str, n) -> Column:
    return F.floor(draw(ident, seed, name) * n).cast("long")
