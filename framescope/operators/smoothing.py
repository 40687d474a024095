"""Smoothing, gating and tracking over frames in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import layout, recurrence
from framescope.operators.recurrence import ClampedLinear, clamped

KEYS = ("stream_id",)


def decayed_sum(frames: DataFrame, value: str, n: int, factor, out: str, backward: bool = False, keys=KEYS) -> DataFrame:
    """y_i = x_i + a*y_(i-1) (`backward`: y_(i+1)) for each of n array elements, from one end of a stream to the other.  `factor` is a
    number or a column: one number a row, or an array with one per element."""
    gain = F.lit(float(factor)) if isinstance(factor, (int, float)) else factor
    f = recurrence.decaying(frames, gain, F.coalesce(F.col(value), F.array_repeat(F.lit(0.0), n)))
    per_value = isinstance(f.schema["_gain"].dataType, T.ArrayType)
    order = "frame_index"
    if backward:
        order = "_rev"
        f = f.withColumn(order, -F.col("frame_index"))
    return recurrence.scan(f, recurrence.Decay(n, per_value), out, 0.0, keys, order).drop("_rev")


def fill_pitch_lag(frames: DataFrame, lag: str = "lag", hold: int = 10) -> DataFrame:
    """Unvoiced frames (lag 0) keep the last lag for at most `hold` frames."""
    def build(w):
        last = F.last(F.when(F.col(lag) != 0, F.col(lag)), ignorenulls=True).over(w.rowsBetween(-hold, 0))
        return F.coalesce(last, F.lit(0))
    return layout.windowed(frames, {"filled": build}, before=hold)


def smooth_pitch_lags(frames: DataFrame, lag: str = "lag", d: int = 2) -> DataFrame:
    """Triangular kernel inside groups of four frames; neighbours that are unvoiced are mirrored."""
    groups = (frames.select("stream_id", "frame_index", F.floor(F.col("frame_index") / S.d(4)).alias("grp"), F.col(lag).cast("double").alias("_l"))
              .groupBy("stream_id", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "_l"))), lambda s: s["_l"]).alias("f")))
    groups = layout.windowed(groups, {"_prev": lambda w: F.lag("f").over(w), "_next": lambda w: F.lead("f").over(w)},
                             1, 1, KEYS, "grp")

    def silent(x):
        return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), S.d(0)) == 0

    f = F.col("f")
    head, tail = F.slice(f, 1, d), F.slice(f, -d, d)
    last = F.slice("_prev", -d, d)
    last = F.when(F.col("_prev").isNull() | silent(last), F.reverse(head)).otherwise(last)
    whole_next = F.coalesce(F.size("_next"), F.lit(0)) == 4
    nxt = F.slice("_next", 1, d)
    nxt = F.when(whole_next & ~silent(nxt), nxt).otherwise(F.reverse(tail))
    line = F.concat(last, f, nxt)
    kernel = [*range(1, d + 1), d + 1, *range(d, 0, -1)]
    total = float(sum(kernel))
    smooth = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.rint(
        A.total(F.zip_with(F.slice(line, i, F.lit(2 * d + 1)), A.lits(kernel), lambda x, k: x * k)) / S.d(total)))
    out = F.when((F.size(f) < 4) | silent(f), f).otherwise(smooth)
    return groups.select("stream_id", "grp", F.posexplode(out).alias("_p", "smoothed")).select(
        "stream_id", (F.col("grp") * 4 + F.col("_p")).alias("frame_index"), "smoothed")


def lookahead_features(frames: DataFrame) -> DataFrame:
    """Tonality and bandwidth from up to three frames ahead; fewer ahead means more looked at behind."""
    def cols(w):
        ahead = F.count(F.lit(1)).over(w.rowsBetween(1, 3))
        wide = F.max("bandwidth").over(w.rowsBetween(0, 3))
        back = F.when(ahead == 0, F.max("bandwidth").over(w.rowsBetween(-6, 0)))
        for left in (1, 2, 3):
            back = back.when(ahead == left, F.max("bandwidth").over(w.rowsBetween(-(6 - left), 0)))
        return F.greatest(wide, back)

    def tone(w):
        r = w.rowsBetween(0, 3)
        return F.greatest(F.avg("tonality").over(r), F.max("tonality").over(r) - S.d(0.2))

    return layout.windowed(frames, {"smooth_bandwidth": cols, "smooth_tonality": tone}, 6, 3)


def switch_thresholds(frames: DataFrame, reach: int = 24, penalty: float = 10.0) -> DataFrame:
    """Thresholds at which now is the best moment to switch between speech and music."""
    def ahead(w):
        return F.collect_list(F.struct(F.col("activity_probability").alias("v"), F.col("music_prob").alias("m"))).over(w.rowsBetween(0, reach))

    f = layout.windowed(frames, {"_a": ahead,
                                 "_plo": lambda w: F.min("music_prob").over(w.rowsBetween(-15, -1)),
                                 "_phi": lambda w: F.max("music_prob").over(w.rowsBetween(-15, -1))}, 15, reach)
    n = F.size("_a")
    far = n > 15
    m0, v0 = F.when(far, 5).otherwise(0), F.when(far, 1).otherwise(0)
    f = f.withColumn("_m0", m0).withColumn("_v0", v0)
    vp = F.element_at("_a", F.col("_v0") + 1)["v"]
    w0 = F.greatest(S.d(0.1), vp)
    start = F.struct(w0.alias("cnt"), (w0 * F.element_at("_a", F.col("_m0") + 1)["m"]).alias("avg"), S.d(1).alias("lo"), S.d(0).alias("hi"))

    def step(s, t):
        pv = F.element_at("_a", F.col("_v0") + t + 1)["v"]
        wt = F.greatest(S.d(0.1), pv)
        return F.struct((s["cnt"] + wt).alias("cnt"), (s["avg"] + wt * F.element_at("_a", F.col("_m0") + t + 1)["m"]).alias("avg"),
                        F.least((s["avg"] - S.d(penalty) * (vp - pv)) / s["cnt"], s["lo"]).alias("lo"),
                        F.greatest((s["avg"] + S.d(penalty) * (vp - pv)) / s["cnt"], s["hi"]).alias("hi"))

    last = n - 1 - F.col("_m0")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    f = f.withColumn("_vp", vp).withColumn("_s", F.aggregate(steps, start, step))
    music = F.col("_s.avg") / F.col("_s.cnt")
    lo = F.greatest(S.d(0), F.least(music, F.col("_s.lo")))
    hi = F.least(S.d(1), F.greatest(music, F.col("_s.hi")))
    f = f.withColumn("smooth_music", music).withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_n", n)
    plo = F.greatest(S.d(0), F.least("_lo", F.coalesce("_plo", F.col("_lo"))) - S.d(0.1) * F.col("_vp"))
    phi = F.least(S.d(1), F.greatest("_hi", F.coalesce("_phi", F.col("_hi"))) + S.d(0.1) * F.col("_vp"))
    near = S.d(1) - S.d(0.1) * F.col("_n")
    return (f.withColumn("switch_low", F.when(F.col("_n") < 10, F.col("_lo") + near * (plo - F.col("_lo"))).otherwise(F.col("_lo")))
            .withColumn("switch_high", F.when(F.col("_n") < 10, F.col("_hi") + near * (phi - F.col("_hi"))).otherwise(F.col("_hi")))
            .drop("_a", "_plo", "_phi", "_m0", "_v0", "_vp", "_s", "_lo", "_hi", "_n"))


def stationarity(frames: DataFrame, bands: str, n: int, span: int = 8) -> DataFrame:
    """Per band over the last `span` frames: (sum of roots / root of span*sum) to the fourth."""
    def one(b):
        def build(w):
            r = w.rowsBetween(-(span - 1), 0)
            e = F.col(bands)[b]
            l1, l2 = F.sum(F.sqrt(e)).over(r), F.sum(e).over(r)
            return F.pow(F.least(S.d(0.99), l1 / F.sqrt(S.d(1e-15) + S.d(span) * l2)), S.d(4))
        return build
    f = layout.windowed(frames, {f"_b{b}": one(b) for b in range(n)}, before=span - 1)
    return f.withColumn("stationarity", F.array(*[F.col(f"_b{b}") for b in range(n)])).drop(*[f"_b{b}" for b in range(n)])


def spectral_variability(frames: DataFrame, log_bands: str, n: int, span: int = 8) -> DataFrame:
    """RMS distance of each of the last `span` frames to its nearest neighbour among them (frames
    before the start count as zeros)."""
    def build(w):
        got = F.collect_list(log_bands).over(w.rowsBetween(-(span - 1), 0))
        zero = F.array_repeat(F.array_repeat(F.lit(0.0), n), F.lit(span) - F.size(got))
        return F.concat(zero, got)

    f = layout.windowed(frames, {"_h": build}, before=span - 1)
    idx = F.sequence(F.lit(0), F.lit(span - 1))

    def nearest(i):
        return F.array_min(F.transform(idx, lambda j: F.when(i == j, S.d(1e15)).otherwise(
            A.total(F.zip_with(F.col("_h")[i], F.col("_h")[j], lambda x, y: (x - y) * (x - y))))))

    var = F.sqrt(A.total(F.transform(idx, nearest)) / S.d(span) / S.d(n))
    return f.withColumn("spectral_variability", var).drop("_h")


def warm_up_mean(frames: DataFrame, value, span: int, out: str) -> DataFrame:
    """Exponential mean whose weight starts at 1 and settles at 1/span."""
    a = S.d(1) / F.least(S.d(span), S.d(1) + F.col("frame_index"))
    return recurrence.scan(clamped(frames, S.d(1) - a, a * value), ClampedLinear, out, 0.0)


def falling_peak(frames: DataFrame, value, fall: float, out: str, init: float = 0.0) -> DataFrame:
    """Peak that falls by a fixed amount per frame."""
    return recurrence.scan(clamped(frames, 1.0, -fall, value), ClampedLinear, out, init)


def loudness_trackers(frames: DataFrame, loudness: str) -> DataFrame:
    """Peak tracker and the share of frames 30 dB below it."""
    f = falling_peak(frames, F.col(loudness), 0.003, "peak")
    f = layout.cut_lineage(f)
    return warm_up_mean(f, (F.col(loudness) < F.col("peak") - S.d(30)).cast("double"), 25, "low_share")


def smoothed_loss(loss: DataFrame, a: float = 0.001) -> DataFrame:
    return recurrence.scan(clamped(loss, 1 - a, S.d(a) * F.col("lost")), ClampedLinear, "loss_level", 0.0)


def decayed_max(frames: DataFrame, value, factor: float, out: str, blocked=None) -> DataFrame:
    """Backward: y_i = max(x_i, factor*y_(i+1)); a blocked row keeps its own value."""
    f = frames.withColumn("_rev", -F.col("frame_index"))
    gain = S.d(factor) if blocked is None else F.when(blocked, S.d(0)).otherwise(S.d(factor))
    return recurrence.scan(clamped(f, gain, 0.0, value), ClampedLinear, out, float("-inf"), order="_rev").drop("_rev")


def stereo_width(frames: DataFrame, frame_rate: float = 50.0) -> DataFrame:
    """Width from smoothed energies and cross energy, with a slow peak follower.
    Needs columns xx, xy, yy per frame."""
    a = min(25.0 / max(50.0, frame_rate), 1.0)

    def smooth(f, col, out, hi=float("inf")):
        return recurrence.scan(clamped(f, 1 - a, S.d(a) * F.col(col), 0.0, hi), ClampedLinear, out, 0.0)

    f = layout.cut_lineage(smooth(frames, "xx", "s_xx"))
    f = layout.cut_lineage(smooth(f, "yy", "s_yy"))
    on = F.greatest("s_xx", "s_yy") > S.d(8e-4)
    cap = F.when(on, F.sqrt("s_xx") * F.sqrt("s_yy")).otherwise(S.d(float("inf")))
    f = layout.cut_lineage(smooth(f, "xy", "s_xy", cap))
    corr = F.col("s_xy") / (S.d(1e-15) + F.sqrt("s_xx") * F.sqrt("s_yy"))
    qx, qy = F.sqrt(F.sqrt("s_xx")), F.sqrt(F.sqrt("s_yy"))
    width = F.least(S.d(1), F.sqrt(F.greatest(S.d(0), S.d(1) - corr * corr))) * F.abs(qx - qy) / (S.d(1e-15) + qx + qy)
    f = f.withColumn("_on", on).withColumn("_w", width)
    gain = F.when(F.col("_on"), S.d(1 - 1 / frame_rate)).otherwise(S.d(1))
    step = F.when(F.col("_on"), F.col("_w") / S.d(frame_rate)).otherwise(S.d(0))
    f = layout.cut_lineage(recurrence.scan(clamped(f, gain, step), ClampedLinear, "smoothed_width", 0.0))
    f = recurrence.scan(clamped(f, 1.0, F.when(F.col("_on"), S.d(-0.02 / frame_rate)).otherwise(S.d(0)),
                                F.when(F.col("_on"), F.col("smoothed_width")).otherwise(S.d(float("-inf")))), ClampedLinear, "follower", 0.0)
    return f.withColumn("stereo_width", F.least(S.d(1), S.d(20) * F.col("follower"))).drop("_on", "_w")


# Weights of a frame and its four predecessors in the level, the first and the second difference.
LEVEL_WEIGHTS = [-0.12299, 0.49195, 0.69693, 0.49195, -0.12299]
DELTA_WEIGHTS = [0.63246, 0.31623, 0.0, -0.31623, -0.63246]
SECOND_DELTA_WEIGHTS = [0.53452, -0.26726, -0.53452, -0.26726, 0.53452]


def delta_cepstrum(frames: DataFrame, cepstrum: str) -> DataFrame:
    """Level, first and second difference over a frame and its four predecessors (zeros before the start)."""
    f = layout.windowed(frames, {f"_l{k}": (lambda w, k=k: F.lag(cepstrum, k).over(w)) for k in range(1, 5)}, before=4)
    c = F.col(cepstrum)
    zero = F.transform(c, lambda x: S.d(0))
    lag = {k: F.coalesce(f"_l{k}", zero) for k in range(1, 5)}

    def mix(weights):
        out = A.scale(c, S.d(weights[0]))
        for k in range(1, 5):
            if weights[k]:  # a frame without weight counts nothing, infinite ones too
                out = A.add(out, A.scale(lag[k], S.d(weights[k])))
        return out

    return (f.withColumn("level", mix(LEVEL_WEIGHTS))
            .withColumn("delta", mix(DELTA_WEIGHTS))
            .withColumn("delta2", mix(SECOND_DELTA_WEIGHTS))
            .drop("_l1", "_l2", "_l3", "_l4"))


def activity_mask(frames: DataFrame, energy: str, stop_db: float = -70.0) -> DataFrame:
    """Five-frame moving mean (zeros outside) against the stream's largest energy."""
    f = layout.windowed(frames, {"_m": lambda w: F.sum(energy).over(w.rowsBetween(-2, 2)) / S.d(5)}, 2, 2)
    f = layout.attach(f, frames.groupBy("stream_id").agg(F.max(energy).alias("_top")), source=frames)
    return f.withColumn("active", (F.col("_m") >= F.col("_top") * S.d(10 ** (stop_db / 20))).cast("int")).drop("_m", "_top")


def mask_leading_labels(frames: DataFrame, active, label: str, length: int) -> DataFrame:
    """Label 0.5 until the first active frame of each whole sequence of `length` frames."""
    seq = F.floor(F.col("frame_index") / S.d(length))
    f = frames.withColumn("sequence", seq)
    first = f.groupBy("stream_id", "sequence").agg(
        F.min(F.when(active, F.col("frame_index"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    f = f.join(first.where(F.col("_n") == length), ["stream_id", "sequence"])
    before = F.col("_first").isNull() | (F.col("frame_index") < F.col("_first"))
    return f.withColumn("masked_label", F.when(before, S.d(0.5)).otherwise(F.col(label))).drop("_first", "_n")
