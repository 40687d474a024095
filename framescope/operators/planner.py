"""Offline bitrate plans: one target per frame from telemetry and signal features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import features, layout
from framescope.operators.quantiles import quantiles, quantiles_of

# Fixed values.
PEAK_MIN, PEAK_MAX = 1.05, 1.35
STEAL_FLOOR, STEAL_RECOVERY, STEAL_CUTOFF = 0.40, 0.85, 0.98
TONAL_LIMIT, TONAL_CEILING = 0.35, 0.85
QUIET_MAX, ABSOLUTE_SILENCE_DB = 1.50, -75.0
PRE_ECHO_MS, TRANSITION_MS = 40, 600
KEYS = ("stream_id",)


def steal_reach(floor=STEAL_FLOOR, recovery=STEAL_RECOVERY, cutoff=STEAL_CUTOFF) -> int:
    """Longest distance at which the deepest curve is still below the cutoff."""
    return math.ceil(math.log((1 - cutoff) / (1 - floor)) / math.log(recovery)) + 1


def frames_in(ms: float, frame_samples: int, rate: float = 48000.0) -> int:
    return max(1, int(ms / 1000.0 * rate / frame_samples))


def with_raw_scale(frames: DataFrame, strong=0.94, medium=0.85, onset=0.92, silence_db=40.0, bands: int = 9) -> DataFrame:
    """Needs weighted_flux, onset, loudness_db, band_flux and telemetry; adds silent, broadband, raw."""
    f = features.broadband(frames, bands)
    flux = F.col("weighted_flux")
    q = quantiles_of(frames, {"_strong": (flux, strong), "_medium": (flux, medium),
                              "_onset": (F.col("onset"), onset), "_median": (F.col("loudness_db"), 0.5)})
    f = layout.attach(f, q, source=frames).withColumn("silent", F.col("loudness_db") < F.col("_median") - S.d(silence_db))
    raw = S.raw_scale("silent", "weighted_flux", "onset", "broadband", "_strong", "_medium", "_onset")
    return f.withColumn("raw", raw).drop("_strong", "_medium", "_onset", "_median")


def steal_ceiling(frames: DataFrame, floor=STEAL_FLOOR, recovery=STEAL_RECOVERY, cutoff=STEAL_CUTOFF) -> DataFrame:
    """Deepest curve of all peaks within reach; a silent frame ends every curve before it.
    Frames outside all curves but with a nearly tonal spectrum get a fixed ceiling."""
    reach = steal_reach(floor, recovery, cutoff)

    def build(w):
        past = F.collect_list(F.struct("raw", "silent")).over(w.rowsBetween(-reach, -1))
        start = F.struct(F.lit(1).alias("k"), F.col("silent").alias("stop"), S.d(1).alias("m"))

        def step(a, x):
            depth = S.clamp((x["raw"] - S.d(PEAK_MIN)) / S.d(PEAK_MAX - PEAK_MIN), 0, 1)
            curve = S.d(1) - S.d(1 - floor) * depth * F.pow(S.d(recovery), (a["k"] - 1).cast("double"))
            hit = ~a["stop"] & (x["raw"] >= S.d(PEAK_MIN)) & (curve < S.d(cutoff))
            return F.struct((a["k"] + 1).alias("k"), (a["stop"] | x["silent"]).alias("stop"),
                            F.when(hit, F.least(a["m"], curve)).otherwise(a["m"]).alias("m"))

        return F.aggregate(F.reverse(past), start, step, lambda a: a["m"])

    f = layout.windowed(frames, {"_curve": build}, before=reach)
    stolen = F.col("_curve") < S.d(1)
    tonal = ~F.col("silent") & ~stolen & (F.col("complexity") < S.d(TONAL_LIMIT))
    return (f.withColumn("in_steal", stolen | tonal)
            .withColumn("steal_ceil", F.when(tonal, S.d(TONAL_CEILING)).otherwise(F.col("_curve"))).drop("_curve"))


def redistribution_risk(frames: DataFrame, frame_samples: int = 960) -> DataFrame:
    """Needs raw, silent, loudness_db, complexity, in_steal; adds eligible and risk."""
    ahead = frames_in(PRE_ECHO_MS, frame_samples)
    behind = frames_in(TRANSITION_MS, frame_samples)
    loud = F.when(~F.col("silent"), F.col("loudness_db"))
    med = quantiles_of(frames, {"_loud": (loud, 0.5), "_all": (F.col("loudness_db"), 0.5)}).select(
        "stream_id", F.coalesce("_loud", "_all").alias("_med"))

    def pre_echo(w):
        return sum(F.when(F.lead("raw", k).over(w) >= S.d(PEAK_MIN), S.d(1.1 ** (ahead - k))).otherwise(S.d(0))
                   for k in range(1, ahead + 1))

    f = layout.windowed(frames, {"pre_echo": pre_echo,
                                 "_recent": lambda w: F.max("loudness_db").over(w.rowsBetween(-behind, -2))}, behind, ahead)
    f = layout.attach(f, med, source=frames).withColumn("recent_max", F.coalesce("_recent", "_med"))
    contrast = F.greatest(S.d(0), F.col("recent_max") - F.col("loudness_db"))
    texture = F.exp(-F.pow(F.col("loudness_db") + S.d(50), S.d(2)) / S.d(2 * 15.0 ** 2))
    f = f.withColumn("eligible", ~F.col("silent") & ~F.col("in_steal") & (F.col("raw") < S.d(PEAK_MIN))
                     & (F.col("loudness_db") >= S.d(ABSOLUTE_SILENCE_DB)))
    risk = (contrast * texture + F.col("pre_echo")) * (F.col("complexity") + S.d(0.2))
    return f.withColumn("risk", F.when(F.col("eligible"), risk).otherwise(S.d(0))).drop("_recent", "_med")


def redistribute(frames: DataFrame) -> DataFrame:
    """Hands what was stolen to frames at risk, in shares of the total; clipped budget is not carried.
    Nothing changes where nothing was stolen or nobody is eligible."""
    env = F.least(F.col("raw"), F.col("steal_ceil"))
    f = frames.withColumn("_env", env)
    sums = f.groupBy("stream_id").agg(F.sum(F.col("raw") - F.col("_env")).alias("_stolen"), F.sum("risk").alias("_risk"),
                                      F.sum(F.col("eligible").cast("double")).alias("_count"))
    f = layout.attach(f, sums, source=frames)
    share = (F.when(F.col("_risk") > 0, F.col("risk") / F.col("_risk"))
             .when(F.col("_count") > 0, F.col("eligible").cast("double") / F.col("_count")).otherwise(S.d(0)))
    give = F.when(F.col("_stolen") > 0, F.greatest(S.d(0), F.least(F.col("_stolen") * share, S.d(QUIET_MAX) - F.col("_env")))).otherwise(S.d(0))
    return f.withColumn("envelope", F.col("_env") + give).drop("_env", "_stolen", "_risk", "_count")


def enforce_budget(frames: DataFrame, scale: str = "envelope", target=1.0, lo=0.50, hi=1.35, passes: int = 4, keys=KEYS) -> DataFrame:
    """Scale to the target mean and clip, `passes` times.  Each pass only adds one factor per stream,
    so the chain grows by one reading of the input per pass; the input should be a stored table or cheap."""
    keys = list(keys)

    def clip(x):
        return F.greatest(S.d(lo), F.least(x, S.d(hi)))

    def scaled():
        return F.aggregate("_factors", clip(F.col(scale)), lambda x, k: clip(x * k))

    factors = None
    for _ in range(passes):
        now = frames if factors is None else layout.attach(frames, factors, keys)
        current = clip(F.col(scale)) if factors is None else scaled()
        past = F.array().cast("array<double>") if factors is None else F.any_value("_factors")
        mean = F.avg("_now")
        new = F.when(mean > 0, S.d(target) / mean).otherwise(S.d(1))
        factors = now.withColumn("_now", current).groupBy(*keys).agg(F.concat(past, F.array(new)).alias("_factors"))
    return layout.attach(frames, factors, keys).withColumn(scale, scaled()).drop("_factors")


def renormalise(frames: DataFrame, scale: str, keys=KEYS) -> DataFrame:
    f = layout.attach(frames, frames.groupBy(*keys).agg(F.avg(scale).alias("_mean")), keys)
    return f.withColumn(scale, F.when(F.col("_mean") > 0, F.col(scale) / F.col("_mean")).otherwise(F.col(scale))).drop("_mean")


def signal_features(telemetry: DataFrame, blocks: DataFrame, col: str, bands, weights) -> DataFrame:
    """Telemetry joined with flux, onset and loudness: the shortest input decides."""
    s = features.flux_and_onset(blocks.withColumn("loudness_db", A.loudness_db(col)), col, bands)
    s = s.withColumn("weighted_flux", features.weighted_flux(weights)).withColumn(
        "complexity", A.entropy_share("band_flux", len(bands)))
    return telemetry.join(s, ["stream_id", "frame_index"])


def current_plan(frames: DataFrame, frame_samples: int = 960, silence_db: float = 40.0) -> DataFrame:
    """From signal_features() to a plan."""
    f = with_raw_scale(layout.cut_lineage(frames), silence_db=silence_db)
    f = redistribution_risk(layout.cut_lineage(steal_ceiling(f)), frame_samples)
    f = enforce_budget(layout.cut_lineage(redistribute(layout.cut_lineage(f))))
    return f.select("stream_id", "frame_index", S.target_bitrate("requested_bitrate_bps", "envelope").alias("target_bitrate_bps"),
                    F.col("envelope").alias("scale"), "weighted_flux", "onset", "loudness_db", F.col("silent").cast("int").alias("silent"))


# ------------------------------------------------------------------ the earlier planner
def early_raw_scale(strong_peak=1.45, medium_peak=1.25, base=0.88):
    tw, calm = S.transient_weight(), S.calm_base(base)

    def boost(p):
        return F.greatest(calm, S.d(1) + S.d(p - 1) * tw)
    return (F.when(F.col("flux") >= F.col("_strong"), boost(strong_peak))
            .when(F.col("flux") >= F.col("_medium"), boost(medium_peak)).otherwise(calm))


def steal_and_recover(frames: DataFrame, decay=0.30, floor=0.40, recovery=1.5, deep=2) -> DataFrame:
    """After a peak (>1) two deep frames, then growth by half a frame until the raw value is met.
    Raw values without a peak are at most 1, so no valley outlasts the window used here."""
    reach = deep + math.ceil(math.log(1 / floor) / math.log(recovery)) + 2

    def build(w):
        rows = F.collect_list(F.struct("raw", "frame_index")).over(w.rowsBetween(-reach, 0))
        start = F.struct(S.d(1).alias("env"), F.lit(999).alias("since"), F.lit(False).alias("stolen"))

        def step(a, x):
            peak = (x["raw"] > S.d(1)) & (x["frame_index"] > 0)
            since = a["since"] + 1
            cand = (F.when((since <= deep) & ((a["env"] > S.d(1)) | a["stolen"]), F.greatest(a["env"] * S.d(decay), S.d(floor)))
                    .when(a["stolen"], a["env"] * S.d(recovery)))
            take = ~peak & (x["frame_index"] > 0) & F.coalesce(cand < x["raw"], F.lit(False))
            return F.struct(F.when(take, cand).otherwise(x["raw"]).alias("env"),
                            F.when(peak, F.lit(0)).when(x["frame_index"] == 0, F.lit(999)).otherwise(since).alias("since"),
                            take.alias("stolen"))

        return F.aggregate(rows, start, step)

    f = layout.windowed(frames, {"_s": build}, before=reach)
    return f.withColumn("envelope", F.col("_s.env")).withColumn("stolen", F.col("_s.stolen")).drop("_s")


def early_plan(frames: DataFrame) -> DataFrame:
    """Needs telemetry and flux."""
    from framescope.operators.smoothing import decayed_max
    q = quantiles(frames, "flux", {"_strong": 0.94, "_medium": 0.88})
    f = layout.attach(frames, q).withColumn("raw", early_raw_scale()).drop("_strong", "_medium")
    f = layout.cut_lineage(steal_and_recover(f))
    f = decayed_max(f, F.col("envelope"), 0.85, "scale", F.col("stolen"))
    f = layout.cut_lineage(f.withColumn("scale", F.greatest(S.d(0.2), F.least("scale", S.d(1.5)))))
    f = renormalise(f, "scale")
    return f.select("stream_id", "frame_index", S.target_bitrate("requested_bitrate_bps", "scale").alias("target_bitrate_bps"), "scale", "flux")


def mix_plans(transient: DataFrame, segment: DataFrame, mask: DataFrame | None, mix: float, calm_only: bool = False) -> DataFrame:
    """Transient plan times 1-m+m*s of the segment plan (on calm frames only, if asked), mean scale 1."""
    t = transient.select("stream_id", "frame_index", "scale", "target_bitrate_bps")
    if mix <= 0:
        return t
    f = t.join(segment.select("stream_id", "frame_index", F.col("scale").alias("_s")), ["stream_id", "frame_index"])
    ratio = S.d(1 - mix) + S.d(mix) * F.col("_s")
    if mask is not None:
        f = f.join(mask.select("stream_id", "frame_index", "attack"), ["stream_id", "frame_index"])
        if calm_only:
            ratio = F.when(F.col("attack"), S.d(1)).otherwise(ratio)
    f = f.withColumn("scale", F.col("scale") * ratio).withColumn("target_bitrate_bps", F.col("target_bitrate_bps") * ratio)
    f = layout.attach(f, f.groupBy("stream_id").agg(F.avg("scale").alias("_mean")))
    return f.select("stream_id", "frame_index", (F.col("scale") / F.col("_mean")).alias("scale"),
                    (F.col("target_bitrate_bps") / F.col("_mean")).alias("target_bitrate_bps"))
