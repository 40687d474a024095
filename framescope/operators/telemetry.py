"""Segment summaries, rate statistics and plan comparison over frame telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions import scalar as S
from framescope.operators import layout

KEYS = ("stream_id",)


def frames_per_segment(segment_ms: int, input_samples: int = 960, sample_rate: int = 48000) -> int:
    return max(1, round(segment_ms / 1000.0 * sample_rate / input_samples))


def spread_or_zero(col):
    """Population standard deviation, 0 for fewer than two rows."""
    return F.when(F.count(col) < 2, F.lit(0.0)).otherwise(F.stddev_pop(col))


def summarize_segments(frames: DataFrame, per_segment: int, sample_rate: int = 48000) -> DataFrame:
    """One row per (stream, segment); start and end from the frames' own sizes."""
    seg = F.floor(F.col("frame_index") / F.lit(float(per_segment))).alias("segment_index")
    out = frames.withColumn("difficulty", S.frame_difficulty()).groupBy("stream_id", seg).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("input_samples").alias("_samples"),
        F.avg("packet_bytes").alias("avg_packet_bytes"), spread_or_zero("packet_bytes").alias("packet_stddev"),
        F.avg("activity").alias("mean_activity"), F.avg("tonality").alias("mean_tonality"),
        F.avg("music_prob").alias("mean_music_prob"), F.avg("bandwidth").alias("mean_bandwidth"),
        F.avg("difficulty").alias("_mean"), F.max("difficulty").alias("_peak"))
    raw = S.clamp(S.d(0.62) * F.col("_mean") + S.d(0.28) * F.col("_peak")
                  + S.d(0.10) * S.clamp(F.col("packet_stddev") / S.d(250), 0, 1), 0, 1)
    out = layout.running(out, {"_ends": ("sum", F.col("_samples"))}, KEYS, "segment_index")
    return (out.withColumn("raw_difficulty", raw)
            .withColumn("start_s", (F.col("_ends") - F.col("_samples")) / S.d(sample_rate))
            .withColumn("end_s", F.col("_ends") / S.d(sample_rate))
            .drop("_mean", "_peak", "_samples", "_ends"))


def smooth_and_budget(segments: DataFrame) -> DataFrame:
    """[1,2,1] smoothing with renormalised edges, z-score over the stream, budget and class."""
    x = F.col("raw_difficulty")

    def smooth(w):
        before, after = F.lag(x).over(w), F.lead(x).over(w)
        weight = S.d(2) + F.when(before.isNull(), 0.0).otherwise(1.0) + F.when(after.isNull(), 0.0).otherwise(1.0)
        return (S.d(2) * x + F.coalesce(before, S.d(0)) + F.coalesce(after, S.d(0))) / weight

    out = layout.windowed(segments, {"smoothed_difficulty": smooth}, 1, 1, KEYS, "segment_index")
    stats = segments.groupBy("stream_id").agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"))
    out = layout.attach(out, stats, KEYS, "segment_index", source=segments)
    z = F.when(F.col("_sd") > S.d(1e-9), (F.col("smoothed_difficulty") - F.col("_mu")) / F.col("_sd")).otherwise(S.d(0))
    return (out.withColumn("budget_scale", S.clamp(S.d(1) + S.d(0.1) * z, 0.85, 1.15))
            .withColumn("segment_class", S.classify_segment("smoothed_difficulty")).drop("_mu", "_sd"))


def rate_statistics(frames: DataFrame, active, sample_rate: int = 48000) -> DataFrame:
    """Average, maximum and active kbps and the deviation of packet bits, per stream."""
    bits = F.col("packet_bytes").cast("double") * S.d(8)
    fs = F.max("input_samples").cast("double")
    var = F.sum(bits * bits) / F.count(F.lit(1)) - F.pow(F.sum(bits) / F.count(F.lit(1)), S.d(2))
    k = S.d(1e-3 * sample_rate)
    return frames.groupBy("stream_id").agg(
        (k * F.sum(bits) / F.sum("input_samples")).alias("average_kbps"),
        (k * F.max(bits) / fs).alias("maximum_kbps"),
        (k * F.coalesce(F.sum(F.when(active, bits)), S.d(0)) / (S.d(1e-15) + fs * F.count_if(active))).alias("active_kbps"),
        (k * F.sqrt(F.greatest(S.d(0), var)) / fs).alias("deviation_kbps"))


def correlation_or_zero(x, y):
    """0 where either side does not vary."""
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(flat, S.d(0)).otherwise(F.coalesce(F.corr(x, y), S.d(0)))


def paired(base: DataFrame, other: DataFrame, value: str, keys=("stream_id", "frame_index")) -> DataFrame:
    """Baseline and candidate side by side; a frame on one side only is an error when it is read."""
    keys = list(keys)
    both = base.select(*keys, F.col(value).alias("base_value"), F.lit(1).alias("_b")).join(
        other.select(*keys, F.col(value).alias("plan_value"), F.lit(1).alias("_p")), keys, "full_outer")
    odd = F.col("_b").isNull() | F.col("_p").isNull()
    checked = F.when(odd, F.raise_error(F.lit("baseline and candidate differ in frames")).cast("boolean")).otherwise(F.lit(True))
    return both.where(checked).drop("_b", "_p")


def extreme_segments(segments: DataFrame, n: int = 10) -> DataFrame:
    """The n hardest and n easiest segments of each stream, ties by position."""
    out = []
    for name, order in (("hardest", F.desc("smoothed_difficulty")), ("easiest", F.asc("smoothed_difficulty"))):
        w = Window.partitionBy("stream_id").orderBy(order, F.asc("segment_index"))
        out.append(segments.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
                   .withColumn("extreme", F.lit(name)))
    return out[0].unionByName(out[1])


def frame_to_segment(frames: DataFrame, segments: DataFrame, per_segment: int, columns) -> DataFrame:
    key = F.floor(F.col("frame_index") / F.lit(float(per_segment)))
    return frames.withColumn("segment_index", key).join(
        segments.select("stream_id", "segment_index", *columns), ["stream_id", "segment_index"])
