"""Packet logs: census, loss bursts, recovery, gating, rate reservoirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions import scalar as S
from framescope.operators import layout, recurrence

KEYS = ("stream_id",)
GATE_AFTER, GATE_MAX = 10, 20                      # fixed values: 200 ms, 400 ms
BANDWIDTH_LIMITS = [9000.0, 9000.0, 13500.0, 14000.0]   # voice; NB, MB, WB, SWB, FB
BANDWIDTH_MARGINS = [700.0, 700.0, 1000.0, 2000.0]


def with_header(packets: DataFrame) -> DataFrame:
    return (packets.withColumn("mode", S.packet_mode("toc")).withColumn("bandwidth", S.packet_bandwidth("toc"))
            .withColumn("channels", S.packet_channels("toc")).withColumn("frame_samples", S.samples_per_frame("toc")))


def census(packets: DataFrame) -> DataFrame:
    """Counts and bytes for every combination of header fields, with all subtotals."""
    dims = ["mode", "bandwidth", "channels", "frame_samples"]
    return with_header(packets).cube(*dims).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"))


def check_audit(packets: DataFrame) -> DataFrame:
    """Encoder and decoder state differ although this packet and the one before it arrived."""
    p = layout.windowed(packets, {"_lost_before": lambda w: F.lag("lost", 1, 1).over(w)}, before=1)
    bad = (F.col("lost") == 0) & (F.col("_lost_before") == 0) & (F.col("check") != 0) & (F.col("check") != F.col("decoded_check"))
    return p.groupBy("stream_id").agg(F.count_if(bad).alias("mismatches"),
                                      F.count_if((F.col("lost") == 0) & (F.col("_lost_before") == 0)).alias("compared"))


def silence_gate(frames: DataFrame, active, name: str = "gated") -> DataFrame:
    """Equal 20 ms frames: position p in an inactive run is gated from 11 on, but for every 21st."""
    f = layout.running(frames, {"_on": ("max", F.when(active, F.col("frame_index")))})
    p = F.col("frame_index") - F.coalesce("_on", F.lit(-1).cast("long"))
    hit = (p > GATE_AFTER) & (F.pmod(p - GATE_AFTER - 1, F.lit(GATE_MAX + 1)) != GATE_MAX)
    return f.withColumn(name, hit.cast("int")).drop("_on")


def hysteresis_steps(frames: DataFrame, value, limits, margins) -> DataFrame:
    """Puts the columns of recurrence.FiniteState on `frames`: which class follows each class."""
    v = value.cast("double")
    plain = sum((v >= S.d(t)).cast("int") for t in limits)
    f = frames
    for prev in range(len(limits) + 1):
        stay = F.lit(False)
        if prev < len(limits):
            stay = stay | ((plain > prev) & (v < S.d(limits[prev] + margins[prev])))
        if prev > 0:
            stay = stay | ((plain < prev) & (v > S.d(limits[prev - 1] - margins[prev - 1])))
        f = f.withColumn(f"_to{prev}", F.when(stay, F.lit(prev)).otherwise(plain).cast("long"))
    return f


def hysteresis_class(frames: DataFrame, value, limits, margins, out: str = "cls", init: int = 0) -> DataFrame:
    """Class by ascending limits; the previous class holds while the value is within its margin."""
    return recurrence.scan(hysteresis_steps(frames, value, limits, margins), recurrence.FiniteState(len(limits) + 1), out, init)


def leaky_bucket(frames: DataFrame, excess) -> DataFrame:
    """level = max(0, level + excess); `adjust` is what is handed out when it would fall below 0."""
    f = frames.withColumn("_x", excess)
    f = layout.running(f, {"_s": ("sum", F.col("_x"))})
    f = layout.running(f, {"_low": ("min", F.col("_s"))})
    level = F.col("_s") - F.least(F.lit(0), F.col("_low"))
    # the lowest prefix before this row: this row's own prefix only matters if it is a new low
    f = layout.windowed(f, {"_low_before": lambda w: F.lag("_low").over(w)}, before=1)
    before = F.col("_s") - F.col("_x") - F.least(F.lit(0), F.coalesce("_low_before", F.lit(0)))
    short = F.greatest(F.lit(0), -(before + F.col("_x")))
    return (f.withColumn("level", level).withColumn("adjust", F.floor(short / S.d(64)).cast("long"))
            .drop("_x", "_s", "_low", "_low_before"))


def neighbours(packets: DataFrame, carried=()) -> DataFrame:
    """Nearest received packet before and after every packet, with `carried` columns of the later one."""
    got = F.when(F.col("lost") == 0, F.col("frame_index"))
    p = layout.running(packets, {"prev_received": ("max", got)}, exclusive=True)
    later = F.when(F.col("lost") == 0, F.struct(F.col("frame_index").alias("i"), *[F.col(c).alias(c) for c in carried]))
    p = layout.running(p, {"_next": ("first", later)}, reverse=True, exclusive=True)
    return p.select(*packets.columns, F.coalesce("prev_received", F.lit(-1).cast("long")).alias("prev_received"),
                    F.col("_next.i").alias("next_received"), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def loss_bursts(packets: DataFrame) -> DataFrame:
    """Length of every run of lost packets and the received packet that ends it (null at the end)."""
    n = neighbours(packets.select("stream_id", "frame_index", "lost"))
    return (n.where(F.col("lost") == 1).groupBy("stream_id", "prev_received")
            .agg(F.count(F.lit(1)).alias("lost_count"), F.max("next_received").alias("ended_by")))


def feature_source(packets: DataFrame) -> DataFrame:
    """Every lost frame with the next received packet that can carry its features."""
    n = neighbours(packets.select("stream_id", "frame_index", "lost"))
    return n.where((F.col("lost") == 1) & F.col("next_received").isNotNull()).select(
        "stream_id", "frame_index", F.col("next_received").alias("source_index"),
        (F.col("next_received") - F.col("frame_index")).alias("distance"))


def recovery_source(packets: DataFrame) -> DataFrame:
    """low_rate: last frame of a gap and the next packet carries a copy; redundancy: the next packet
    reaches back far enough; concealment otherwise; pending: nothing received afterwards."""
    n = neighbours(packets.select("stream_id", "frame_index", "lost", "has_lbrr", "cover"), ("has_lbrr", "cover"))
    back = F.col("next_received") - F.col("frame_index")
    src = (F.when(F.col("next_received").isNull(), "pending")
           .when((back == 1) & (F.col("next_has_lbrr") == 1), "low_rate")
           .when(back <= F.col("next_cover"), "redundancy").otherwise("concealment"))
    return n.where(F.col("lost") == 1).select("stream_id", "frame_index", src.alias("source"))


def assemble_features(packets: DataFrame, features: str = "features", per_packet: int = 2) -> DataFrame:
    """Features for every packet slot, taken from the packet that arrived next (or the last one)."""
    last = packets.groupBy("stream_id").agg(F.max("frame_index").alias("_last"))
    p = layout.attach(packets, last)
    usable = F.when((F.col("lost") == 0) | (F.col("frame_index") == F.col("_last")),
                    F.struct(F.col("frame_index").alias("i"), F.col(features).alias("f")))
    p = layout.running(p, {"_src": ("first", usable)}, reverse=True)
    start = -F.lit(per_packet) * (F.col("_src.i") - F.col("frame_index") + 1)
    # a packet that does not reach back far enough leaves the slot empty
    fits = F.size("_src.f") >= -start
    part = F.slice(F.col("_src.f"), start.cast("int"), F.lit(per_packet))
    return p.select("stream_id", "frame_index", F.col("_src.i").alias("source_index"),
                    F.when(fits, part).alias("assembled"))


def redundancy_kbps(size):
    return F.rint(F.avg(size) * S.d(50) / S.d(1000)).cast("long")


def loss_share(loss: DataFrame, key: str = "stream_id") -> DataFrame:
    return loss.groupBy(key).agg(F.avg("lost").alias("share"), F.count(F.lit(1)).alias("length"))


def ordered_traces(loss: DataFrame, key: str = "stream_id") -> DataFrame:
    """Traces by rising loss share, each with its offset in the concatenation."""
    s = layout.rank_all(loss_share(loss, key), F.col("share"), F.col(key), "place")
    return layout.running(s, {"offset": ("sum", F.col("length"))}, keys=(), order="place", exclusive=True)
