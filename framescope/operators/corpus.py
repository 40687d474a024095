"""Preparing training and test sets: choice, sequences, alignment, mixing, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import layout
from framescope.operators.quantiles import quantiles_of

KEYS = ("stream_id",)


def balanced_choice(clips: DataFrame, per_language: int, seed: int) -> DataFrame:
    """n/2 female and n/2 male clients per language, one clip each; languages with too few are dropped."""
    half = per_language // 2
    c = clips.where(F.col("gender").isin("female", "male"))
    # one clip per client and gender: the smallest draw wins, so this aggregates map-side
    pick = F.struct(S.draw("path", seed, "clip").alias("d"), "path")
    one = c.groupBy("lang", "gender", "client").agg(F.min(pick).alias("_p"))
    # clients of several genders or languages count in each
    w = Window.partitionBy("lang", "gender").orderBy(
        S.draw(F.concat_ws("/", "lang", "gender", "client"), seed, "client"), "client")
    top = one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= half)
    enough = one.groupBy("lang").agg(
        F.count_if(F.col("gender") == "female").alias("_f"), F.count_if(F.col("gender") == "male").alias("_m"),
    ).where(F.least("_f", "_m") >= half).select("lang")
    return top.join(enough, "lang", "left_semi").select("lang", "gender", "client", F.col("_p.path").alias("path"))


def sequences(frames: DataFrame, value: str, length: int, keys=KEYS) -> DataFrame:
    """Whole sequences of `length` frames; the tail of a stream is dropped."""
    seq = F.floor(F.col("frame_index") / S.d(length)).alias("sequence")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", F.col(value).alias("v")))), lambda s: s["v"])
    return frames.groupBy(*keys, seq).agg(ordered.alias("values")).where(F.size("values") == length)


def context_windows(frames: DataFrame, value: str, stride: int, history: int, ahead: int, keys=KEYS) -> DataFrame:
    """Overlapping sequences: frames [s*stride-history, (s+1)*stride+ahead); incomplete ones are dropped."""
    i = F.col("frame_index")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((i - S.d(stride + ahead - 1)) / S.d(stride)))
    last = F.floor((i + S.d(history)) / S.d(stride))
    member = F.when(last >= first, F.sequence(first, last))
    f = frames.select(*keys, "frame_index", F.col(value).alias("v"), F.explode(member).alias("sequence"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "v"))), lambda s: s["v"])
    return f.groupBy(*keys, "sequence").agg(ordered.alias("values")).where(F.size("values") == history + stride + ahead)


def align(features: DataFrame, signal: DataFrame, delay: int) -> DataFrame:
    """Feature frame i with signal frame i+delay."""
    moved = signal.withColumn("frame_index", F.col("frame_index") - delay)
    return features.join(moved, ["stream_id", "frame_index"])


def concat_offsets(items: DataFrame, length: str, group=("corpus",), order: str = "item_index") -> DataFrame:
    """Where each item starts when a group's items are laid end to end."""
    return layout.running(items, {"offset": ("sum", F.col(length))}, group, order, exclusive=True)


def cross_fade(items: DataFrame, signal: str, overlap: int, group=("corpus",), order: str = "item_index") -> DataFrame:
    """Each item's start is faded with the end of the one before; its own end is kept for the next."""
    import math
    rise = [0.5 + 0.5 * math.cos(i * math.pi / overlap) for i in range(overlap)]
    f = layout.windowed(items, {"_tail": lambda w: F.slice(F.lag(signal).over(w), -overlap, overlap)}, before=1, keys=group, order=order)
    n = F.size(signal)
    tail = F.coalesce("_tail", A.lits([0.0] * overlap))
    head = F.slice(F.col(signal), 1, overlap)
    faded = A.add(F.zip_with(tail, A.lits(rise), lambda x, w: x * w), F.zip_with(head, A.lits(rise[::-1]), lambda x, w: x * w))
    body = F.slice(F.col(signal), F.lit(overlap + 1), n - 2 * overlap)
    return f.withColumn("faded", F.concat(faded, body)).drop("_tail")


def mix_at_snr(speech: str, noise: str, snr_db):
    """speech + gain*noise with gain = sqrt(Es/En * 10^(-snr/10)); silent noise adds nothing."""
    en = A.energy(noise)
    gain = F.when(en > 0, F.sqrt(A.energy(speech) / en * F.pow(S.d(10), -snr_db / S.d(10)))).otherwise(S.d(0))
    return A.add(speech, A.scale(noise, gain))


def random_partner(items: DataFrame, pool: DataFrame, ident, seed: int, name: str) -> DataFrame:
    """Pairs every item with a pool row chosen by its id.  `pool` has a dense `pool_index`."""
    size = pool.agg(F.count(F.lit(1))).scalar()
    return items.withColumn("pool_index", S.draw_int(ident, seed, name, size)).join(pool, "pool_index")


def augmentation(items: DataFrame, ident, seed: int, length: int, clean_share: float = 0.25) -> DataFrame:
    """Reproducible draws per sequence: start of sound, gains, clipping, quantising, dither, kept clean."""
    def u(name):
        return S.draw(ident, seed, name)

    start = F.when(u("start?") < S.d(0.75), F.lit(0)).otherwise(
        F.least(F.floor(S.d(-1000) * F.log(F.greatest(u("start"), S.d(1e-12)))), F.lit(length)))
    speech = F.pow(S.d(10), (S.d(-30) + F.floor(u("speech") * 40)) / S.d(20))
    speech = speech * F.when(u("sign") < S.d(0.5), S.d(-1)).otherwise(S.d(1))
    speech = speech * F.when(u("faint") < S.d(0.05), S.d(0.01)).otherwise(S.d(1))
    speech = F.when(u("mute") < S.d(0.01), S.d(0)).otherwise(speech)
    noise = F.pow(S.d(10), (S.d(-40) + u("noise1") * 25 + u("noise2") * 15) / S.d(20))
    noise = F.when(u("no noise") < S.d(0.5), S.d(0)).otherwise(noise) * F.when(u("low noise") < S.d(1 / 12), S.d(0.03)).otherwise(S.d(1))
    return (items.withColumn("start", start.cast("long")).withColumn("speech_gain", speech)
            .withColumn("noise_gain", noise * speech).withColumn("clips", u("clip") < S.d(0.25))
            .withColumn("quantises", u("quantise") < S.d(0.5)).withColumn("dither", u("dither") - S.d(0.5))
            .withColumn("stays_clean", u("clean") < S.d(clean_share)))


def apply_augmentation(items: DataFrame, speech: str, noise: str, out: str = "mixed") -> DataFrame:
    """Silence before `start`, gains, then optional clipping and 16-bit rounding; clean items pass."""
    quiet = F.transform(F.col(speech), lambda x, i: F.when(i < F.col("start"), S.d(0)).otherwise(x * F.col("speech_gain")))
    mixed = A.add(quiet, A.scale(noise, F.col("noise_gain")))
    mixed = F.when(F.col("clips"), F.transform(mixed, S.clip16)).otherwise(mixed)
    mixed = F.when(F.col("quantises"), F.transform(mixed, lambda x: F.floor(S.d(0.5) + x).cast("double"))).otherwise(mixed)
    return items.withColumn(out, F.when(F.col("stays_clean"), F.col(speech)).otherwise(mixed))


def loss_for_sequences(seqs: DataFrame, loss: DataFrame, ident, length: int, seed: int) -> DataFrame:
    """Every sequence reads `length` loss flags from its own random offset of one trace."""
    span = F.greatest(F.lit(1), loss.agg(F.count(F.lit(1))).scalar() - length)
    s = seqs.withColumn("loss_offset", S.draw_int(ident, seed, "offset", span))
    s = s.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("seq", F.col("loss_offset") + F.col("_j"))
    return s.join(loss, "seq").withColumnRenamed("_j", "position").drop("seq")


def mask_features(rows: DataFrame, ident, seed: int, features: str, burst_features: int) -> DataFrame:
    """Extra short losses (2 %), long losses broken up (10 %), burst features dropped (10 %).
    state: 1 received, 0 lost, -1 only the burst features are missing."""
    key = F.concat_ws("/", ident.cast("string"), F.col("position").cast("string"))
    kept = S.d(1) - F.col("lost").cast("double")
    kept = kept * (S.draw(key, seed, "extra") > S.d(0.02)).cast("double")
    kept = S.d(1) - (S.d(1) - kept) * (S.draw(key, seed, "break") > S.d(0.1)).cast("double")
    burst = (S.draw(key, seed, "burst") > S.d(0.1)).cast("double")
    masked = F.transform(F.col(features), lambda x, i: x * kept * F.when(i < burst_features, burst).otherwise(S.d(1)))
    return rows.withColumn("masked", masked).withColumn("state", kept * (S.d(2) * burst - S.d(1)))


def split(items: DataFrame, ident, seed: int, train: float = 0.95) -> DataFrame:
    return items.withColumn("part", F.when(S.draw(ident, seed, "split") < S.d(train), "train").otherwise("test"))


def sample(items: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n items in an order that depends on their names and the seed only."""
    return items.orderBy(S.draw(key, seed, "sample"), F.col(key)).limit(n)


def surround_kind_rates(streams: DataFrame, bitrate: int, frame_rate: int = 50) -> DataFrame:
    """A group's rate split over its streams: group_id, kind, rate, one row per kind that the group has.  kind: coupled, mono or lfe;
    integer division truncates.  A group of lfe only has nothing to split by and gets no row.  One aggregation: rows of streams are neither
    sorted nor joined."""
    g = streams.groupBy("group_id").agg(
        F.count_if(F.col("kind") == "coupled").alias("_c"), F.count_if(F.col("kind") == "mono").alias("_m"),
        F.count_if(F.col("kind") == "lfe").alias("_l")).where("_c + _m > 0 AND group_id IS NOT NULL")

    def trunc(x):
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")

    channel = 40 * max(50, frame_rate)
    lfe = min(bitrate // 20, 3000) + 15 * max(50, frame_rate)
    normal = 2 * F.col("_c") + F.col("_m")
    offset = trunc(trunc((F.lit(bitrate) - channel * normal - lfe * F.col("_l")) / normal) / S.d(2))
    offset = F.greatest(F.lit(0), F.least(F.lit(20000), offset))
    total = 256 * F.col("_m") + 512 * F.col("_c") + 32 * F.col("_l")
    rest = F.lit(256).cast("long") * (F.lit(bitrate) - lfe * F.col("_l") - offset * (F.col("_c") + F.col("_m")) - channel * normal)
    g = g.withColumn("_offset", offset).withColumn("_rate", trunc(rest / total))
    zero = F.lit(0).cast("long")
    rates = {"coupled": ("_c", 2 * channel + F.greatest(zero, F.col("_offset") + F.shiftright(F.col("_rate") * 512, 8))),
             "mono": ("_m", channel + F.greatest(zero, F.col("_offset") + F.col("_rate"))),
             "lfe": ("_l", F.greatest(zero, lfe + F.shiftright(F.col("_rate") * 32, 8)))}
    each = F.array(*[F.when(F.col(n) > 0, F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(500).cast("long"), rate).alias("rate"))) for kind, (n, rate) in rates.items()])
    return g.select("group_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_k")).select("group_id", "_k.kind", "_k.rate")


def surround_rates(streams: DataFrame, bitrate: int, frame_rate: int = 50) -> DataFrame:
    """Every stream with its rate from `surround_kind_rates`."""
    return streams.join(surround_kind_rates(streams, bitrate, frame_rate), ["group_id", "kind"]).select(*streams.columns, "rate")


def interleaved_training_signal(frames: DataFrame, col: str, offset_frames: int, keys=KEYS) -> DataFrame:
    """Pre-emphasised samples, each written twice, read `offset_frames` later."""
    f = layout.windowed(frames, {"_last": lambda w: F.element_at(F.lag(col).over(w), -1)}, before=1, keys=keys)
    pre = A.pre_emphasis(col, F.coalesce("_last", S.d(0)))
    f = f.withColumn("signal", F.flatten(F.transform(pre, lambda v: F.array(v, v))))
    return f.where(F.col("frame_index") >= offset_frames).withColumn(
        "frame_index", F.col("frame_index") - offset_frames).drop("_last")


def trim_silence(frames: DataFrame, energy: str, threshold: float = 0.005, margin: int = 20) -> DataFrame:
    """Frames from `margin` before the first to `margin` after the last active one (end exclusive)."""
    ref = quantiles_of(frames, {"_ref": (F.col(energy), ("at", 0.9))})
    f = layout.attach(frames, ref)
    on = F.when(F.col(energy) > S.d(threshold) * F.col("_ref"), F.col("frame_index"))
    span = f.groupBy("stream_id").agg(F.min(on).alias("_a"), F.max(on).alias("_z"), F.max("frame_index").alias("_n"))
    # with no active frame the scan ends on the last frame from the front and the first from the back
    first, last = F.coalesce("_a", F.col("_n")), F.coalesce("_z", F.lit(0).cast("long"))
    f = layout.attach(f, span.select("stream_id", F.greatest(first - margin, F.lit(0)).alias("_from"),
                                     F.least(last + margin, F.col("_n")).alias("_to")))
    return f.where((F.col("frame_index") >= F.col("_from")) & (F.col("frame_index") < F.col("_to"))).drop("_ref", "_from", "_to")


def bandwidth_class(frames: DataFrame, power: str, edges: tuple[int, int, int], margin: int = 5) -> DataFrame:
    """wb, swb or fb from mean bin energies of frames above a tenth of the loud ones.
    `edges`: first bin at 8 kHz, first bin at 16 kHz, number of bins."""
    e8, e16, bins = edges
    f = frames.withColumn("_e", A.total(power))
    f = layout.attach(f, quantiles_of(f, {"_ref": (F.col("_e"), ("at", 0.9))})).where(F.col("_e") > S.d(0.1) * F.col("_ref"))

    def mean_of(lo, hi):
        return F.sum(A.total(F.slice(power, lo + 1, hi - lo))) / S.d(hi - lo)

    out = f.groupBy("stream_id").agg(mean_of(0, e8).alias("wb"), mean_of(e8 + margin, e16).alias("swb"),
                                     mean_of(e16 + margin, bins).alias("fb"))
    return out.withColumn("bandwidth_class", F.when(F.col("swb") / F.col("wb") < S.d(1e-5), "wb")
                          .when(F.col("fb") / F.col("wb") < S.d(1e-7), "swb").otherwise("fb"))
