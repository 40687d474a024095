"""Per-frame signal features: framing, flux, onset, loudness, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.functions import spectral
from framescope.operators import layout

KEYS = ("stream_id",)


def overlapped(blocks: DataFrame, col: str, block: int, window: int, out: str, keys=KEYS) -> DataFrame:
    """Frames of `window` samples starting at every block of `block` samples; incomplete ones are dropped."""
    more = -(-window // block) - 1

    def build(w):
        parts = [F.col(col)] + [F.lead(col, k).over(w) for k in range(1, more + 1)]
        return F.slice(F.concat(*parts), 1, window)

    f = layout.windowed(blocks, {out: build}, 0, more, keys)
    return f.where(F.size(out) == window)


def windows(blocks: DataFrame, cols: dict[str, str], block: int, size: int, hop: int, lead: int = 0, keys=KEYS) -> DataFrame:
    """A signal in blocks of `block` samples, cut anew: keys, window, and for `cols` input -> output the samples of every window, any
    `size` and `hop`.  Window j starts at sample j*hop; the last one ends before the last sample.  With `lead` a window also has that many samples
    before its start, except where the signal begins there."""
    keys = list(keys)
    back, ahead = -(-lead // block), -(-size // block)

    def run(c):
        return lambda w: F.flatten(F.collect_list(c).over(w.rowsBetween(-back, ahead)))

    f = layout.windowed(blocks.select(*keys, "frame_index", *cols), {f"_run{i}": run(c) for i, c in enumerate(cols)}, back, ahead, keys)
    i = F.col("frame_index")
    first = (i - F.least(i, F.lit(back))) * block
    lo, hi = F.ceil(i * block / S.d(hop)), F.ceil((i + 1) * block / S.d(hop)) - 1
    f = f.select(*keys, first.alias("_first"), *[f"_run{n}" for n in range(len(cols))], F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("window"))
    f = f.withColumn("_at", F.col("window") * hop - F.col("_first")).where(F.size("_run0") > F.col("_at") + size)
    extra = F.least(F.lit(lead), F.col("_at"))
    cut = [F.slice(f"_run{n}", (F.col("_at") - extra + 1).cast("int"), (extra + size).cast("int")).alias(out) for n, out in enumerate(cols.values())]
    return f.select(*keys, "window", *cut)


def realigned(frames: DataFrame, col: str, lag: int, block: int, out: str, keys=KEYS) -> DataFrame:
    """Frames of a signal that is `lag` samples late: sample i of the result is sample i+lag."""
    whole, part = divmod(lag, block)

    def build(w):
        first = F.lead(col, whole).over(w) if whole else F.col(col)
        if not part:
            return first
        nxt = F.lead(col, whole + 1).over(w)
        return F.concat(F.slice(first, part + 1, block - part), F.slice(nxt, 1, part))

    return layout.windowed(frames, {out: build}, 0, whole + 1, keys).where(F.col(out).isNotNull())


def flux_and_onset(frames: DataFrame, col: str, bands, keys=KEYS) -> DataFrame:
    """band_flux and onset of each frame.  Samples are what is shuffled, never spectra."""
    f = layout.windowed(frames, {"_p1": lambda w: F.lag(col, 1).over(w), "_p2": lambda w: F.lag(col, 2).over(w)}, before=2, keys=keys)
    return spectral.flux_features(f, col, "_p1", "_p2", bands)


def weighted_flux(weights) -> object:
    return A.dot("band_flux", A.lits(weights))


def broadband(frames: DataFrame, n: int) -> DataFrame:
    """Share of bands whose flux is above half their stream mean."""
    means = frames.groupBy("stream_id").agg(*[F.avg(F.col("band_flux")[b]).alias(f"_m{b}") for b in range(n)])
    f = layout.attach(frames, means)
    above = sum((F.col("band_flux")[b] > S.d(0.5) * (F.col(f"_m{b}") + S.d(1e-12))).cast("int") for b in range(n))
    return f.withColumn("broadband", S.clamp(above / S.d(n), 0, 1)).drop(*[f"_m{b}" for b in range(n)])


def attack_mask(frames: DataFrame, flux, quantile: float = 0.95) -> DataFrame:
    from framescope.operators.quantiles import quantiles
    f = frames.withColumn("_flux", flux)
    return layout.attach(f, quantiles(f, "_flux", {"_limit": quantile})).withColumn(
        "attack", F.col("_flux") >= F.col("_limit")).drop("_flux", "_limit")
