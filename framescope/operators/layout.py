"""How ordered work is laid out so that no stream has to fit one task.

A stream is cut into segments of a fixed number of frames.  Bounded windows run
inside a segment that carries copies of its neighbours' edge rows (the halo).
Unbounded ones run in two steps: one small row per segment, then a carry-in
that is joined back on (stream, segment).  Both shuffle on (stream, segment),
so a stream that holds a third of the table is spread like any other.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("stream_id",)
ORDER = "frame_index"
FANOUT = 4096
ROW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def segment_length(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.framescope.segmentFrames", "4096"))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster.  A private one serves only a local session that names none: executors elsewhere
    could not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stores an intermediate result in the shared folder and reads it back: it survives lost
    executors, later steps read only the columns they need, and their plans stay small."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segment_of(order: str | Column, length: int) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(float(length)))


# ---------------------------------------------------------------- bounded windows
class Halo:
    """Rows of `df` copied into every segment whose window may reach them."""

    def __init__(self, df, before, after, keys=KEYS, order=ORDER):
        self.keys, self.order = list(keys), order
        self.length = segment_length(df.sparkSession)
        f = F.col(order)
        home = F.sequence(segment_of(f - F.lit(after), self.length),
                          segment_of(f + F.lit(before), self.length))
        self.rows = df.withColumn("_seg", F.explode(home))
        self.window = Window.partitionBy(*self.keys, "_seg").orderBy(order)

    def core(self, df: DataFrame) -> DataFrame:
        """Drops the copies again."""
        return df.where(segment_of(self.order, self.length) == F.col("_seg")).drop("_seg")


def windowed(df, exprs, before=0, after=0, keys=KEYS, order=ORDER) -> DataFrame:
    """Adds `exprs` (name -> function of a window spec), each reaching at most
    `before` rows back and `after` rows ahead."""
    h = Halo(df, before, after, keys, order)
    return h.core(h.rows.select("*", *[fn(h.window).alias(n) for n, fn in exprs.items()]))


# ---------------------------------------------------------------- unbounded windows
_AGG = {
    "sum": lambda v, o: F.sum(v),
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
}
_OVER = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda v: F.last(v, ignorenulls=True),
    # rows come in falling order here, so the nearest one is the last seen
    "first": lambda v: F.last(v, ignorenulls=True),
}


def _merge(kind, outer, inner):
    if kind == "sum":
        return F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0))
    if kind == "max":
        return F.greatest(outer, inner)
    if kind == "min":
        return F.least(outer, inner)
    return F.coalesce(inner, outer)


def running(df, specs, keys=KEYS, order=ORDER, reverse=False, exclusive=False) -> DataFrame:
    """Running aggregates from the start of the stream (or its end, `reverse`).

    `specs`: name -> (kind, column), kind in sum/max/min/last; with `reverse`
    the nearest following value is kind "first".  `exclusive` leaves out the row itself.
    """
    keys = list(keys)
    n = segment_length(df.sparkSession)
    names = list(specs)
    base = df.withColumn("_seg", segment_of(order, n))
    for name, (kind, value) in specs.items():
        base = base.withColumn(f"_v_{name}", value)
    seg = base.groupBy(*keys, "_seg").agg(
        *[_AGG[specs[m][0]](F.col(f"_v_{m}"), F.col(order)).alias(f"_s_{m}") for m in names]
    ).withColumn("_sup", segment_of("_seg", FANOUT))
    sup = seg.groupBy(*keys, "_sup").agg(
        *[_AGG[specs[m][0]](F.col(f"_s_{m}"), F.col("_seg")).alias(f"_p_{m}") for m in names])

    def before(part, by):
        spec = Window.partitionBy(*part).orderBy(F.col(by).desc() if reverse else F.col(by))
        return spec.rowsBetween(Window.unboundedPreceding, -1)

    w_sup = before(keys, "_sup")
    sup = sup.select(*keys, "_sup", *[
        _OVER[specs[m][0]](F.col(f"_p_{m}")).over(w_sup).alias(f"_q_{m}") for m in names])
    w_seg = before([*keys, "_sup"], "_seg")
    carry = seg.join(sup, [*keys, "_sup"]).select(*keys, "_seg", *[
        _merge(specs[m][0], F.col(f"_q_{m}"),
               _OVER[specs[m][0]](F.col(f"_s_{m}")).over(w_seg)).alias(f"_c_{m}") for m in names])

    spec = Window.partitionBy(*keys, "_seg").orderBy(F.col(order).desc() if reverse else F.col(order))
    frame = spec.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = base.join(carry, [*keys, "_seg"])
    return out.select(*df.columns, *[
        _merge(specs[m][0], F.col(f"_c_{m}"),
               _OVER[specs[m][0]](F.col(f"_v_{m}")).over(frame)).alias(m) for m in names])


def attach(df, stats, keys=KEYS, order=ORDER, source=None) -> DataFrame:
    """Joins per-stream values to rows without ever hashing rows on the stream
    alone: the values are first spread to the stream's segments.  `source`: a
    cheaper table with the same keys and positions to find the segments in."""
    keys = list(keys)
    n = segment_length(df.sparkSession)
    rows = df.withColumn("_seg", segment_of(order, n))
    found = (df if source is None else source).select(*keys, segment_of(order, n).alias("_seg")).distinct()
    spread = found.join(stats, keys)
    return rows.join(spread, [*keys, "_seg"]).drop("_seg")


def stream_stats(df, aggs, keys=KEYS, order=ORDER) -> DataFrame:
    """Whole-stream aggregates next to every row (a window over the stream
    would put the stream into one task; this aggregates map-side)."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys, order)


def dense_index(df, keys, slice_col, order_by, name=ORDER) -> DataFrame:
    """0-based position in the stream.  `slice_col` must be non-decreasing in
    the order; rows are numbered inside a slice and shifted by earlier counts."""
    keys = list(keys)
    base = df.withColumn("_slice", slice_col)
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    return (base.join(shift, [*keys, "_slice"])
            .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long"))
            .drop("_slice", "_shift"))


def slot_of(x: Column, per_octave: int = 16384) -> Column:
    """Order-preserving slot number of a double, from its size alone: no bounds have to be known.
    NaN comes last, as in a sort, infinities before it; sizes above 1e290 share a slot."""
    size = F.floor(F.log2(F.lit(1.0) + F.least(F.abs(x), F.lit(1e290)) * F.lit(float(1 << 40))) * F.lit(float(per_octave)))
    endless = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(F.isnan(x), F.lit(1 << 61)).when(endless, F.signum(x).cast("long") * F.lit(1 << 60)).otherwise((F.signum(x) * size).cast("long"))


def in_ranges(df, order) -> DataFrame:
    """The rows of `df` dealt by ranges of the columns `order` and sorted: with `_range`, the range's number, and `_row`, the place in it.
    Stored, because the borders of ranges come from a sample and may differ when a plan runs again."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = cut_lineage(placed)
    return stored.select(*df.columns, F.shiftright("_at", ROW_BITS).alias("_range"), F.col("_at").bitwiseAND((1 << ROW_BITS) - 1).alias("_row"))


def rank_all(df, value, tie, name, part=()) -> DataFrame:
    """1-based rank of every row by (value, tie) inside `part`, in Spark's order: null first, NaN last.

    Rows are dealt by ranges of (part, value, tie), so neither a part, nor equal or close values, nor close ties meet in one task, and
    a range's rows are numbered where they stand; one row per part and range carries the counts of the ranges before.  Only
    rows equal in all three stay together; their ranks follow no order.  A null part is a part of its own."""
    part = list(part)
    rows = in_ranges(df.withColumns({"_x": value.cast("double"), "_t": tie}), [*part, "_x", "_t"])
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*part, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    shift = cells.select(*[F.col(p).alias(f"_p_{p}") for p in part], F.col("_range").alias("_at"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_at")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    return rows.join(shift, same).select(*df.columns, (F.col("_row") + F.col("_shift")).cast("long").alias(name))
