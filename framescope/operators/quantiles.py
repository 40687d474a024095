"""Exact interpolated quantiles per stream.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here ordered slots are counted first (map-side, so a large stream shuffles
no more than its slots), and only values in slots that hold a wanted rank are
shuffled and sorted.  Such a slot is cut once more into equal parts between its
least and largest value, so many close values don't meet in one task either.
Several columns share the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.operators.layout import KEYS, slot_of

PARTS = 4096


def quantiles(df: DataFrame, column, probs: dict[str, float], keys=KEYS) -> DataFrame:
    """One row per key: column `name` = value at (n-1)*p, linear between neighbours.
    A p given as ("at", p) picks the element at index int(n*p) instead."""
    value = F.col(column) if isinstance(column, str) else column
    return quantiles_of(df, {name: (value, p) for name, p in probs.items()}, keys)


def quantiles_of(df: DataFrame, specs: dict, keys=KEYS) -> DataFrame:
    """`specs`: name -> (column, p).  Nulls are left out; a key without values is absent, and a
    column without values for a key is null."""
    keys = list(keys)
    upto = Window.unboundedPreceding
    columns: list = []
    for col, _ in specs.values():
        if not any(col is c for c in columns):
            columns.append(col)
    place = {name: next(i for i, c in enumerate(columns) if c is col) for name, (col, _) in specs.items()}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), c.cast("double").alias("x")) for i, c in enumerate(columns)]))
    group = [*keys, "_c"]
    values = (df.select(*keys, pairs.alias("_p")).select(*keys, F.col("_p.c").alias("_c"), F.col("_p.x").alias("_x"))
              .where(F.col("_x").isNotNull()).withColumn("_b", slot_of(F.col("_x"))))
    slots = values.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    by_slot = Window.partitionBy(*group).orderBy("_b")
    slots = (slots.withColumn("_upto", F.sum("_m").over(by_slot.rowsBetween(upto, 0)))
             .withColumn("_all", F.sum("_m").over(Window.partitionBy(*group))))

    def position(p):
        if isinstance(p, tuple):
            return F.floor(F.col("_all") * F.lit(float(p[1]))).cast("double")
        return (F.col("_all") - 1) * F.lit(float(p))

    wanted = F.explode(F.filter(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(place[name]).alias("c"), position(p).alias("h"), r(position(p)).alias("r"))
        for name, (_, p) in specs.items() for r in (F.floor, F.ceil)]),
        lambda w: (w["c"] == F.col("_c")) & (w["r"] < F.col("_upto")) & (w["r"] >= F.col("_upto") - F.col("_m"))))
    hit = slots.withColumn("_w", wanted).select(
        *group, "_b", "_lo", "_hi", F.col("_w.q").alias("_q"), F.col("_w.h").alias("_h"),
        (F.col("_w.r") - F.col("_upto") + F.col("_m")).alias("_r"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(PARTS))), F.lit(PARTS - 1))).otherwise(0)
    shortlist = (values.join(hit.select(*group, "_b", "_lo", "_hi").distinct(), [*group, "_b"])
                 .groupBy(*group, "_b", part.alias("_s"), "_x").agg(F.count(F.lit(1)).alias("_n")))
    below = F.coalesce(F.sum("_k").over(Window.partitionBy(*group, "_b").orderBy("_s").rowsBetween(upto, -1)), F.lit(0))
    parts = shortlist.groupBy(*group, "_b", "_s").agg(F.sum("_n").alias("_k")).select(*group, "_b", "_s", below.alias("_below"))
    inside = F.sum("_n").over(Window.partitionBy(*group, "_b", "_s").orderBy("_x").rowsBetween(upto, 0))
    ordered = shortlist.join(parts, [*group, "_b", "_s"]).withColumn("_seen", F.col("_below") + inside)
    found = hit.drop("_lo", "_hi").join(ordered, [*group, "_b"]).where((F.col("_r") < F.col("_seen")) & (F.col("_r") >= F.col("_seen") - F.col("_n")))
    low, high = F.min("_x"), F.max("_x")
    picked = found.groupBy(*keys, "_q").agg((low + (high - low) * F.max(F.col("_h") - F.floor("_h"))).alias("_v"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in specs])
