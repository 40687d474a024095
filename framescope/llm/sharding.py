"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells.  Every shard owns `vnodes` points on it; a key belongs to the first point clockwise from its
cell.  A shard takes rows up to its capacity, what comes later continues clockwise to the next shard with room.  Rows
of a cell arrive in the order of their rank in it, cells in a fixed scattered order, so the result does not depend on
how the table is partitioned.  Only counts per cell (at most 65,536 rows) reach the driver, which walks the ring once
and returns, for every cell, which ranks go to which shard.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.storage import col, stored

CELLS = 1 << 16
SCATTER = 40503  # odd, so multiplying by it permutes the cells
SUBCELLS = 64
STEP = 4096  # equal rows whose ranks are made by one task in one array


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  A shard's points do not depend on how many shards there are."""
    return sorted((int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:4], 16), s) for s in range(n_shards) for v in range(vnodes))


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """With no slack exact quotas, at most one apart; else (1 + slack) times the mean, rounded up."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def walk(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) for all rows of all cells."""
    points = ring(n_shards, vnodes)
    cells = [c for c, _ in points]
    room, used, pieces = capacities(sum(counts.values()), n_shards, slack), [0] * n_shards, []
    for cell in sorted(counts, key=lambda c: (c * SCATTER) % CELLS):
        left, rank, at = counts[cell], 0, bisect.bisect_left(cells, cell)
        while left:
            shard = points[at % len(points)][1]
            take = min(left, room[shard] - used[shard])
            if take > 0:
                pieces.append((cell, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return pieces


def cell_of(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")


def shard(docs: DataFrame, n_shards: int = 40, vnodes: int = 256, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (bytes of the text plus 16), text_crc32, shard, slot (gapless from 0 in every shard).

    A null text has 0 bytes and the checksum of the empty string; null keys share the cell of the empty string and spread
    by overflow.  Rows equal in key and text are counted together and get neighbouring slots.  An empty table gives no rows.
    Other columns are ignored.  `slack` trades balance for movement: 0 keeps row counts at most one apart.
    """
    spark = docs.sparkSession
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(key).alias("key"), (F.octet_length(t) + F.lit(16)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), cell_of(key).alias("cell"))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(SUBCELLS)).cast("int"))
    rows = stored(rows.groupBy("cell", "sub", "key", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    subs = rows.groupBy("cell", "sub").agg(F.sum("n").alias("n"))
    counts = {r["cell"]: r["n"] for r in subs.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most CELLS rows
    pieces = walk(counts, n_shards, vnodes, slack)
    plan = spark.createDataFrame(pieces, "pcell int, lo long, hi long, shard int, slot0 long")
    earlier = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = subs.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("cell", "sub").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("r", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["cell", "sub"])
    ranked = ranked.withColumn("first", F.col("offset") + F.col("r")).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STEP}"))))
    ranked = ranked.repartition("cell", "sub", "key", "step")  # copies of one row are dealt over tasks, STEP at a time
    start = F.col("first") + F.col("step") * STEP
    ranked = ranked.withColumn("rank", F.explode(F.sequence(start, F.least(start + STEP, F.col("first") + F.col("n")) - 1)))
    placed = ranked.join(F.broadcast(plan), (F.col("cell") == F.col("pcell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
