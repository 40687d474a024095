"""The same rules on live frames.

Windows, joins and duplicates are Spark's own stateful operators.  Rules in which every row depends on the one before it run in
event-time order (`ordered`), so their result does not depend on how the stream was cut into micro-batches: rows wait until the
watermark has passed them, and what has waited is run by `recurrence.scan`, segment by segment, from each stream's stored
state.  A stream with half of all rows is many groups there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.functions import scalar as S
from framescope.operators import layout, recurrence
from framescope.operators.packetlog import GATE_AFTER, GATE_MAX, hysteresis_steps
from framescope.operators.telemetry import spread_or_zero

FILE_ROWS = 1_000_000
BATCH_FILES = 6  # of a replay in a micro-batch, at most


def replay(spark: SparkSession, df: DataFrame, slice_col, slices: int, closing: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """A table as a stream, in order of (`slice_col`, `order`) and last the `closing` rows: one write into files of about FILE_ROWS rows, at
    least one per slice.  A micro-batch takes as many files as leave one micro-batch per slice, up to BATCH_FILES: each has costs of its own (state of
    all streams and windows is read and written), so their number should not grow with the table.  Rows equal in both stay together."""
    path = layout.scratch_path(spark, "replay")
    cut = layout.cut_lineage(df.withColumn("_slice", slice_col))
    files = max(slices, -(-cut.count() // FILE_ROWS))
    by = ["_slice", *([order] if order else [])]
    cut.repartitionByRange(files, *by).drop("_slice").write.parquet(path)
    # The file source reads by time of change: the files get times in their order, all in the past.
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-"))
    now = jvm.java.lang.System.currentTimeMillis()
    for i, part in enumerate(parts):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(part), now - 1000 * (len(parts) - i), -1)
    if closing is not None:
        closing.select(df.columns).coalesce(1).write.mode("append").parquet(path)  # its time is now, so it comes last
    per_batch = min(-(-len(parts) // slices), BATCH_FILES)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def closing_event(df: DataFrame, delay: str, size: str, ts: str = "ts") -> DataFrame:
    """The latest row, moved so far ahead that the watermark passes every window of `size` that `df` opens.  Its own window stays
    open, so it is in no result.  `df` holds the rows that reach the operator's watermark."""
    ahead = F.expr(f"interval {delay}") + F.expr(f"interval {size}") + F.expr("interval 1 second")
    return df.orderBy(F.col(ts).desc_nulls_last()).limit(1).withColumn(ts, F.col(ts) + ahead)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what is there and returns the result as a table.  Windows that the watermark has not passed stay open and are
    not in it; a replay that ends with a `closing_event` has none of its own."""
    spark = stream.sparkSession
    out, state = layout.scratch_path(spark, "stream-out"), layout.scratch_path(spark, "stream-state")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling_segments(frames: DataFrame, size: str, delay: str) -> DataFrame:
    f = frames.withColumn("difficulty", S.frame_difficulty()).withWatermark("ts", delay)
    raw = S.clamp(S.d(0.62) * F.avg("difficulty") + S.d(0.28) * F.max("difficulty")
                  + S.d(0.10) * S.clamp(spread_or_zero("packet_bytes") / S.d(250), 0, 1), 0, 1)
    return f.groupBy("stream_id", F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.avg("packet_bytes").alias("avg_packet_bytes"), raw.alias("raw_difficulty")).select(
        "stream_id", F.col("w.start").alias("start"), "frames", "avg_packet_bytes", "raw_difficulty")


def sliding_rates(frames: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    bits = F.col("packet_bytes") * 8
    return frames.withWatermark("ts", delay).groupBy("stream_id", F.window("ts", size, slide).alias("w")).agg(
        F.sum(bits).alias("bits"), F.max(bits).alias("max_bits"), F.count(F.lit(1)).alias("packets")).select(
        "stream_id", F.col("w.start").alias("start"), "bits", "max_bits", "packets")


def talk_spurts(frames: DataFrame, active, gap: str, delay: str) -> DataFrame:
    return frames.where(active).withWatermark("ts", delay).groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("frames")).select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "frames")


def without_duplicates(packets: DataFrame, delay: str) -> DataFrame:
    return packets.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stream_id", "seq"])


def live_comparison(base: DataFrame, candidate: DataFrame, delay: str, within: str) -> DataFrame:
    b = base.withWatermark("ts", delay).alias("b")
    c = candidate.withWatermark("ts", delay).alias("c")
    on = ((F.col("b.stream_id") == F.col("c.stream_id")) & (F.col("b.frame_index") == F.col("c.frame_index"))
          & (F.col("c.ts") >= F.col("b.ts") - F.expr(f"interval {within}")) & (F.col("c.ts") <= F.col("b.ts") + F.expr(f"interval {within}")))
    return b.join(c, on).select("b.stream_id", "b.frame_index", F.col("b.packet_bytes").alias("base_value"), F.col("c.packet_bytes").alias("plan_value"))


def with_static_plan(frames: DataFrame, plan: DataFrame, value: str, default) -> DataFrame:
    """As-of join with a fixed plan: its values hold until the next one, the last one for good.  The join is on stream and
    segment; an interval is copied into each segment it reaches, not to every frame."""
    length = layout.segment_length(frames.sparkSession)
    p = plan.where(F.col(value) > 0).select("stream_id", "frame_index", F.col(value).alias("_v"))
    nxt = layout.running(p, {"_next": ("first", F.col("frame_index"))}, reverse=True, exclusive=True)
    held = nxt.select("stream_id", "_v", F.col("frame_index").alias("_a"), F.coalesce(F.col("_next") - 1, F.col("frame_index")).alias("_z"))
    held = held.withColumn("_seg", F.explode(F.sequence(layout.segment_of("_a", length), layout.segment_of("_z", length))))
    last = p.groupBy("stream_id").agg(F.max("frame_index").alias("_from"), F.max_by("_v", "frame_index").alias("_last"))
    f = frames.withColumn("_seg", layout.segment_of("frame_index", length)).alias("f")
    within = (F.col("f.stream_id") == F.col("h.stream_id")) & (F.col("f._seg") == F.col("h._seg")) & F.col("frame_index").between(F.col("_a"), F.col("_z"))
    f = f.join(held.alias("h"), within, "left").select("f.*", "_v").join(last, "stream_id", "left")
    held = F.when(F.col("frame_index") >= F.col("_from"), F.col("_last"))
    return f.withColumn("in_force", F.coalesce("_v", held, default)).drop("_v", "_seg", "_from", "_last")


# ---------------------------------------------------------------- rules in event-time order
@dataclass
class Live:
    """A rule of recurrence.scan on a stream.  `prepare` puts the rule's columns on rows; `emit` makes the output from rows with `_before`
    and `_after`, the states around them."""

    prepare: Callable[[DataFrame], DataFrame]
    rule: object
    init: float
    emit: Callable[[DataFrame], DataFrame]


def _table(spark, path, name, schema=None):
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{name}")


def start_ordered(stream: DataFrame, live: Live, out: str, delay: str, expire: str | None = None, ts: str = "ts", tie: str = "seq", keys=("stream_id",)):
    """Starts the query.  Below `out`: `rows` (the rule's output), `late` (rows older than the watermark when they came: counted there, not
    used), `state-<batch>` and the query's checkpoint.

    The watermark is the largest `ts` so far less `delay`.  Rows at or after it wait.  Rows before it run in order of (`ts`, `tie`) from their stream's
    state, which is dropped when the stream has been silent for `expire` longer than the delay.  Each micro-batch reads the state that the one
    before it wrote and overwrites its own folders, so a repeated one gives the same rows once."""
    keys, schema = list(keys), stream.schema
    state_in = f"{', '.join(f'{k} {schema[k].dataType.simpleString()}' for k in keys)}, _in {live.rule.type.simpleString()}, _seen timestamp"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before, now = f"{out}/state-{number - 1}", f"{out}/state-{number}"
        mark, states = None, spark.createDataFrame([], state_in)
        if number:
            mark, states = _table(spark, before, "mark").first()[0], _table(spark, before, "streams", state_in)
        rows.select(*schema.names, F.lit(number).alias("_batch")).write.mode("overwrite").parquet(f"{now}/came")
        came = _table(spark, now, "came").drop("_batch")
        on_time = F.lit(True) if mark is None else F.col(ts) >= F.lit(mark)
        came.where(~on_time).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        pool = came.where(on_time)
        if number:
            pool = pool.unionByName(_table(spark, before, "waiting", schema))
        top = pool.agg(F.max(ts) - F.expr(f"interval {delay}")).first()[0]
        mark = max((m for m in (mark, top) if m is not None), default=None)
        passed = F.lit(False) if mark is None else F.col(ts) < F.lit(mark)
        pool.where(~passed).write.mode("overwrite").parquet(f"{now}/waiting")
        minute = F.floor(F.unix_micros(ts) / F.lit(6e7))
        ready = layout.cut_lineage(layout.dense_index(pool.where(passed), keys, minute, [ts, tie], "_at"))
        run = layout.cut_lineage(recurrence.scan(live.prepare(ready), live.rule, "_after", live.init, keys, "_at", states.select(*keys, "_in"), "_before"))
        live.emit(run).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        ends = run.groupBy(*keys).agg(F.max_by("_after", "_at").alias("_in"), F.max(ts).alias("_seen"))
        ends = ends.unionByName(states).groupBy(*keys).agg(F.max_by("_in", "_seen").alias("_in"), F.max("_seen").alias("_seen"))
        if expire and mark is not None:
            ends = ends.where(F.col("_seen") >= F.lit(mark) - F.expr(f"interval {expire}"))
        ends.write.mode("overwrite").parquet(f"{now}/streams")
        spark.range(1).select(F.lit(mark).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{now}/mark")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def ordered(stream: DataFrame, live: Live, delay: str, **params) -> DataFrame:
    """Processes what is there and returns the rule's output as a table; what the watermark has not passed is not in it."""
    spark = stream.sparkSession
    out = layout.scratch_path(spark, "ordered")
    start_ordered(stream, live, out, delay, **params).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def silence_gate(unit_ms: int = 10) -> Live:
    """Exact for frames of any whole number of units: needs seq, frame_ms and active."""
    low, high = GATE_AFTER * 20 // unit_ms, (GATE_AFTER + GATE_MAX) * 20 // unit_ms

    def prepare(f):
        more = F.floor(F.col("frame_ms") / F.lit(float(unit_ms)))
        quiet = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(high).cast("long")), lambda q: F.when(q + more > high, F.lit(low).cast("long")).otherwise(q + more))
        return f.withColumn("_map", F.when(F.col("active"), F.array_repeat(F.lit(0).cast("long"), high + 1)).otherwise(quiet))

    return Live(prepare, recurrence.StateMap(high + 1), 0,
                lambda f: f.select("stream_id", "seq", (~F.col("active") & (F.col("_after") > low)).cast("int").alias("gated")))


def class_changes(limits, margins) -> Live:
    """Class with hysteresis over `value`; only changes are passed on."""
    return Live(lambda f: hysteresis_steps(f, F.col("value"), limits, margins), recurrence.FiniteState(len(limits) + 1), 0,
                lambda f: f.where("_after != _before").select("stream_id", "seq", F.col("_after").cast("int").alias("cls")))


def bucket_alarm(limit: int) -> Live:
    """Level of a leaky bucket filled by `excess`; passes on frames at or above the limit."""
    return Live(lambda f: recurrence.clamped(f, 1.0, F.col("excess"), 0.0), recurrence.ClampedLinear, 0.0,
                lambda f: f.where(F.col("_after") >= limit).select("stream_id", "seq", F.col("_after").cast("long").alias("level")))


# ---------------------------------------------------------------- gaps, in order of arrival
def gap_ranges(packets: DataFrame, delay: str, starts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """stream_id, first, last, event for packets with stream_id, seq, ts (sent) and arrival, in order of (arrival, seq).  lost when
    numbers are skipped (one row, however long the gap); a skipped number that arrives after all is restored if it was sent no
    more than `delay` before the latest packet so far, else late, as is one that comes twice (counted, not used).

    `starts` (stream_id, top, latest) and `known` (stream_id, seq) tell what came before this table."""
    order = F.floor(F.unix_micros("arrival") / F.lit(6e7))
    p = layout.dense_index(packets.select("stream_id", "seq", "ts", "arrival"), ["stream_id"], order, ["arrival", "seq", "ts"], "_at")
    p = layout.running(layout.cut_lineage(p), {"_top": ("max", F.col("seq")), "_latest": ("max", F.col("ts"))}, order="_at", exclusive=True)
    if starts is not None:
        p = p.join(starts, "stream_id", "left").withColumns({"_top": F.greatest("_top", "top"), "_latest": F.greatest("_latest", "latest")})
    again = F.row_number().over(Window.partitionBy("stream_id", "seq").orderBy("_at")) > 1
    p = p.withColumn("_again", again).withColumn("_top", F.coalesce("_top", F.lit(-1).cast("long")))
    if known is not None:
        p = p.join(known.select("stream_id", "seq", F.lit(True).alias("_known")), ["stream_id", "seq"], "left").withColumn("_again", F.col("_again") | F.coalesce("_known", F.lit(False)))
    lost = p.where(F.col("seq") > F.col("_top") + 1).select("stream_id", (F.col("_top") + 1).alias("first"), (F.col("seq") - 1).alias("last"), F.lit("lost").alias("event"))
    fine = ~F.col("_again") & (F.col("ts") >= F.col("_latest") - F.expr(f"interval {delay}"))
    back = p.where(F.col("seq") <= F.col("_top")).select("stream_id", F.col("seq").alias("first"), F.col("seq").alias("last"), F.when(fine, "restored").otherwise("late").alias("event"))
    return lost.unionByName(back)


def live_gaps(stream: DataFrame, delay: str) -> DataFrame:
    """`gap_ranges` of a stream whose micro-batches come in order of arrival, as a table.  State: each stream's largest number and time, and the
    numbers sent within the delay (older ones are late in any case)."""
    spark = stream.sparkSession
    out, names = layout.scratch_path(spark, "gaps"), ["stream_id", "seq", "ts", "arrival"]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before, now = f"{out}/state-{number - 1}", f"{out}/state-{number}"
        rows.select(names).write.mode("overwrite").parquet(f"{now}/came")
        came = _table(spark, now, "came")
        starts, known = (_table(spark, before, "tops"), _table(spark, before, "known")) if number else (None, None)
        gap_ranges(came, delay, starts, known).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        tops = came.groupBy("stream_id").agg(F.max("seq").alias("top"), F.max("ts").alias("latest"))
        seen = came.select("stream_id", "seq", "ts")
        if number:
            tops = tops.unionByName(starts).groupBy("stream_id").agg(F.max("top").alias("top"), F.max("latest").alias("latest"))
            seen = seen.unionByName(known)
        tops.write.mode("overwrite").parquet(f"{now}/tops")
        recent = seen.join(_table(spark, now, "tops"), "stream_id").where(F.col("ts") >= F.col("latest") - F.expr(f"interval {delay}"))
        recent.groupBy("stream_id", "seq").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{now}/known")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def gap_events(ranges: DataFrame, block: int = 1 << 16) -> DataFrame:
    """One row per number of `gap_ranges`, made `block` at a time."""
    r = ranges.withColumn("_from", F.explode(F.sequence("first", "last", F.lit(block))))
    return r.select("stream_id", F.explode(F.sequence("_from", F.least("last", F.col("_from") + (block - 1)))).alias("seq"), "event")
