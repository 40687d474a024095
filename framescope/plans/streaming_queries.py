"""Queries that replay a table as a stream and read the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import scalar as S
from framescope.operators.packetlog import BANDWIDTH_LIMITS, BANDWIDTH_MARGINS
from framescope.plans import views as V
from framescope.plans.packet_queries import bit_plan, recursion
from framescope.plans.registry import clamp_sql as CL
from framescope.plans.registry import draw_sql, query, r6, s6
from framescope.plans.scalar_queries import DIFFICULTY_SQL
from framescope.plans.views import with_views
from framescope.streaming import operators as ST

DELAY = "1 day"
SLICES = 3


def third(ts):
    """Days 1-10, 11-20 and the rest of the month."""
    return F.least(F.lit(2), F.floor((F.dayofmonth(ts) - 1) / S.d(10)).cast("int"))


def live(spark, sf, window=None, reaching=None):
    """Telemetry as a stream with a real timestamp.  With `window`, a last event closes the windows of that size; only rows where `reaching` holds
    get to them."""
    t = V.telemetry(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    closing = ST.closing_event(t if reaching is None else t.where(reaching), DELAY, window) if window else None
    return ST.replay(spark, t, third(F.col("ts")), SLICES, closing, order="ts")


def plain(col):
    return F.col(col).cast("timestamp_ntz").alias(col)


def _start(hours: int, every: int) -> str:
    return f"(TIMESTAMP '2024-01-01' + INTERVAL (h*{every}) HOUR)"


@query("st01_tumbling_segments", with_views("tel", f"""SELECT stream_id, TIMESTAMP '2024-01-01' + to_hours((12*h)::bigint) AS "start", count(*) AS frames, {s6('avg(packet_bytes)', 'avg_packet_bytes')},
 {s6(CL("0.62e0*avg(d)+0.28e0*max(d)+0.10e0*" + CL("(CASE WHEN count(*)<2 THEN 0 ELSE stddev_pop(packet_bytes) END)/250e0")), 'raw_difficulty')}
 FROM (SELECT *, {DIFFICULTY_SQL} AS d, floor((epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/43200)::bigint AS h FROM tel) GROUP BY stream_id, h"""))
def st01(spark, sf):
    out = ST.run_to_table(ST.tumbling_segments(live(spark, sf, "12 hours"), "12 hours", DELAY))
    return out.select("stream_id", plain("start"), "frames", r6("avg_packet_bytes", "avg_packet_bytes"), r6("raw_difficulty", "raw_difficulty"))


@query("st02_sliding_rates", with_views("tel", f"""SELECT stream_id, TIMESTAMP '2024-01-01' + to_hours((4*(h-k))::bigint) AS "start", sum(packet_bytes*8)::bigint AS bits, max(packet_bytes*8) AS max_bits, count(*) AS packets
 FROM (SELECT *, floor((epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/14400)::bigint AS h FROM tel), range(0,3) r(k) GROUP BY stream_id, h-k"""))
def st02(spark, sf):
    out = ST.run_to_table(ST.sliding_rates(live(spark, sf, "12 hours"), "12 hours", "4 hours", DELAY))
    return out.select("stream_id", plain("start"), "bits", "max_bits", "packets")


@query("st03_talk_spurts", with_views("tel", f"""SELECT stream_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS frames FROM (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts) AS g FROM (
 SELECT stream_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM tel WHERE event_type<>'error')) GROUP BY stream_id, g"""))
def st03(spark, sf):
    talking = F.col("event_type") != "error"
    out = ST.run_to_table(ST.talk_spurts(live(spark, sf, "6 hours", talking), talking, "6 hours", DELAY))
    return out.select("stream_id", plain("start"), plain("stop"), "frames")


_TALK = draw_sql("event_id // 40", 5, "talk")


@query("st04_silence_gate", with_views("tel", "SELECT stream_id, frame_index AS seq, g AS gated FROM rec",
       f"base AS MATERIALIZED (SELECT stream_id, frame_index, {_TALK} < 0.4e0 AS active, [10,20,40,60][event_id%4+1] AS ms FROM tel)",
       recursion("base", "CASE WHEN active THEN 0 ELSE ms END AS q, 0 AS g",
                 "CASE WHEN b.active THEN 0 WHEN r.q+b.ms>600 THEN 200 ELSE r.q+b.ms END, CASE WHEN NOT b.active AND r.q+b.ms>200 AND r.q+b.ms<=600 THEN 1 ELSE 0 END")))
def st04(spark, sf):
    ms = F.element_at(F.array(*[F.lit(v) for v in (10, 20, 40, 60)]), (F.col("event_id") % 4 + 1).cast("int"))
    f = live(spark, sf, "1 second").select("stream_id", "ts", F.col("frame_index").alias("seq"), ms.alias("frame_ms"),
                                           (S.draw(F.floor(F.col("event_id") / S.d(40)), 5, "talk") < S.d(0.4)).alias("active"))
    return ST.ordered(f, ST.silence_gate(), DELAY)


@query("st05_class_changes", with_views("tel", "SELECT stream_id, frame_index AS seq, cls::int AS cls FROM (SELECT *, coalesce(lag(cls) OVER (PARTITION BY stream_id ORDER BY frame_index), 0) AS before FROM rec) WHERE cls<>before",
       "st AS MATERIALIZED (SELECT stream_id, frame_index, packet_bytes*40e0 AS v, (packet_bytes*40>=9000)::int*2 + (packet_bytes*40>=13500)::int + (packet_bytes*40>=14000)::int AS i0, [9000e0,9000e0,13500e0,14000e0] AS t, [700e0,700e0,1000e0,2000e0] AS h FROM tel)",
       recursion("st", "(CASE WHEN i0>0 AND v<t[1]+h[1] THEN 0 ELSE i0 END)::bigint AS cls",
                 "(CASE WHEN i0>cls AND v<t[cls+1]+h[cls+1] THEN cls WHEN i0<cls AND v>t[cls]-h[cls] THEN cls ELSE i0 END)::bigint")))
def st05(spark, sf):
    f = live(spark, sf, "1 second").select("stream_id", "ts", F.col("frame_index").alias("seq"), (F.col("packet_bytes") * 40).cast("double").alias("value"))
    return ST.ordered(f, ST.class_changes(BANDWIDTH_LIMITS, BANDWIDTH_MARGINS), DELAY)


@query("st06_bucket_alarm", with_views("tel", "SELECT stream_id, frame_index AS seq, level FROM rec WHERE level>=5000",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, packet_bytes*8-3000 AS x FROM tel)", recursion("base", "greatest(0, x) AS level", "greatest(0, r.level+b.x)")))
def st06(spark, sf):
    f = live(spark, sf, "1 second").select("stream_id", "ts", F.col("frame_index").alias("seq"), (F.col("packet_bytes") * 8 - 3000).alias("excess"))
    return ST.ordered(f, ST.bucket_alarm(5000), DELAY)


_LATE = draw_sql("event_id", 43, "late")


@query("st07_gap_events", with_views("tel", """SELECT stream_id, unnest(range(top+1, seq)) AS seq, 'lost' AS event FROM pt WHERE seq > top+1
 UNION ALL SELECT stream_id, seq, CASE WHEN ts >= latest - INTERVAL 1 DAY THEN 'restored' ELSE 'late' END FROM pt WHERE seq <= top""",
       f"""pa AS (SELECT stream_id, frame_index AS seq, ts, ts + to_hours((CASE WHEN {_LATE} < 0.05e0 THEN 240 WHEN {_LATE} < 0.5e0 THEN 12 ELSE 0 END)::bigint) AS arrival FROM tel WHERE event_type<>'error')""",
       """pt AS (SELECT *, coalesce(max(seq) OVER w, -1) AS top, max(ts) OVER w AS latest FROM pa WINDOW w AS (PARTITION BY stream_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def st07(spark, sf):
    """Packets of type error never arrive; some others arrive half a day or ten days late."""
    t = V.telemetry(spark, sf).where(F.col("event_type") != "error").withColumn("ts", F.col("ts").cast("timestamp"))
    draw = S.draw("event_id", 43, "late")
    hours = F.when(draw < S.d(0.05), 240).when(draw < S.d(0.5), 12).otherwise(0)
    p = t.select("stream_id", F.col("frame_index").alias("seq"), "ts", F.timestamp_micros(F.unix_micros("ts") + hours * F.lit(3_600_000_000)).alias("arrival"))
    return ST.gap_events(ST.live_gaps(ST.replay(spark, p, F.lit(0), SLICES, order="arrival"), DELAY))


@query("st08_without_duplicates", with_views("tel", "SELECT stream_id, frame_index AS seq, packet_bytes FROM tel"))
def st08(spark, sf):
    f = live(spark, sf).select("stream_id", F.col("frame_index").alias("seq"), "ts", "packet_bytes", "event_id")
    twice = f.withColumn("_n", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n", "event_id")
    return ST.run_to_table(ST.without_duplicates(twice, DELAY)).select("stream_id", "seq", "packet_bytes")


@query("st09_live_comparison", with_views("tel", "SELECT stream_id, frame_index, packet_bytes AS base_value, floor(packet_bytes*(0.5e0+activity))::bigint AS plan_value FROM tel"))
def st09(spark, sf):
    base = live(spark, sf).select("stream_id", "frame_index", "ts", "packet_bytes")
    cand = live(spark, sf).select("stream_id", "frame_index", (F.col("ts") + F.expr("interval 30 minutes")).alias("ts"),
                                  F.floor(F.col("packet_bytes") * (S.d(0.5) + F.col("activity"))).cast("long").alias("packet_bytes"))
    return ST.run_to_table(ST.live_comparison(base, cand, DELAY, "1 hour"))


@query("st10_static_plan", with_views("tel", """SELECT stream_id, frame_index, coalesce(last_value(CASE WHEN event_type='purchase' AND event_id%9>2 THEN (event_id%9-2)*8000 END IGNORE NULLS)
 OVER (PARTITION BY stream_id ORDER BY frame_index), requested_bitrate_bps) AS in_force FROM tel"""))
def st10(spark, sf):
    f = live(spark, sf).select("stream_id", "frame_index", "requested_bitrate_bps")
    out = ST.with_static_plan(f, bit_plan(spark, sf), "target_bitrate_bps", F.col("requested_bitrate_bps"))
    return ST.run_to_table(out).select("stream_id", "frame_index", "in_force")
