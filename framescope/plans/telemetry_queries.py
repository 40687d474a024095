"""Queries over frame telemetry: segments, rates, comparison, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import scalar as S
from framescope.operators import quantiles
from framescope.operators import telemetry as T
from framescope.plans import views as V
from framescope.plans.registry import clamp_sql as CL
from framescope.plans.registry import query, r6, s6
from framescope.plans.scalar_queries import DIFFICULTY_SQL
from framescope.plans.views import with_views

PER = 10
DIFF = f"fd AS (SELECT *, {DIFFICULTY_SQL} AS difficulty, frame_index//{PER} AS segment_index FROM tel)"
SEG = f"""seg AS (SELECT stream_id, segment_index, count(*) AS frames, sum(input_samples) AS samples, avg(packet_bytes) AS avg_packet_bytes,
 CASE WHEN count(*)<2 THEN 0 ELSE stddev_pop(packet_bytes) END AS packet_stddev, avg(activity) AS mean_activity, avg(tonality) AS mean_tonality,
 avg(music_prob) AS mean_music_prob, avg(bandwidth) AS mean_bandwidth,
 {CL("0.62e0*avg(difficulty) + 0.28e0*max(difficulty) + 0.10e0*" + CL("(CASE WHEN count(*)<2 THEN 0 ELSE stddev_pop(packet_bytes) END)/250e0"))} AS raw_difficulty
 FROM fd GROUP BY ALL)"""
SM = """sm0 AS (SELECT *, (2*raw_difficulty + coalesce(lag(raw_difficulty) OVER w,0) + coalesce(lead(raw_difficulty) OVER w,0))
 / (2 + CASE WHEN lag(raw_difficulty) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(raw_difficulty) OVER w IS NULL THEN 0 ELSE 1 END) AS smoothed_difficulty,
 avg(raw_difficulty) OVER (PARTITION BY stream_id) AS mu, stddev_pop(raw_difficulty) OVER (PARTITION BY stream_id) AS sd
 FROM seg WINDOW w AS (PARTITION BY stream_id ORDER BY segment_index))"""
SM2 = f"""sm AS (SELECT *, {CL("1 + 0.1e0*(CASE WHEN sd > 1e-9 THEN (smoothed_difficulty-mu)/sd ELSE 0e0 END)", 0.85, 1.15)} AS budget_scale,
 CASE WHEN smoothed_difficulty>=0.82e0 THEN 'killer' WHEN smoothed_difficulty>=0.67e0 THEN 'hard' WHEN smoothed_difficulty>=0.50e0 THEN 'active'
 WHEN smoothed_difficulty>=0.32e0 THEN 'steady' ELSE 'easy' END AS segment_class FROM sm0)"""
CTES = (DIFF, SEG, SM, SM2)


def segments(spark, sf):
    return T.smooth_and_budget(T.summarize_segments(V.telemetry(spark, sf), PER))


def planned(spark, sf):
    """The same frames under a plan: bytes scaled by activity."""
    return V.telemetry(spark, sf).withColumn(
        "packet_bytes", F.floor(F.col("packet_bytes") * (S.d(0.5) + F.col("activity"))).cast("long"))


PLANNED = "pl AS (SELECT * REPLACE (floor(packet_bytes*(0.5e0+activity))::bigint AS packet_bytes) FROM tel)"


@query("a01_rate_statistics", with_views("tel", f"""SELECT stream_id, {s6('48e0*sum(packet_bytes*8)/sum(input_samples)', 'average_kbps')},
 {s6('48e0*max(packet_bytes*8)/960', 'maximum_kbps')},
 {s6('48e0*coalesce(sum(packet_bytes*8) FILTER (WHERE value*1000>1e5),0)/(1e-15+960*count(*) FILTER (WHERE value*1000>1e5))', 'active_kbps')},
 {s6('48e0*stddev_pop(packet_bytes*8)/960', 'deviation_kbps')} FROM tel GROUP BY 1"""))
def a01(spark, sf):
    out = T.rate_statistics(V.telemetry(spark, sf), F.col("value") * 1000 > S.d(1e5))
    return out.select("stream_id", *[r6(c, c) for c in out.columns[1:]])


_A2 = ["avg_packet_bytes", "packet_stddev", "mean_activity", "mean_tonality", "mean_music_prob", "mean_bandwidth", "start_s", "end_s"]


@query("a02_segment_summary", with_views("tel", f"""SELECT stream_id, segment_index, frames, {', '.join(s6(c, c) for c in _A2)} FROM
 (SELECT *, (sum(samples) OVER w - samples)/48000e0 AS start_s, sum(samples) OVER w/48000e0 AS end_s FROM seg WINDOW w AS (PARTITION BY stream_id ORDER BY segment_index))""", DIFF, SEG))
def a02(spark, sf):
    s = T.summarize_segments(V.telemetry(spark, sf), PER)
    return s.select("stream_id", "segment_index", "frames", *[r6(c, c) for c in _A2])


@query("a03_raw_difficulty", with_views("tel", f"SELECT stream_id, segment_index, {s6('raw_difficulty', 'raw_difficulty')} FROM seg", DIFF, SEG))
def a03(spark, sf):
    s = T.summarize_segments(V.telemetry(spark, sf), PER)
    return s.select("stream_id", "segment_index", r6("raw_difficulty", "raw_difficulty"))


@query("a04_difficulty_byte_correlation", with_views("tel", f"SELECT stream_id, {s6('coalesce(corr(difficulty, packet_bytes),0)', 'correlation')} FROM fd GROUP BY 1", DIFF))
def a04(spark, sf):
    t = V.telemetry(spark, sf).withColumn("difficulty", S.frame_difficulty())
    return t.groupBy("stream_id").agg(r6(T.correlation_or_zero("difficulty", "packet_bytes"), "correlation"))


@query("a05_packet_deviation", with_views("tel", f"""SELECT stream_id, {s6('stddev_pop(packet_bytes) FILTER (WHERE kind=0)', 'baseline')},
 {s6('stddev_pop(packet_bytes) FILTER (WHERE kind=1)', 'planned')} FROM (SELECT stream_id, packet_bytes, 0 AS kind FROM tel UNION ALL SELECT stream_id, packet_bytes, 1 FROM pl) GROUP BY 1""", PLANNED))
def a05(spark, sf):
    both = T.paired(V.telemetry(spark, sf), planned(spark, sf), "packet_bytes")
    return both.groupBy("stream_id").agg(r6(F.stddev_pop("base_value"), "baseline"), r6(F.stddev_pop("plan_value"), "planned"))


@query("j03_baseline_candidate", with_views("tel", "SELECT t.stream_id, t.frame_index, t.packet_bytes AS base_value, p.packet_bytes AS plan_value FROM tel t JOIN pl p USING (stream_id, frame_index)", PLANNED))
def j03(spark, sf):
    return T.paired(V.telemetry(spark, sf), planned(spark, sf), "packet_bytes").select(
        "stream_id", "frame_index", "base_value", "plan_value")


@query("w04_smoothed_budget", with_views("tel", f"SELECT stream_id, segment_index, segment_class, {s6('smoothed_difficulty', 'smoothed_difficulty')}, {s6('budget_scale', 'budget_scale')} FROM sm", *CTES))
def w04(spark, sf):
    return segments(spark, sf).select("stream_id", "segment_index", "segment_class",
                                      r6("smoothed_difficulty", "smoothed_difficulty"), r6("budget_scale", "budget_scale"))


@query("t01_extreme_segments", with_views("tel", f"""SELECT stream_id, segment_index, extreme, place::int AS place, segment_class, {s6('smoothed_difficulty', 'smoothed_difficulty')}, {s6('budget_scale', 'budget_scale')} FROM (
 SELECT *, 'hardest' AS extreme, row_number() OVER (PARTITION BY stream_id ORDER BY smoothed_difficulty DESC, segment_index) AS place FROM sm
 UNION ALL SELECT *, 'easiest', row_number() OVER (PARTITION BY stream_id ORDER BY smoothed_difficulty, segment_index) FROM sm) WHERE place <= 3""", *CTES))
def t01(spark, sf):
    return T.extreme_segments(segments(spark, sf), 3).select(
        "stream_id", "segment_index", "extreme", "place", "segment_class",
        r6("smoothed_difficulty", "smoothed_difficulty"), r6("budget_scale", "budget_scale"))


@query("t01_extreme_bytes", with_views("tel", f"""SELECT stream_id, extreme, {s6('avg(avg_packet_bytes)', 'baseline')}, {s6('avg(plan_bytes)', 'planned')} FROM (
 SELECT *, 'hardest' AS extreme, row_number() OVER (PARTITION BY stream_id ORDER BY smoothed_difficulty DESC, segment_index) AS place FROM sm
 UNION ALL SELECT *, 'easiest', row_number() OVER (PARTITION BY stream_id ORDER BY smoothed_difficulty, segment_index) FROM sm) x
 JOIN (SELECT stream_id, frame_index//{PER} AS segment_index, avg(packet_bytes) AS plan_bytes FROM pl GROUP BY ALL) y USING (stream_id, segment_index)
 WHERE place <= 3 GROUP BY ALL""", *CTES, PLANNED))
def t01b(spark, sf):
    other = T.summarize_segments(planned(spark, sf), PER).select(
        "stream_id", "segment_index", F.col("avg_packet_bytes").alias("plan_bytes"))
    picked = T.extreme_segments(segments(spark, sf), 3).join(other, ["stream_id", "segment_index"])
    return picked.groupBy("stream_id", "extreme").agg(
        r6(F.avg("avg_packet_bytes"), "baseline"), r6(F.avg("plan_bytes"), "planned"))


@query("j06_frame_to_segment", with_views("tel", f"SELECT stream_id, frame_index, segment_index, segment_class FROM fd JOIN sm USING (stream_id, segment_index)", *CTES))
def j06(spark, sf):
    out = T.frame_to_segment(V.telemetry(spark, sf), segments(spark, sf), PER, ["segment_class"])
    return out.select("stream_id", "frame_index", "segment_index", "segment_class")


@query("w03_stream_thresholds", with_views("tel", f"""SELECT stream_id, {s6('quantile_cont(activity, 0.94)', 'strong')}, {s6('quantile_cont(activity, 0.85)', 'medium')},
 {s6('quantile_cont(value, 0.92)', 'onset')}, {s6('quantile_cont(value, 0.5)', 'median')} FROM tel GROUP BY 1"""))
def w03(spark, sf):
    t = V.telemetry(spark, sf).select("stream_id", "activity", "value")
    a, v = F.col("activity"), F.col("value")
    q = quantiles.quantiles_of(t, {"strong": (a, 0.94), "medium": (a, 0.85), "onset": (v, 0.92), "median": (v, 0.5)})
    return q.select("stream_id", *[r6(c, c) for c in ("strong", "medium", "onset", "median")])
