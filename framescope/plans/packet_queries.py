"""Queries over packet logs and loss traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import packets as P
from framescope.functions import scalar as S
from framescope.operators import layout
from framescope.operators import packetlog as L
from framescope.plans import views as V
from framescope.plans.registry import draw_sql, query, r6, s6
from framescope.plans.scalar_queries import BW_SQL, CHAN_SQL, MODE_SQL, SPF_SQL
from framescope.plans.views import with_views

NEXT = """nx AS (SELECT *, coalesce(max(CASE WHEN lost=0 THEN frame_index END) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_received,
 min(CASE WHEN lost=0 THEN frame_index END) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_received FROM pk)"""


def recursion(base: str, init: str, step: str) -> str:
    """A recursive CTE `rec` walking every stream of `base` frame by frame."""
    return (f"rec AS (/*rec*/ SELECT stream_id, frame_index, {init} FROM {base} WHERE frame_index=0 UNION ALL "
            f"SELECT b.stream_id, b.frame_index, {step} FROM rec r JOIN {base} b ON b.stream_id=r.stream_id AND b.frame_index=r.frame_index+1)")


@query("a35_packet_census", with_views("pk", f"""SELECT mode, bandwidth, channels, frame_samples, grouping_id(mode, bandwidth, channels, frame_samples)::bigint AS level,
 count(*) AS packets, sum(len)::bigint AS bytes FROM (SELECT {MODE_SQL} AS mode, {BW_SQL} AS bandwidth, {CHAN_SQL} AS channels, {SPF_SQL} AS frame_samples, len FROM pk)
 GROUP BY CUBE (mode, bandwidth, channels, frame_samples)"""))
def a35(spark, sf):
    return L.census(V.packets(spark, sf))


@query("a37_check_audit", with_views("pk", """SELECT stream_id, count(*) FILTER (WHERE both_in AND "check"<>0 AND "check"<>dec) AS mismatches, count(*) FILTER (WHERE both_in) AS compared
 FROM (SELECT *, CASE WHEN event_id%7=0 THEN "check"+1 ELSE "check" END AS dec, lost=0 AND lag(lost,1,1) OVER (PARTITION BY stream_id ORDER BY frame_index)=0 AS both_in FROM pk) GROUP BY 1"""))
def a37(spark, sf):
    p = V.packets(spark, sf).withColumn(
        "decoded_check", F.when(F.col("event_id") % 7 == 0, F.col("check") + 1).otherwise(F.col("check")))
    return L.check_audit(p)


@query("a31_loss_share", with_views("pk", f"SELECT stream_id, {s6('avg(lost)', 'share')}, count(*) AS length FROM pk GROUP BY 1"))
def a31(spark, sf):
    return L.loss_share(V.packets(spark, sf)).select("stream_id", r6("share", "share"), "length")


@query("t04_ordered_traces", with_views("pk", """SELECT stream_id, row_number() OVER o AS place, (sum(length) OVER o - length)::bigint AS "offset"
 FROM (SELECT stream_id, avg(lost) AS share, count(*) AS length FROM pk GROUP BY 1) WINDOW o AS (ORDER BY share, stream_id)"""))
def t04(spark, sf):
    return L.ordered_traces(V.packets(spark, sf)).select("stream_id", "place", F.col("offset").cast("long").alias("offset"))


@query("a36_redundancy_rate", with_views("pk", "SELECT stream_id, round_even(avg(8*((len+7+3)//8))*50/1000, 0)::bigint AS kbps FROM pk GROUP BY 1"))
def a36(spark, sf):
    size = F.floor((F.col("len") + 7 + 3) / S.d(8)) * 8
    return V.packets(spark, sf).groupBy("stream_id").agg(L.redundancy_kbps(size).alias("kbps"))


@query("w16_silence_gate", with_views("tel", f"""SELECT stream_id, frame_index, CASE WHEN p>10 AND (p-11)%21<>20 THEN 1 ELSE 0 END AS gated FROM
 (SELECT *, frame_index - coalesce(max(CASE WHEN {draw_sql('event_id // 40', 5, 'talk')} < 0.4e0 THEN frame_index END) OVER (PARTITION BY stream_id ORDER BY frame_index), -1) AS p FROM tel)"""))
def w16(spark, sf):
    talk = S.draw(F.floor(F.col("event_id") / S.d(40)), 5, "talk") < S.d(0.4)
    return L.silence_gate(V.telemetry(spark, sf), talk).select("stream_id", "frame_index", "gated")


@query("w17_hysteresis_class", with_views("tel", "SELECT stream_id, frame_index, cls FROM rec",
       "b AS MATERIALIZED (SELECT stream_id, frame_index, packet_bytes*40e0 AS v, (packet_bytes*40>=9000)::int*2 + (packet_bytes*40>=13500)::int + (packet_bytes*40>=14000)::int AS i0 FROM tel)".replace("b AS", "base AS"),
       "st AS MATERIALIZED (SELECT *, [9000e0,9000e0,13500e0,14000e0] AS t, [700e0,700e0,1000e0,2000e0] AS h FROM base)",
       recursion("st", "(CASE WHEN i0>0 AND v<t[1]+h[1] THEN 0 ELSE i0 END)::bigint AS cls",
                 "(CASE WHEN i0>cls AND v<t[cls+1]+h[cls+1] THEN cls WHEN i0<cls AND v>t[cls]-h[cls] THEN cls ELSE i0 END)::bigint")))
def w17(spark, sf):
    t = V.telemetry(spark, sf).select("stream_id", "frame_index", "packet_bytes")
    return L.hysteresis_class(t, F.col("packet_bytes") * 40, L.BANDWIDTH_LIMITS, L.BANDWIDTH_MARGINS).select(
        "stream_id", "frame_index", "cls")


@query("w18_leaky_bucket", with_views("tel", "SELECT stream_id, frame_index, level, adjust FROM rec",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, packet_bytes*8-3000 AS x FROM tel)",
       recursion("base", "greatest(0, x) AS level, greatest(0, -x)//64 AS adjust", "greatest(0, r.level+b.x), greatest(0, -(r.level+b.x))//64")))
def w18(spark, sf):
    t = V.telemetry(spark, sf).select("stream_id", "frame_index", "packet_bytes")
    return L.leaky_bucket(t, F.col("packet_bytes") * 8 - 3000).select("stream_id", "frame_index", "level", "adjust")


@query("w29_loss_bursts", with_views("pk", "SELECT stream_id, prev_received, count(*) AS lost_count, max(next_received) AS ended_by FROM nx WHERE lost=1 GROUP BY ALL", NEXT))
def w29(spark, sf):
    return L.loss_bursts(V.packets(spark, sf))


@query("j14_feature_source", with_views("pk", "SELECT stream_id, frame_index, next_received AS source_index, next_received-frame_index AS distance FROM nx WHERE lost=1 AND next_received IS NOT NULL", NEXT))
def j14(spark, sf):
    return L.feature_source(V.packets(spark, sf))


@query("w30_recovery_source", with_views("pk", """SELECT n.stream_id, n.frame_index, CASE WHEN n.next_received IS NULL THEN 'pending' WHEN n.next_received=n.frame_index+1 AND p.has_lbrr=1 THEN 'low_rate'
 WHEN n.next_received-n.frame_index <= p.event_id%4 THEN 'redundancy' ELSE 'concealment' END AS source FROM nx n LEFT JOIN pk p ON p.stream_id=n.stream_id AND p.frame_index=n.next_received WHERE n.lost=1""", NEXT))
def w30(spark, sf):
    return L.recovery_source(V.packets(spark, sf).withColumn("cover", F.col("event_id") % 4))


def redundant(spark, sf):
    """Packets with eight feature values, oldest first, made from the event id."""
    return V.packets(spark, sf).withColumn("features", F.transform(
        F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("event_id") * i % 97).cast("double")))


@query("k12_assembled_features", with_views("pk", """SELECT stream_id, frame_index, src AS source_index, CASE WHEN back>8 THEN NULL ELSE (eid*(9-back) % 97)::double END AS f0, CASE WHEN back>8 THEN NULL ELSE (eid*(10-back) % 97)::double END AS f1 FROM (
 SELECT a.stream_id, a.frame_index, a.src, 2*(a.src-a.frame_index+1) AS back, p.event_id AS eid FROM (SELECT *, CASE WHEN lost=0 THEN frame_index ELSE coalesce(next_received, max(frame_index) OVER (PARTITION BY stream_id)) END AS src FROM nx) a
 JOIN pk p ON p.stream_id=a.stream_id AND p.frame_index=a.src)""", NEXT))
def k12(spark, sf):
    return L.assemble_features(redundant(spark, sf)).select(
        "stream_id", "frame_index", "source_index", F.col("assembled")[0].alias("f0"), F.col("assembled")[1].alias("f1"))


def payloads(spark, sf, *more: str):
    """Packets with their bytes, and the columns `more` of the view."""
    p = V.packets(spark, sf)
    filler = F.unhex(F.repeat(F.md5(F.col("event_id").cast("string")), F.floor(F.col("len") / 16.0).cast("int") + 1))
    head = F.unhex(F.concat(F.lpad(F.hex("toc"), 2, "0"), F.lpad(F.hex("b1"), 2, "0")))
    body = F.substring(filler, F.lit(1), F.greatest(F.col("len") - 2, F.lit(0)).cast("int"))
    return p.select("stream_id", "frame_index", "toc", F.concat(head, body).alias("payload"), *more)


_BYTE = "('0x' || substr(h, 2*pos+1, 2))::int"
HX = f"""hx AS MATERIALIZED (SELECT stream_id, frame_index, toc, b1, len, {SPF_SQL} AS spf, b1 & 63 AS m, len-1 AS n, CASE WHEN b1<252 THEN 1 ELSE 2 END AS k,
 CASE WHEN len<3 AND b1>=252 THEN -1 WHEN b1<252 THEN b1 ELSE 4*('0x'||substr(md5(event_id::varchar),1,2))::int + b1 END AS s,
 printf('%02x%02x', toc, b1) || substr(repeat(md5(event_id::varchar), len // 16 + 1), 1, 2*(len-2)) AS h FROM pk)"""
PAD = f"""pd AS (/*rec*/ SELECT stream_id, frame_index, 2::bigint AS pos, len-2 AS room, b1 & 64 = 0 AS done, m>0 AND m*spf<=5760 AS ok, 0::bigint AS pad FROM hx WHERE toc & 3 = 3 UNION ALL
 SELECT stream_id, frame_index, pos+1, room-1-(CASE WHEN byte=255 THEN 254 ELSE byte END), byte<>255 OR room<=0, ok AND room>0, pad+(CASE WHEN byte=255 THEN 254 ELSE byte END) FROM
 (SELECT pd.*, CASE WHEN room>0 THEN {_BYTE} ELSE 0 END AS byte FROM pd JOIN hx USING (stream_id, frame_index) WHERE ok AND NOT done))"""
VBR = f"""vb AS (SELECT pd.stream_id, pd.frame_index, 0::bigint AS i, pos, room, room AS last, true AS ok, 0::bigint AS got FROM pd JOIN hx USING (stream_id, frame_index) WHERE done AND ok AND room>=0 AND b1 & 128 <> 0 UNION ALL
 SELECT stream_id, frame_index, i+1, pos+used, room-used, last-used-size, size>=0 AND size<=room-used, size FROM (SELECT *, CASE WHEN room<1 OR (lead_ >= 252 AND room<2) THEN -1 WHEN lead_<252 THEN lead_ ELSE 4*('0x'||substr(h,2*pos+3,2))::int + lead_ END AS size,
  CASE WHEN lead_<252 THEN 1 ELSE 2 END AS used FROM (SELECT vb.*, h, m, CASE WHEN room>0 THEN {_BYTE} ELSE 0 END AS lead_ FROM vb JOIN hx USING (stream_id, frame_index) WHERE ok AND i<m-1)))"""


_VALID = """SELECT hx.stream_id, hx.frame_index, (CASE toc & 3 WHEN 0 THEN (CASE WHEN n<=1275 THEN 1 ELSE -1 END)
 WHEN 1 THEN (CASE WHEN n%2=0 AND n//2<=1275 THEN 2 ELSE -1 END) WHEN 2 THEN (CASE WHEN s<0 OR s>n-k OR n-k-s>1275 THEN -1 ELSE 2 END)
 ELSE (CASE WHEN pd.stream_id IS NULL OR room<0 THEN -1 WHEN b1 & 128 = 0 THEN (CASE WHEN room%m=0 AND room//m<=1275 THEN m ELSE -1 END) WHEN v.last BETWEEN 0 AND 1275 THEN m ELSE -1 END) END)::int AS frames
 FROM hx LEFT JOIN (SELECT * FROM pd WHERE done AND ok) pd ON pd.stream_id=hx.stream_id AND pd.frame_index=hx.frame_index
 LEFT JOIN (SELECT vb.stream_id, vb.frame_index, last FROM vb JOIN hx h2 ON h2.stream_id=vb.stream_id AND h2.frame_index=vb.frame_index WHERE ok AND i=m-1) v ON v.stream_id=hx.stream_id AND v.frame_index=hx.frame_index"""
FRAMES = f"""ok_ AS MATERIALIZED (SELECT * FROM ({_VALID}) WHERE frames>0), fin AS MATERIALIZED (SELECT * FROM pd WHERE done AND ok),
fr AS (SELECT stream_id, frame_index, toc, 0::bigint AS pad, f AS frame_no, CASE toc & 3 WHEN 0 THEN n WHEN 1 THEN n//2 ELSE CASE f WHEN 0 THEN s ELSE n-k-s END END AS frame_bytes FROM hx JOIN ok_ USING (stream_id, frame_index), range(0,2) r(f) WHERE toc & 3 <> 3 AND f < frames
 UNION ALL SELECT hx.stream_id, hx.frame_index, toc, pad, f, room//m FROM hx JOIN ok_ USING (stream_id, frame_index) JOIN fin USING (stream_id, frame_index), range(0,48) r(f) WHERE toc & 3 = 3 AND b1 & 128 = 0 AND f < m
 UNION ALL SELECT hx.stream_id, hx.frame_index, toc, pad, i-1, got FROM hx JOIN ok_ USING (stream_id, frame_index) JOIN fin USING (stream_id, frame_index) JOIN vb ON vb.stream_id=hx.stream_id AND vb.frame_index=hx.frame_index WHERE i BETWEEN 1 AND m-1
 UNION ALL SELECT hx.stream_id, hx.frame_index, toc, pad, i, last FROM hx JOIN ok_ USING (stream_id, frame_index) JOIN fin USING (stream_id, frame_index) JOIN vb ON vb.stream_id=hx.stream_id AND vb.frame_index=hx.frame_index WHERE i = m-1)"""


@query("x01_packet_frames", with_views("pk", "SELECT stream_id, frame_index, toc, pad AS padding, frame_no::int AS frame_no, frame_bytes::int AS frame_bytes FROM fr", HX, PAD, VBR, FRAMES))
def x01(spark, sf):
    return P.packet_frames(payloads(spark, sf))


@query("x01_packet_validity", with_views("pk", _VALID, HX, PAD, VBR))
def x01b(spark, sf):
    return P.parse_packets(payloads(spark, sf)).select("stream_id", "frame_index", F.coalesce(F.size("frame_sizes"), F.lit(-1)).alias("frames"))


_TWENTY_MS = f"greatest({SPF_SQL}//960, 1)"
_FIRST = "('0x' || substr(h, (2*(len-pad-total)+1)::bigint, 2))::int"


@query("p20_low_rate_copy", with_views("pk", f"""SELECT stream_id, frame_index, (CASE WHEN toc & 128 <> 0 THEN 0 WHEN total IS NULL THEN NULL WHEN first_size=0 THEN 0
 ELSE greatest(({_FIRST} >> (7-{_TWENTY_MS})::int) & 1, CASE WHEN toc & 4 <> 0 THEN ({_FIRST} >> (6-2*{_TWENTY_MS})::int) & 1 ELSE 0 END) END)::int AS flag
 FROM hx LEFT JOIN (SELECT stream_id, frame_index, sum(frame_bytes) AS total, max(pad) AS pad, min_by(frame_bytes, frame_no) AS first_size FROM fr GROUP BY ALL) f USING (stream_id, frame_index)""", HX, PAD, VBR, FRAMES))
def p20(spark, sf):
    """Frames stand before the padding, so the first one begins at length - padding - all frames.  Invalid packets give null."""
    p = P.parse_packets(payloads(spark, sf).withColumn("body", F.col("payload")))
    sizes = F.aggregate("frame_sizes", F.lit(0), lambda a, x: a + x)
    first = F.conv(F.hex(F.substring("body", (F.length("body") - F.col("padding") - sizes + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return p.select("stream_id", "frame_index", S.low_rate_copy_flag("toc", first, F.col("frame_sizes")[0]).alias("flag"))


@query("h03_parse_packet_udtf", with_views("pk", "SELECT stream_id, frame_index, frame_no::int AS frame_no, frame_bytes::int AS frame_bytes, true AS valid FROM fr UNION ALL SELECT stream_id, frame_index, NULL, NULL, false FROM hx ANTI JOIN ok_ USING (stream_id, frame_index)", HX, PAD, VBR, FRAMES))
def h03(spark, sf):
    p = payloads(spark, sf).select("stream_id", "frame_index", "payload")
    P.register_parse_packets(spark, p.drop("payload").schema.toDDL())
    p.createOrReplaceTempView("framescope_payloads")
    return spark.sql("SELECT * FROM parse_packets(TABLE(framescope_payloads))")


def bit_plan(spark, sf):
    """A plan that names some frames only; some of its values are not positive."""
    t = V.telemetry(spark, sf)
    return t.where(F.col("event_type") == "purchase").select(
        "stream_id", "frame_index", ((F.col("event_id") % 9 - 2) * 8000).alias("target_bitrate_bps"))


def plan_in_force(frames, plan, value, default):
    """Last positive plan value at or before the frame, else the default."""
    f = frames.join(plan.select("stream_id", "frame_index", F.col(value).alias("_v")), ["stream_id", "frame_index"], "left")
    f = layout.running(f, {"_last": ("last", F.when(F.col("_v") > 0, F.col("_v")))})
    return f.withColumn("in_force", F.coalesce("_last", default)).drop("_v", "_last")


@query("j05_plan_in_force", with_views("tel", """SELECT stream_id, frame_index, coalesce(last_value(CASE WHEN event_type='purchase' AND event_id%9>2 THEN (event_id%9-2)*8000 END IGNORE NULLS)
 OVER (PARTITION BY stream_id ORDER BY frame_index), requested_bitrate_bps) AS in_force FROM tel"""))
def j05(spark, sf):
    t = V.telemetry(spark, sf).select("stream_id", "frame_index", "requested_bitrate_bps")
    return plan_in_force(t, bit_plan(spark, sf), "target_bitrate_bps", F.col("requested_bitrate_bps")).select(
        "stream_id", "frame_index", "in_force")


@query("j01_zip_streams", with_views("tel", f"""SELECT a.stream_id, a.frame_index, a.packet_bytes, {s6('b.value', 'loudness')} FROM tel a
 JOIN (SELECT * FROM tel WHERE event_type<>'error') b USING (stream_id, frame_index)"""))
def j01(spark, sf):
    t = V.telemetry(spark, sf)
    short = t.where(F.col("event_type") != "error").select("stream_id", "frame_index", F.col("value").alias("v"))
    return t.select("stream_id", "frame_index", "packet_bytes").join(short, ["stream_id", "frame_index"]).select(
        "stream_id", "frame_index", "packet_bytes", r6("v", "loudness"))


@query("u04_truncated_frames", with_views("tel", """(SELECT stream_id, frame_index, 'common' AS side FROM (SELECT stream_id, frame_index FROM tel INTERSECT SELECT stream_id, frame_index FROM tel WHERE event_type<>'error'))
 UNION ALL (SELECT stream_id, frame_index, 'lost' FROM (SELECT stream_id, frame_index FROM tel EXCEPT SELECT stream_id, frame_index FROM tel WHERE event_type<>'error'))"""))
def u04(spark, sf):
    t = V.telemetry(spark, sf)
    keys = t.select("stream_id", "frame_index")
    short = t.where(F.col("event_type") != "error").select("stream_id", "frame_index")
    return (keys.intersect(short).withColumn("side", F.lit("common"))
            .unionByName(keys.exceptAll(short).withColumn("side", F.lit("lost"))))
