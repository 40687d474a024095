"""Queries for smoothing, trackers and other ordered rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import smoothing as M
from framescope.plans import views as V
from framescope.plans.packet_queries import recursion
from framescope.plans.registry import query, r6, s6
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]
LAG_SQL = "CASE WHEN event_type IN ('error','signup') THEN 0 ELSE 32 + event_id%200 END"


def lags(spark, sf):
    t = V.telemetry(spark, sf)
    return t.select(*ID, F.when(F.col("event_type").isin("error", "signup"), F.lit(0)).otherwise(32 + F.col("event_id") % 200).alias("lag"))


@query("w11_decayed_sum", with_views("tel", f"SELECT stream_id, frame_index, {s6('f', 'forward')} FROM rec",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, value AS x FROM tel)", recursion("base", "x AS f", "b.x + 0.5e0*r.f")))
def w11(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, F.array("value").alias("x"))
    return M.decayed_sum(t, "x", 1, 0.5, "y").select(*ID, r6(F.col("y")[0], "forward"))


@query("w11_decayed_sum_backward", with_views("tel", f"SELECT stream_id, top-frame_index AS frame_index, {s6('f', 'backward')} FROM rec JOIN (SELECT stream_id, max(frame_index) AS top FROM tel GROUP BY 1) USING (stream_id)",
       "base AS MATERIALIZED (SELECT stream_id, max(frame_index) OVER (PARTITION BY stream_id) - frame_index AS frame_index, value AS x FROM tel)", recursion("base", "x AS f", "b.x + 0.1e0*r.f")))
def w11b(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, F.array("value").alias("x"))
    return M.decayed_sum(t, "x", 1, 0.1, "y", backward=True).select(*ID, r6(F.col("y")[0], "backward"))


@query("w12_decayed_maximum", with_views("tel", f"SELECT stream_id, top-frame_index AS frame_index, {s6('f', 'shield')} FROM rec JOIN (SELECT stream_id, max(frame_index) AS top FROM tel GROUP BY 1) USING (stream_id)",
       "base AS MATERIALIZED (SELECT stream_id, max(frame_index) OVER (PARTITION BY stream_id) - frame_index AS frame_index, value AS x, event_type='error' AS blocked FROM tel)",
       recursion("base", "x AS f", "CASE WHEN b.blocked THEN b.x ELSE greatest(b.x, 0.85e0*r.f) END")))
def w12(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "value", (F.col("event_type") == "error").alias("blocked"))
    return M.decayed_max(t, F.col("value"), 0.85, "shield", F.col("blocked")).select(*ID, r6("shield", "shield"))


@query("w19_pitch_hangover", with_views("tel", """SELECT stream_id, frame_index, coalesce(last_value(CASE WHEN lag<>0 THEN lag END IGNORE NULLS)
 OVER (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS filled FROM lg""", f"lg AS (SELECT stream_id, frame_index, {LAG_SQL} AS lag FROM tel)"))
def w19(spark, sf):
    return M.fill_pitch_lag(lags(spark, sf), hold=2).select(*ID, "filled")


_G = """g AS (SELECT stream_id, frame_index//4 AS grp, list(lag::double ORDER BY frame_index) AS f FROM lg GROUP BY ALL),
g2 AS (SELECT *, lag(f) OVER w AS p, lead(f) OVER w AS nx FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY grp)),
g3 AS (SELECT *, CASE WHEN p IS NULL OR greatest(p[3],p[4])=0 THEN [f[2],f[1]] ELSE [p[3],p[4]] END AS a,
 CASE WHEN nx IS NULL OR len(nx)<4 OR greatest(nx[1],nx[2])=0 THEN [f[4],f[3]] ELSE [nx[1],nx[2]] END AS z FROM g2),
g4 AS (SELECT *, list_concat(list_concat(a, f), z) AS l FROM g3)"""


@query("w20_pitch_smoothing", with_views("tel", """SELECT stream_id, grp*4+i-1 AS frame_index, CASE WHEN len(f)<4 OR list_max(f)=0 THEN f[i]
 ELSE round_even((l[i]+2*l[i+1]+3*l[i+2]+2*l[i+3]+l[i+4])/9, 0)::double END AS smoothed FROM g4, range(1,5) t(i) WHERE i<=len(f)""",
       f"lg AS (SELECT stream_id, frame_index, {LAG_SQL} AS lag FROM tel)", _G))
def w20(spark, sf):
    return M.smooth_pitch_lags(lags(spark, sf))


@query("w21_lookahead_features", with_views("tel", f"""SELECT stream_id, frame_index, CASE least(3, top-frame_index) WHEN 3 THEN b3 WHEN 2 THEN b2 WHEN 1 THEN b1 ELSE b0 END AS smooth_bandwidth, {s6('greatest(ta, tm-0.2e0)', 'smooth_tonality')} FROM (
 SELECT *, max(frame_index) OVER (PARTITION BY stream_id) AS top, max(bandwidth) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS b3, max(bandwidth) OVER (w ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING) AS b2,
 max(bandwidth) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS b1, max(bandwidth) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS b0,
 avg(tonality) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ta, max(tonality) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS tm FROM tel WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index))"""))
def w21(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "bandwidth", "tonality")
    return M.lookahead_features(t).select(*ID, "smooth_bandwidth", r6("smooth_tonality", "smooth_tonality"))


W22 = """ar AS MATERIALIZED (SELECT stream_id, frame_index, least(25, max(frame_index) OVER (PARTITION BY stream_id)-frame_index+1) AS n, activity_probability AS v, music_prob AS m FROM tel),
b22 AS MATERIALIZED (SELECT *, CASE WHEN n>15 THEN 5 ELSE 0 END AS m0, CASE WHEN n>15 THEN 1 ELSE 0 END AS v0, min(m) OVER w AS plo, max(m) OVER w AS phi FROM ar WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
sw AS (/*rec*/ SELECT b.stream_id, b.frame_index, 0::bigint AS t, pv.v AS vp, greatest(0.1e0, pv.v) AS cnt, greatest(0.1e0, pv.v)*pm.m AS avg_, 1e0 AS lo, 0e0 AS hi FROM b22 b
 JOIN ar pv ON pv.stream_id=b.stream_id AND pv.frame_index=b.frame_index+b.v0 JOIN ar pm ON pm.stream_id=b.stream_id AND pm.frame_index=b.frame_index+b.m0 UNION ALL
 SELECT s.stream_id, s.frame_index, s.t+1, vp, cnt+greatest(0.1e0, pv.v), avg_+greatest(0.1e0, pv.v)*pm.m, least((avg_-10*(vp-pv.v))/cnt, lo), greatest((avg_+10*(vp-pv.v))/cnt, hi) FROM sw s JOIN b22 b ON b.stream_id=s.stream_id AND b.frame_index=s.frame_index
 JOIN ar pv ON pv.stream_id=b.stream_id AND pv.frame_index=b.frame_index+b.v0+s.t+1 JOIN ar pm ON pm.stream_id=b.stream_id AND pm.frame_index=b.frame_index+b.m0+s.t+1 WHERE b.m0+s.t+1 < b.n),
se AS (SELECT s.*, n, plo, phi, avg_/cnt AS mu, greatest(0, least(avg_/cnt, lo)) AS l, least(1, greatest(avg_/cnt, hi)) AS h FROM sw s JOIN b22 b ON b.stream_id=s.stream_id AND b.frame_index=s.frame_index WHERE t = n-1-m0)"""


@query("w22_switch_thresholds", with_views("tel", f"""SELECT stream_id, frame_index, {s6('mu', 'smooth_music')}, {s6('CASE WHEN n<10 THEN l+(1-0.1e0*n)*(greatest(0, least(l, coalesce(plo,l))-0.1e0*vp)-l) ELSE l END', 'switch_low')},
 {s6('CASE WHEN n<10 THEN h+(1-0.1e0*n)*(least(1, greatest(h, coalesce(phi,h))+0.1e0*vp)-h) ELSE h END', 'switch_high')} FROM se""", W22))
def w22(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "activity_probability", "music_prob")
    return M.switch_thresholds(t).select(*ID, *[r6(c, c) for c in ("smooth_music", "switch_low", "switch_high")])


def band_energies(spark, sf):
    e = F.array(*[F.pow(F.col(c), S.d(2)) + S.d(1e-3) for c in ("tonality", "activity", "noisiness", "music_prob")])
    return V.telemetry(spark, sf).select(*ID, e.alias("e"), F.transform(e, lambda x: F.log(x)).alias("log_e"))


_BE = "be AS (SELECT stream_id, frame_index, b, pow([tonality, activity, noisiness, music_prob][b+1], 2) + 1e-3 AS e FROM tel, range(0, 4) t(b))"


@query("w23_stationarity", with_views("tel", f"""SELECT stream_id, frame_index, {s6('sum(pow(least(0.99e0, l1/sqrt(1e-15+8*l2)), 4))', 'stationarity')} FROM (
 SELECT *, sum(sqrt(e)) OVER w AS l1, sum(e) OVER w AS l2 FROM be WINDOW w AS (PARTITION BY stream_id, b ORDER BY frame_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) GROUP BY ALL""", _BE))
def w23(spark, sf):
    return M.stationarity(band_energies(spark, sf), "e", 4).select(*ID, r6(A.total("stationarity"), "stationarity"))


@query("w24_spectral_variability", with_views("tel", f"""SELECT stream_id, frame_index, {s6('sqrt(sum(near)/8/4)', 'spectral_variability')} FROM (
 SELECT c.stream_id, c.frame_index, i, min(d) AS near FROM tel c, (SELECT a AS i, b AS j FROM range(0,8) x(a), range(0,8) y(b) WHERE a<>b) ij,
 LATERAL (SELECT sum(pow(coalesce(p.v,0)-coalesce(q.v,0),2)) AS d FROM range(0,4) bb(b)
   LEFT JOIN lb p ON p.stream_id=c.stream_id AND p.frame_index=c.frame_index-i AND p.b=bb.b LEFT JOIN lb q ON q.stream_id=c.stream_id AND q.frame_index=c.frame_index-j AND q.b=bb.b)
 GROUP BY ALL) GROUP BY ALL""", _BE, "lb AS (SELECT stream_id, frame_index, b, ln(e) AS v FROM be)"))
def w24(spark, sf):
    return M.spectral_variability(band_energies(spark, sf), "log_e", 4).select(*ID, r6("spectral_variability", "spectral_variability"))


@query("w25_warm_up_mean", with_views("tel", f"SELECT stream_id, frame_index, {s6('m', 'mean')} FROM rec",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, value AS x FROM tel)",
       recursion("base", "x AS m", "(1-1e0/least(10, 1+b.frame_index))*r.m + b.x*(1e0/least(10, 1+b.frame_index))")))
def w25(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "value")
    return M.warm_up_mean(t, F.col("value"), 10, "m").select(*ID, r6("m", "mean"))


@query("w25_loudness_trackers", with_views("tel", f"SELECT stream_id, frame_index, {s6('p', 'peak')}, {s6('s', 'low_share')} FROM rec",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, 20*log10(value) AS x FROM tel)",
       recursion("base", "greatest(-0.003e0, x) AS p, (CASE WHEN x<greatest(-0.003e0,x)-30 THEN 1e0 ELSE 0e0 END) AS s",
                 "greatest(r.p-0.003e0, b.x), (1-1e0/least(25,1+b.frame_index))*r.s + (CASE WHEN b.x<greatest(r.p-0.003e0, b.x)-30 THEN 1e0/least(25,1+b.frame_index) ELSE 0e0 END)")))
def w25b(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, S.db20("value").alias("loudness"))
    return M.loudness_trackers(t, "loudness").select(*ID, r6("peak", "peak"), r6("low_share", "low_share"))


_WST = "1e0*(CASE WHEN greatest(nx,ny)>8e-4 THEN 1 ELSE 0 END)"


@query("w26_stereo_width", with_views("pcm", f"SELECT stream_id, frame_index, {s6('least(1, 20*fol)', 'stereo_width')}, {s6('sm', 'smoothed_width')} FROM rec",
       """base AS MATERIALIZED (SELECT stream_id, frame_index, sum(l*l) AS xx, sum(l*r) AS xy, sum(r*r) AS yy FROM (SELECT stream_id, frame_index, pcm[i] AS l, pcm[i+32] AS r FROM pcm, range(1,33) t(i)) GROUP BY ALL)""",
       """rec AS (/*rec*/ SELECT stream_id, -1::bigint AS frame_index, 0e0 AS sx, 0e0 AS sy, 0e0 AS sxy, 0e0 AS sm, 0e0 AS fol FROM base WHERE frame_index=0 UNION ALL
 SELECT stream_id, frame_index, nx, ny, nxy, CASE WHEN on_ THEN sm+(w-sm)/50 ELSE sm END, CASE WHEN on_ THEN greatest(fol-0.02e0/50, sm+(w-sm)/50) ELSE fol END FROM (
  SELECT *, least(1, sqrt(greatest(0, 1-pow(nxy/(1e-15+sqrt(nx)*sqrt(ny)),2))))*abs(sqrt(sqrt(nx))-sqrt(sqrt(ny)))/(1e-15+sqrt(sqrt(nx))+sqrt(sqrt(ny))) AS w FROM (
   SELECT *, CASE WHEN on_ THEN least(greatest(0, txy), sqrt(nx)*sqrt(ny)) ELSE greatest(0, txy) END AS nxy FROM (
    SELECT *, greatest(nx,ny)>8e-4 AS on_ FROM (SELECT b.stream_id, b.frame_index, greatest(0, 0.5e0*r.sx+0.5e0*b.xx) AS nx, greatest(0, 0.5e0*r.sy+0.5e0*b.yy) AS ny, 0.5e0*r.sxy+0.5e0*b.xy AS txy, r.sm, r.fol
     FROM rec r JOIN base b ON b.stream_id=r.stream_id AND b.frame_index=r.frame_index+1)))))""").replace("FROM rec", "FROM rec", 1).replace("SELECT stream_id, frame_index, round((least(1", "SELECT stream_id, frame_index, round((least(1") + " WHERE frame_index>=0")
def w26(spark, sf):
    left, right = F.slice("pcm", 1, 32), F.slice("pcm", 33, 32)
    f = V.pcm_frames(spark, sf).select(*ID, A.energy(left).alias("xx"), A.dot(left, right).alias("xy"), A.energy(right).alias("yy"))
    return M.stereo_width(f).select(*ID, r6("stereo_width", "stereo_width"), r6("smoothed_width", "smoothed_width"))


@query("w27_activity_mask", with_views("tel", """SELECT stream_id, frame_index, CASE WHEN m >= pow(10e0, -10e0/20)*top THEN 1 ELSE 0 END AS active FROM (
 SELECT *, sum(value) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5e0 AS m, max(value) OVER (PARTITION BY stream_id) AS top FROM tel)"""))
def w27(spark, sf):
    # energies of neighbouring test frames are close, so the threshold sits at -10 dB
    return M.activity_mask(V.telemetry(spark, sf).select(*ID, "value"), "value", -10.0).select(*ID, "active")


@query("w32_smoothed_loss", with_views("pk", f"SELECT stream_id, frame_index, {s6('y', 'loss_level')} FROM rec",
       "base AS MATERIALIZED (SELECT stream_id, frame_index, lost FROM pk)", recursion("base", "0.001e0*lost AS y", "0.001e0*b.lost + 0.999e0*r.y")))
def w32(spark, sf):
    return M.smoothed_loss(V.packets(spark, sf).select(*ID, "lost")).select(*ID, r6("loss_level", "loss_level"))


@query("w33_label_masking", with_views("tel", f"""SELECT stream_id, frame_index, {s6("CASE WHEN coalesce(max(CASE WHEN event_type='purchase' THEN 1 END) OVER (PARTITION BY stream_id, frame_index//8 ORDER BY frame_index), 0)=0 THEN 0.5e0 ELSE activity END", 'masked_label')}
 FROM tel QUALIFY count(*) OVER (PARTITION BY stream_id, frame_index//8)=8"""))
def w33(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, "event_type", "activity")
    return M.mask_leading_labels(t, F.col("event_type") == "purchase", "activity", 8).select(*ID, r6("masked_label", "masked_label"))


@query("w36_delta_cepstrum", with_views("tel", f"""SELECT stream_id, frame_index, {s6('-0.12299e0*(c+l4)+0.49195e0*(l1+l3)+0.69693e0*l2', 'level')}, {s6('0.63246e0*(c-l4)+0.31623e0*(l1-l3)', 'delta')},
 {s6('0.53452e0*(c+l4)-0.26726e0*(l1+l3)-0.53452e0*l2', 'delta2')} FROM (SELECT stream_id, frame_index, v AS c, lag(v,1,0e0) OVER w AS l1, lag(v,2,0e0) OVER w AS l2, lag(v,3,0e0) OVER w AS l3, lag(v,4,0e0) OVER w AS l4
 FROM (SELECT *, 20*log10(value) AS v FROM tel) WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index))"""))
def w36(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, F.array(S.db20("value")).alias("c"))
    return M.delta_cepstrum(t, "c").select(*ID, *[r6(F.col(c)[0], c) for c in ("level", "delta", "delta2")])

