"""Queries for flux features and bitrate plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import registry as R
from framescope.functions import scalar as S
from framescope.operators import features, layout, planner
from framescope.plans import views as V
from framescope.plans.packet_queries import recursion
from framescope.plans.registry import query, r6, s6
from framescope.plans.scalar_queries import TW_SQL
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]
EDGES = [0, 1, 2, 3, 4, 6, 9, 14, 22, 33]
BANDS = A.ranges(EDGES)
SILENCE_DB = 20.0
_LO, _HI = EDGES[:-1], EDGES[1:]
BAND_SQL = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"({i},{a},{b},{w}e0)" for i, (a, b, w) in enumerate(zip(_LO, _HI, A.FLUX_WEIGHTS))) + ") v(b, lo, hi, wt))"
MG = "mg AS MATERIALIZED (SELECT * FROM mag)"
FL = """fl AS MATERIALIZED (SELECT a.stream_id, a.frame_index, a.k, CASE WHEN b.m IS NULL THEN 0 ELSE greatest(a.m-b.m, 0) END AS d,
 CASE WHEN c.m IS NULL THEN 0 ELSE sqrt(pow(a.m*cos(a.ph)-b.m*cos(2*b.ph-c.ph),2)+pow(a.m*sin(a.ph)-b.m*sin(2*b.ph-c.ph),2)) END AS o
 FROM mg a LEFT JOIN mg b ON b.stream_id=a.stream_id AND b.k=a.k AND b.frame_index=a.frame_index-1
 LEFT JOIN mg c ON c.stream_id=a.stream_id AND c.k=a.k AND c.frame_index=a.frame_index-2)"""
BF = "bf AS MATERIALIZED (SELECT stream_id, frame_index, b, wt, sum(d) AS f FROM fl JOIN bands ON k>=lo AND k<hi GROUP BY ALL)"
FEAT = """loudness AS (SELECT stream_id, frame_index, 20*log10(sqrt(avg(x*x)+1e-12)) AS loud FROM smp GROUP BY ALL),
onsets AS (SELECT stream_id, frame_index, sum(o) AS onset FROM fl GROUP BY ALL),
bj AS (SELECT bf.*, avg(f) OVER (PARTITION BY bf.stream_id, b) AS bm, sum(f) OVER (PARTITION BY bf.stream_id, bf.frame_index) AS tot FROM bf JOIN tel USING (stream_id, frame_index)),
feat AS MATERIALIZED (SELECT bj.stream_id, bj.frame_index, sum(f*wt) AS wflux, -sum(f/(tot+1e-12)*log2(f/(tot+1e-12)+1e-12))/log2(9) AS cx,
 count(*) FILTER (WHERE f > 0.5e0*(bm+1e-12))/9e0 AS bb, any_value(onset) AS onset, any_value(loud) AS loud, any_value(activity) AS activity, any_value(noisiness) AS noisiness, any_value(requested_bitrate_bps) AS requested
 FROM bj JOIN tel USING (stream_id, frame_index) JOIN onsets USING (stream_id, frame_index) JOIN loudness USING (stream_id, frame_index) GROUP BY ALL)"""
RAW = f"""raw0 AS (SELECT *, loud < quantile_cont(loud,0.5) OVER s - 20 AS silent, quantile_cont(wflux,0.94) OVER s AS strong, quantile_cont(wflux,0.85) OVER s AS medium,
 quantile_cont(onset,0.92) OVER s AS onset_t, {TW_SQL} AS tw FROM feat WINDOW s AS (PARTITION BY stream_id)),
raw1 AS (SELECT *, CASE WHEN silent THEN 0.75e0 WHEN wflux>=strong OR onset>=onset_t THEN greatest(1e0, 1.05e0+0.30e0*(0.7e0*tw+0.3e0*bb))
 WHEN wflux>=medium THEN greatest(1e0, 1.05e0+0.05e0*tw) ELSE 1e0 END AS raw FROM raw0),
rw AS MATERIALIZED (SELECT *, sum(silent::int) OVER (PARTITION BY stream_id ORDER BY frame_index) AS sc FROM raw1)"""
STEAL = """cv AS (SELECT i.stream_id, i.frame_index, min(1-0.6e0*greatest(0,least((p.raw-1.05e0)/(1.35e0-1.05e0),1))*pow(0.85e0, i.frame_index-p.frame_index-1)) AS m
 FROM rw i JOIN rw p ON p.stream_id=i.stream_id AND p.frame_index BETWEEN i.frame_index-30 AND i.frame_index-1 AND p.raw>=1.05e0 AND p.sc=i.sc
 WHERE 1-0.6e0*greatest(0,least((p.raw-1.05e0)/(1.35e0-1.05e0),1))*pow(0.85e0, i.frame_index-p.frame_index-1) < 0.98e0 GROUP BY ALL),
sl AS MATERIALIZED (SELECT rw.*, CASE WHEN m IS NOT NULL THEN m WHEN NOT silent AND cx<0.35e0 THEN 0.85e0 ELSE 1e0 END AS ceil, m IS NOT NULL OR (NOT silent AND cx<0.35e0) AS in_steal
 FROM rw LEFT JOIN cv USING (stream_id, frame_index))"""
RISK = """rk0 AS (SELECT *, coalesce(max(loud) OVER (w ROWS BETWEEN 30 PRECEDING AND 2 PRECEDING), coalesce(quantile_cont(CASE WHEN NOT silent THEN loud END, 0.5) OVER (PARTITION BY stream_id), quantile_cont(loud,0.5) OVER (PARTITION BY stream_id))) AS recent,
 CASE WHEN lead(raw,1) OVER w >= 1.05e0 THEN 1.1e0 ELSE 0e0 END + CASE WHEN lead(raw,2) OVER w >= 1.05e0 THEN 1e0 ELSE 0e0 END AS pre,
 NOT silent AND NOT in_steal AND raw<1.05e0 AND loud >= -75 AS elig FROM sl WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index)),
rk AS MATERIALIZED (SELECT *, CASE WHEN elig THEN (greatest(0, recent-loud)*exp(-pow(loud+50,2)/(2*15.0e0*15.0e0)) + pre)*(cx+0.2e0) ELSE 0e0 END AS risk FROM rk0)"""
REDIS = """rd0 AS (SELECT *, least(raw, ceil) AS env0, sum(raw-least(raw,ceil)) OVER s AS stolen, sum(risk) OVER s AS rs, sum(elig::int) OVER s AS cnt FROM rk WINDOW s AS (PARTITION BY stream_id)),
rd AS MATERIALIZED (SELECT *, env0 + CASE WHEN stolen>0 THEN greatest(0, least(stolen*(CASE WHEN rs>0 THEN risk/rs WHEN cnt>0 THEN elig::int/cnt ELSE 0 END), 1.5e0-env0)) ELSE 0 END AS env FROM rd0)"""
BUDGET = "bg0 AS (SELECT *, greatest(0.5e0, least(env, 1.35e0)) AS e0 FROM rd)" + "".join(
    f",\nbg{i + 1} AS MATERIALIZED (SELECT *, greatest(0.5e0, least(e{i}/avg(e{i}) OVER (PARTITION BY stream_id), 1.35e0)) AS e{i + 1} FROM bg{i})" for i in range(4))
CHAIN = [MG, BAND_SQL, FL, BF, FEAT, RAW, STEAL, RISK, REDIS, BUDGET]


def upto(n: int):
    return CHAIN[:n]


def flux_frames(spark, sf):
    return features.flux_and_onset(V.pcm_frames(spark, sf), "pcm", BANDS)


@query("w01_spectral_flux", with_views("mag", f"SELECT stream_id, frame_index, {s6('sum(d)', 'flux')} FROM fl GROUP BY ALL", MG, FL))
def w01(spark, sf):
    f = features.flux_and_onset(V.pcm_frames(spark, sf), "pcm", [(0, 33)])
    return f.select(*ID, r6(F.col("band_flux")[0], "flux"))


@query("w02_complex_onset", with_views("mag", f"SELECT stream_id, frame_index, {s6('sum(o)', 'onset')} FROM fl GROUP BY ALL", MG, FL))
def w02(spark, sf):
    return flux_frames(spark, sf).select(*ID, r6("onset", "onset"))


@query("w09_complexity", with_views("mag", f"""SELECT stream_id, frame_index, {s6('-sum(f/(tot+1e-12)*log2(f/(tot+1e-12)+1e-12))/log2(9)', 'complexity')}
 FROM (SELECT *, sum(f) OVER (PARTITION BY stream_id, frame_index) AS tot FROM bf) GROUP BY ALL""", *upto(4)))
def w09(spark, sf):
    return flux_frames(spark, sf).select(*ID, r6(A.entropy_share("band_flux", len(BANDS)), "complexity"))


@query("a38_broadband", with_views("mag", f"""SELECT stream_id, frame_index, {s6('count(*) FILTER (WHERE f > 0.5e0*(bm+1e-12))/9e0', 'broadband')}
 FROM (SELECT *, avg(f) OVER (PARTITION BY stream_id, b) AS bm FROM bf) GROUP BY ALL""", *upto(4)))
def a38(spark, sf):
    return features.broadband(flux_frames(spark, sf), len(BANDS)).select(*ID, r6("broadband", "broadband"))


def base_frames(spark, sf):
    tel = V.telemetry(spark, sf).select(*ID, "activity", "noisiness", "tonality", "requested_bitrate_bps")
    return planner.signal_features(tel, V.pcm_frames(spark, sf), "pcm", BANDS, A.FLUX_WEIGHTS)


def raw_frames(spark, sf):
    return planner.with_raw_scale(layout.cut_lineage(base_frames(spark, sf)), silence_db=SILENCE_DB)


def risk_frames(spark, sf):
    return planner.redistribution_risk(layout.cut_lineage(planner.steal_ceiling(raw_frames(spark, sf))))


@query("p07_raw_scale", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, silent, {s6('raw', 'raw')} FROM rw", *upto(6)))
def p07(spark, sf):
    return raw_frames(spark, sf).select(*ID, "silent", r6("raw", "raw"))


@query("w07_steal_ceiling", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6('coalesce(m, 1)', 'ceiling')} FROM sl LEFT JOIN cv USING (stream_id, frame_index)".replace("coalesce(m, 1)", "coalesce(cv.m, 1)"), *upto(7)))
def w07(spark, sf):
    f = planner.steal_ceiling(raw_frames(spark, sf).withColumn("complexity", S.d(1)))
    return f.select(*ID, r6("steal_ceil", "ceiling"))


@query("w08_tonal_steal", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, in_steal, {s6('ceil', 'ceiling')} FROM sl", *upto(7)))
def w08(spark, sf):
    return planner.steal_ceiling(raw_frames(spark, sf)).select(*ID, "in_steal", r6("steal_ceil", "ceiling"))


@query("w05_recent_loudness", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6('recent', 'recent_max')} FROM rk", *upto(8)))
def w05(spark, sf):
    return risk_frames(spark, sf).select(*ID, r6("recent_max", "recent_max"))


@query("w06_pre_echo", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6('pre', 'pre_echo')} FROM rk", *upto(8)))
def w06(spark, sf):
    return risk_frames(spark, sf).select(*ID, r6("pre_echo", "pre_echo"))


@query("f02_eligible", with_views("mag tel", "SELECT stream_id::bigint AS stream_id, frame_index FROM rk WHERE elig", *upto(8)))
def f02(spark, sf):
    return risk_frames(spark, sf).where("eligible").select(*ID)


@query("w10_redistribution", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6('env', 'envelope')} FROM rd", *upto(9)))
def w10(spark, sf):
    return planner.redistribute(layout.cut_lineage(risk_frames(spark, sf))).select(*ID, r6("envelope", "envelope"))


@query("w14_budget", with_views("tel", f"SELECT stream_id, frame_index, {s6('e4', 'scale')} FROM bg4",
                                "rd AS (SELECT stream_id, frame_index, 0.4e0+1.3e0*activity AS env FROM tel)", BUDGET))
def w14(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, (S.d(0.4) + S.d(1.3) * F.col("activity")).alias("envelope"))
    return planner.enforce_budget(layout.cut_lineage(t)).select(*ID, r6("envelope", "scale"))


@R.planner("current")
def current(spark, sf):
    return planner.current_plan(base_frames(spark, sf), silence_db=SILENCE_DB)


@query("h05_current_plan", with_views("mag tel", f"""SELECT stream_id::bigint AS stream_id, frame_index, {s6('e4', 'scale')}, {s6('wflux', 'weighted_flux')}, {s6('onset', 'onset')}, {s6('loud', 'loudness_db')}, silent::int AS silent,
 greatest(6000, round_even(requested*e4, 0)::bigint) AS target_bitrate_bps FROM bg4""", *CHAIN))
def h05(spark, sf):
    p = R.PLANNERS["current"](spark, sf)
    return p.select(*ID, r6("scale", "scale"), r6("weighted_flux", "weighted_flux"), r6("onset", "onset"),
                    r6("loudness_db", "loudness_db"), "silent", "target_bitrate_bps")


EARLY = """ef AS (SELECT stream_id, frame_index, sum(d) AS flux FROM fl GROUP BY ALL),
et AS (SELECT ef.*, activity, noisiness, tonality, requested_bitrate_bps, quantile_cont(flux,0.94) OVER s AS strong, quantile_cont(flux,0.88) OVER s AS medium FROM ef JOIN tel USING (stream_id, frame_index) WINDOW s AS (PARTITION BY stream_id)),
ec AS (SELECT *, """ + TW_SQL + """ AS tw, 0.88e0+(1e0-0.88e0)*greatest(0,least(0.7e0*tonality+0.3e0*(1e0-noisiness),1)) AS calm FROM et),
base AS MATERIALIZED (SELECT stream_id, frame_index, flux, requested_bitrate_bps, CASE WHEN flux>=strong THEN greatest(calm, 1e0+(1.45e0-1e0)*tw) WHEN flux>=medium THEN greatest(calm, 1e0+(1.25e0-1e0)*tw) ELSE calm END AS raw FROM ec)"""
_CAND = "CASE WHEN r.since+1<=2 AND (r.env>1 OR r.stolen) THEN greatest(r.env*0.3e0, 0.4e0) WHEN r.stolen THEN r.env*1.5e0 END"
EREC = recursion("base", "raw AS env, 999 AS since, false AS stolen",
                 f"CASE WHEN b.raw>1 THEN b.raw WHEN coalesce({_CAND} < b.raw, false) THEN {_CAND} ELSE b.raw END, CASE WHEN b.raw>1 THEN 0 ELSE r.since+1 END, b.raw<=1 AND coalesce({_CAND} < b.raw, false)")
EBACK = """eb AS MATERIALIZED (SELECT rec.stream_id, max(rec.frame_index) OVER (PARTITION BY rec.stream_id)-rec.frame_index AS frame_index, rec.frame_index AS fi, env, stolen, flux, requested_bitrate_bps FROM rec JOIN base ON base.stream_id=rec.stream_id AND base.frame_index=rec.frame_index),
rec2 AS (SELECT stream_id, frame_index, fi, env AS y, flux, requested_bitrate_bps FROM eb WHERE frame_index=0 UNION ALL SELECT b.stream_id, b.frame_index, b.fi, CASE WHEN b.stolen THEN b.env ELSE greatest(b.env, 0.85e0*r.y) END, b.flux, b.requested_bitrate_bps FROM rec2 r JOIN eb b ON b.stream_id=r.stream_id AND b.frame_index=r.frame_index+1),
en AS (SELECT *, greatest(0.2e0, least(y, 1.5e0)) AS c FROM rec2), en2 AS (SELECT stream_id, fi AS frame_index, flux, c/avg(c) OVER (PARTITION BY stream_id) AS scale, requested_bitrate_bps FROM en)"""


def early_frames(spark, sf):
    f = features.flux_and_onset(V.pcm_frames(spark, sf), "pcm", [(0, 33)]).select(*ID, F.col("band_flux")[0].alias("flux"))
    return V.telemetry(spark, sf).select(*ID, "activity", "noisiness", "tonality", "requested_bitrate_bps").join(f, ID)


@query("w13_steal_and_recover", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, stolen, {s6('env', 'envelope')} FROM rec", MG, FL, EARLY, EREC))
def w13(spark, sf):
    from framescope.operators.quantiles import quantiles
    f = layout.cut_lineage(early_frames(spark, sf))
    f = layout.attach(f, quantiles(f, "flux", {"_strong": 0.94, "_medium": 0.88})).withColumn("raw", planner.early_raw_scale())
    return planner.steal_and_recover(f).select(*ID, "stolen", r6("envelope", "envelope"))


@R.planner("early")
def early(spark, sf):
    return planner.early_plan(layout.cut_lineage(early_frames(spark, sf)))


@query("h05_early_plan", with_views("mag tel", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6('scale', 'scale')}, {s6('flux', 'flux')}, greatest(6000, round_even(requested_bitrate_bps*scale, 0)::bigint) AS target_bitrate_bps FROM en2", MG, FL, EARLY, EREC, EBACK))
def h05b(spark, sf):
    p = R.PLANNERS["early"](spark, sf)
    return p.select(*ID, r6("scale", "scale"), r6("flux", "flux"), "target_bitrate_bps")


@query("j04_plan_mix", with_views("tel", f"""SELECT stream_id, frame_index, {s6('s/avg(s) OVER (PARTITION BY stream_id)', 'scale')}, {s6('96000*s/avg(s) OVER (PARTITION BY stream_id)', 'target_bitrate_bps')} FROM
 (SELECT *, (0.5e0+activity)*CASE WHEN value >= quantile_cont(value, 0.95) OVER (PARTITION BY stream_id) THEN 1e0 ELSE 0.75e0+0.25e0*(0.8e0+0.4e0*noisiness) END AS s FROM tel)"""))
def j04(spark, sf):
    t = V.telemetry(spark, sf)
    plan = t.select(*ID, (S.d(0.5) + F.col("activity")).alias("scale"), (S.d(96000) * (S.d(0.5) + F.col("activity"))).alias("target_bitrate_bps"))
    seg = t.select(*ID, (S.d(0.8) + S.d(0.4) * F.col("noisiness")).alias("scale"))
    mask = features.attack_mask(t.select(*ID, "value"), F.col("value"))
    out = planner.mix_plans(plan, seg, mask, 0.25, calm_only=True)
    return out.select(*ID, r6("scale", "scale"), r6("target_bitrate_bps", "target_bitrate_bps"))
