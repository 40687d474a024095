"""Queries for reference-against-decoded metrics and the candidate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import features, layout, metrics, ranking
from framescope.plans import views as V
from framescope.plans.planner_queries import EDGES
from framescope.plans.registry import query, r6, s6
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]
SONG = ["stream_id", "candidate"]
BANDS = A.ranges(EDGES)
BASE = "q16"

#: A frame has 32 samples a channel; spectra in windows of 2:1, flux in windows of about 2048:960.
CUTS = metrics.Cuts(32, (64, 32), (68, 32))


def _windows(name: str, size: int, hop: int) -> str:
    """Spectra of all windows of the downmix that end before its last sample."""
    return f"""{name} AS MATERIALIZED (SELECT stream_id, candidate, j, k, sqrt(pow(sum(x*w*c),2)+pow(sum(x*w*s),2)) AS m, sqrt(pow(sum(y*w*c),2)+pow(sum(y*w*s),2)) AS dm
 FROM (SELECT mono.*, j, k, 0.5e0-0.5e0*cos(2*pi()*i/{size - 1}) AS w, cos(2*pi()*k*i/{size}) AS c, sin(2*pi()*k*i/{size}) AS s
  FROM (SELECT stream_id, j, i, j*{hop}+i AS t FROM (SELECT stream_id, unnest(range(0, (total-{size}-1)//{hop}+1)) AS j FROM len WHERE total>{size}), range(0,{size}) u(i)) JOIN mono USING (stream_id, t), range(0,{size // 2 + 1}) v(k)) GROUP BY ALL)"""


DD = ("mono AS MATERIALIZED (SELECT a.stream_id, a.candidate, a.frame_index*32+a.n AS t, 0.5e0*(a.x+b.x) AS x, 0.5e0*(a.y+b.y) AS y FROM dsmp a JOIN dsmp b ON a.stream_id=b.stream_id AND a.candidate=b.candidate AND a.frame_index=b.frame_index AND b.n=a.n+32),\n"
      "len AS (SELECT stream_id, max(t)+1 AS total FROM mono GROUP BY 1),\n" + _windows("ws", 64, 32) + ",\n" + _windows("wf", 68, 32))
FM = f"""pw AS (SELECT k, w/max(w) OVER () AS w FROM (SELECT k, pow(10e0, (20*log10(greatest(12194e0*12194e0*f2*f2/greatest((f2+20.6e0*20.6e0)*sqrt((f2+107.7e0*107.7e0)*(f2+737.9e0*737.9e0))*(f2+12194e0*12194e0),1e-20),1e-20))+2)/20)*(1+0.45e0*exp(-0.5e0*pow((750e0*k-3200)/1400,2))) AS w
 FROM (SELECT k, pow(greatest(750e0*k,1),2) AS f2 FROM range(0,33) t(k)))),
sp AS (SELECT *, wt/avg(wt) OVER (PARTITION BY stream_id, candidate, j) AS rel FROM (SELECT ws.*, w/sqrt(greatest(m,1e-6)) AS wt FROM ws JOIN pw USING (k))),
spm AS MATERIALIZED (SELECT stream_id, candidate, j AS "window", sqrt(avg(pow(10*log10(m*m+1e-12)-10*log10(dm*dm+1e-12),2))) AS lsd, sqrt(avg(pow((log10(m*m+1e-12)-log10(dm*dm+1e-12))*rel,2))) AS pse FROM sp GROUP BY ALL),
flm AS MATERIALIZED (SELECT stream_id, candidate, j AS "window", avg(CASE WHEN pm IS NOT NULL THEN pow(greatest(m-pm,0)-greatest(dm-pdm,0),2) END) AS flux_err, coalesce(sum(greatest(m-pm,0)) FILTER (WHERE pm IS NOT NULL),0) AS ref_flux
 FROM (SELECT *, lag(m) OVER o AS pm, lag(dm) OVER o AS pdm FROM wf WINDOW o AS (PARTITION BY stream_id, candidate, k ORDER BY j)) GROUP BY ALL),
tdm AS (SELECT stream_id, candidate, frame_index, avg(pow(x-y,2)) AS mse, avg(x*x) AS power FROM dsmp GROUP BY ALL),
evm AS (SELECT stream_id, candidate, t//32 AS frame_index, sqrt(avg(x*x)) AS env_ref, sqrt(avg(y*y)) AS env_dec FROM mono GROUP BY ALL),
img AS (SELECT stream_id, candidate, frame_index, abs(ln(1+sum(pow(0.5e0*(l-r),2))/32/greatest(sum(pow(0.5e0*(l+r),2))/32,1e-12)) - ln(1+sum(pow(0.5e0*(dl-dr),2))/32/greatest(sum(pow(0.5e0*(dl+dr),2))/32,1e-12))) AS image
 FROM (SELECT a.stream_id, a.candidate, a.frame_index, a.x AS l, b.x AS r, a.y AS dl, b.y AS dr FROM dsmp a JOIN dsmp b ON a.stream_id=b.stream_id AND a.candidate=b.candidate AND a.frame_index=b.frame_index AND b.n=a.n+32) GROUP BY ALL),
fm AS MATERIALIZED (SELECT * FROM tdm JOIN evm USING (stream_id, candidate, frame_index) JOIN img USING (stream_id, candidate, frame_index))"""
IM = """im AS (SELECT * FROM (SELECT stream_id, candidate, 10*log10(avg(power)/greatest(avg(mse),1e-20)) AS snr, corr(env_ref, env_dec) AS env_corr, avg(image) AS stereo_image_error FROM fm GROUP BY ALL)
 LEFT JOIN (SELECT stream_id, candidate, avg(lsd) AS lsd, avg(pse) AS perceptual_spectral FROM spm GROUP BY ALL) USING (stream_id, candidate) LEFT JOIN (SELECT stream_id, candidate, avg(flux_err) AS flux_mse FROM flm GROUP BY ALL) USING (stream_id, candidate))"""
AB = f"""atk AS (SELECT stream_id, "window" AS frame_index, ref_flux >= quantile_cont(ref_flux,0.95) OVER (PARTITION BY stream_id) AS attack FROM flm WHERE candidate='{BASE}'),
bs AS (SELECT stream_id, frame_index, mse AS base, attack FROM fm JOIN atk USING (stream_id, frame_index) WHERE candidate='{BASE}'),
ab AS (SELECT stream_id, candidate, avg(mse-base) AS overall_mean_delta, avg(mse-base) FILTER (WHERE attack) AS attack_mean_delta, coalesce(avg(mse-base) FILTER (WHERE NOT attack),0) AS calm_mean_delta,
 count(*) FILTER (WHERE mse<base) AS frames_better_than_baseline, count(*) FILTER (WHERE base<mse) AS frames_worse_than_baseline FROM fm JOIN bs USING (stream_id, frame_index) GROUP BY ALL)"""
SM = f"""sm0 AS (SELECT im.*, ab.* EXCLUDE (stream_id, candidate), im.snr-b.snr AS snr_delta, im.lsd-b.lsd AS lsd_delta, im.perceptual_spectral-b.perceptual_spectral AS perceptual_spectral_delta,
 im.stereo_image_error-b.stereo_image_error AS stereo_image_delta, im.flux_mse-b.flux_mse AS flux_mse_delta FROM im JOIN ab USING (stream_id, candidate) JOIN im b ON b.stream_id=im.stream_id AND b.candidate='{BASE}'),
sg AS (SELECT *, 1.5e0*attack_mean_delta+calm_mean_delta+18*perceptual_spectral_delta+7.5e0*lsd_delta+3*stereo_image_delta+0.8e0*flux_mse_delta-0.5e0*snr_delta AS score,
 6*attack_mean_delta+3*overall_mean_delta+0.6e0*lsd_delta+0.8e0*flux_mse_delta-0.25e0*snr_delta AS simple_score FROM sm0)"""
KB = """kb AS (SELECT stream_id, candidate, avg(frame_index*7 % 100 + q)*8*48000/960/1000 AS avg_kbps FROM pcm, cand GROUP BY ALL)"""
_MEANS = ranking.MEANS
ST = "st AS (SELECT candidate, count(*) AS songs, " + ", ".join(f"avg({c}) AS {c}" for c in _MEANS if c != "score") + ", avg(score) AS score, " + ", ".join(
    f"sum({c})::bigint AS {c}" for c in ranking.COUNTS) + ", avg(score)<0 AND max(score)<0.02e0 AS passed_gate_all_songs FROM sg JOIN kb USING (stream_id, candidate) GROUP BY 1)"
ALL = (DD, FM, IM, AB, SM, KB, ST)


def measures(spark, sf):
    """The tables by frame, by spectral window and by flux window."""
    f = V.decoded_frames(spark, sf)
    return metrics.frame_measures(f), metrics.spectral_measures(f, CUTS), metrics.flux_measures(f, CUTS)


for _id, _col, _table, _at in (("a06_frame_mse", "mse", "fm", "frame_index"), ("a09_log_spectral_distance_frames", "lsd", "spm", "window"), ("a10_perceptual_error_frames", "pse", "spm", "window"),
                               ("a11_stereo_image_frames", "image", "fm", "frame_index"), ("a12_flux_error_frames", "flux_err", "flm", "window")):
    @query(_id, with_views("dsmp", f'SELECT stream_id, candidate, "{_at}", {s6(_col, _col)} FROM {_table}', DD, FM))
    def _frame_query(spark, sf, col=_col, table=("fm", "spm", "flm").index(_table), at=_at):
        return measures(spark, sf)[table].select(*SONG, at, r6(col, col))

for _id, _cols in (("a07_snr", ["snr"]), ("a08_envelope_correlation", ["env_corr"]), ("a09_log_spectral_distance", ["lsd"]),
                   ("a10_perceptual_spectral_error", ["perceptual_spectral"]), ("a11_stereo_image_error", ["stereo_image_error"]),
                   ("a12_transient_flux_mse", ["flux_mse"])):
    @query(_id, with_views("dsmp", "SELECT stream_id, candidate, " + ", ".join(s6(c, c) for c in _cols) + " FROM im", DD, FM, IM))
    def _item_query(spark, sf, cols=tuple(_cols)):
        return metrics.item_metrics(*measures(spark, sf)).select(*SONG, *[r6(c, c) for c in cols])

_A13 = ["overall_mean_delta", "attack_mean_delta", "calm_mean_delta"]


@query("a13_masked_deltas", with_views("dsmp ddft", "SELECT stream_id, candidate, frames_better_than_baseline, frames_worse_than_baseline, " + ", ".join(s6(c, c) for c in _A13) + " FROM ab", DD, FM, AB))
def a13(spark, sf):
    frames, _, flux = measures(spark, sf)
    out = metrics.against_baseline(frames, layout.cut_lineage(flux), BASE)
    return out.select(*SONG, *ranking.COUNTS, *[r6(c, c) for c in _A13])


def songs(spark, sf):
    m = metrics.song_metrics(V.decoded_frames(spark, sf), BASE, CUTS)
    q = F.create_map(*[F.lit(x) for kv in V.CANDIDATES.items() for x in kv])
    grid = ranking.work_grid(V.pcm_frames(spark, sf).select(*ID), list(V.CANDIDATES))
    kb = grid.groupBy(*SONG).agg((F.avg(F.col("frame_index") * 7 % 100 + q[F.col("candidate")]) * S.d(8 * 48000) / S.d(960) / S.d(1000)).alias("avg_kbps"))
    return m.join(kb, SONG)


@query("a14_rank_score", with_views("dsmp ddft", f"SELECT stream_id, candidate, {s6('score', 'score')}, {s6('simple_score', 'simple_score')} FROM sg", DD, FM, IM, AB, SM))
def a14(spark, sf):
    m = metrics.song_metrics(V.decoded_frames(spark, sf), BASE, CUTS)
    return m.select(*SONG, r6("score", "score"), r6(metrics.weighted_score(metrics.SCORE_SIMPLE), "simple_score"))


_STC = "candidate, songs, passed_gate_all_songs, frames_better_than_baseline, frames_worse_than_baseline, " + ", ".join(s6(c, c) for c in _MEANS)


@query("a15_stage_summary", with_views("dsmp ddft", f"SELECT {_STC} FROM st", *ALL))
def a15(spark, sf):
    s = ranking.stage_summary(songs(spark, sf))
    return s.select("candidate", "songs", "passed_gate_all_songs", *ranking.COUNTS, *[r6(c, c) for c in _MEANS])


@query("t02_candidate_ranking", with_views("dsmp ddft", f"SELECT candidate, row_number() OVER (ORDER BY score, candidate)::int AS place, {s6('score', 'score')} FROM st ORDER BY st.score LIMIT 3", *ALL))
def t02(spark, sf):
    return ranking.ranked(ranking.stage_summary(songs(spark, sf)), 3).select("candidate", "place", r6("score", "score"))


@query("u01_promotion", with_views("dsmp ddft", "SELECT candidate, row_number() OVER (ORDER BY passed_gate_all_songs DESC, score, candidate)::int AS place FROM st QUALIFY place <= 3", *ALL))
def u01(spark, sf):
    return ranking.promoted(ranking.stage_summary(songs(spark, sf)), 3).select("candidate", "place")


@query("s18_two_stage_search", with_views("dsmp ddft", f"""SELECT stream_id, candidate, {s6('score', 'score')} FROM sg
 WHERE candidate IN (SELECT candidate FROM st2 QUALIFY row_number() OVER (ORDER BY passed DESC, score, candidate) <= 2)""", DD, FM, IM, AB, SM,
    "st2 AS (SELECT candidate, avg(score) AS score, avg(score)<0 AND max(score)<0.02e0 AS passed FROM sg WHERE stream_id IN (1,3) GROUP BY 1)"))
def s18(spark, sf):
    """Gate on two songs, then all songs for the two promoted candidates; gate results are reused."""
    path = layout.scratch_path(spark, "stage-results")
    frames = V.decoded_frames(spark, sf)
    grid = ranking.work_grid(V.pcm_frames(spark, sf).select("stream_id").distinct(), list(V.CANDIDATES))

    def compute(work):
        # the baseline's frames are needed for every song that has work left
        todo = work.select("stream_id", "candidate").unionByName(
            work.select("stream_id", F.lit(BASE).alias("candidate"))).distinct()
        m = metrics.song_metrics(frames.join(todo, SONG, "left_semi"), BASE, CUTS)
        return m.join(work, SONG, "left_semi").withColumn("avg_kbps", S.d(0))

    gate = ranking.with_stored(spark, path, grid.where(F.col("stream_id").isin(1, 3)), SONG, compute)
    winners = layout.cut_lineage(ranking.promoted(ranking.stage_summary(gate), 2).select("candidate"))
    full = ranking.with_stored(spark, path, ranking.full_stage(grid, winners), SONG, compute)
    return ranking.full_stage(full, winners).select(*SONG, r6("score", "score"))


@query("j09_work_grid", with_views("pcm cand", "SELECT DISTINCT stream_id, candidate FROM pcm, cand"))
def j09(spark, sf):
    return ranking.work_grid(V.pcm_frames(spark, sf).select("stream_id").distinct(), list(V.CANDIDATES))


@query("j10_listed_songs", with_views("tel", "SELECT DISTINCT stream_id AS song FROM tel WHERE stream_id IN (SELECT DISTINCT label FROM embeddings)"))
def j10(spark, sf):
    manifest = V.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("song"))
    return ranking.only_listed(V.table(spark, sf, "events").select(F.col("user_id").alias("song")).distinct(), manifest)


@query("j02_lag_alignment", with_views("smp", f"""SELECT stream_id, frame_index, {s6('sum(pow(x-y,2))/64', 'mse')} FROM (SELECT *,
 lead(x, 20) OVER (PARTITION BY stream_id ORDER BY frame_index, n) AS y, max(frame_index) OVER (PARTITION BY stream_id) AS top FROM smp) WHERE frame_index<top GROUP BY ALL"""))
def j02(spark, sf):
    f = features.realigned(V.pcm_frames(spark, sf), "pcm", 20, 64, "late")
    return f.select(*ID, r6(A.mean_sq_diff("pcm", "late"), "mse"))


# ------------------------------------------------------------------ quality indices
def _pow_cte(window_sql: str, gain: str = "32768e0") -> str:
    return f"""qp AS MATERIALIZED (SELECT stream_id, frame_index, candidate, k, pow({gain},2)*(pow(sum(x*w*c),2)+pow(sum(x*w*s),2)) AS px, pow({gain},2)*(pow(sum(y*w*c),2)+pow(sum(y*w*s),2)) AS py
 FROM (SELECT *, {window_sql} AS w, cos(2*pi()*k*n/64) AS c, sin(2*pi()*k*n/64) AS s FROM dsmp, range(0,33) t(k)) GROUP BY ALL)"""


def _mask_ctes(edges, offset: str, floor: str | None = None, down_from: int | None = None) -> str:
    """Band energies, then leakage upwards and downwards written out as sums."""
    n = len(edges) - 1
    last = n - 2 if down_from is None else down_from
    bands = ", ".join(f"({i},{a},{b})" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    base = "e" if floor is None else f"greatest(e, {floor}*max(e) OVER (PARTITION BY stream_id, candidate, frame_index))"
    return f"""qb AS (SELECT * FROM (VALUES {bands}) v(b, lo, hi)),
qe AS (SELECT stream_id, frame_index, candidate, b, sum(px+{offset})/any_value(hi-lo) AS e FROM qp JOIN qb ON k>=lo AND k<hi GROUP BY ALL),
qf AS (SELECT stream_id, frame_index, candidate, b, {base} AS e FROM qe),
qu AS (SELECT a.stream_id, a.frame_index, a.candidate, a.b, sum(p.e*pow(0.1e0, a.b-p.b)) AS e FROM qf a JOIN qf p ON p.stream_id=a.stream_id AND p.frame_index=a.frame_index AND p.candidate=a.candidate AND p.b<=a.b GROUP BY ALL),
qd AS MATERIALIZED (SELECT a.stream_id, a.frame_index, a.candidate, a.b, sum(p.e*pow(0.03e0, p.b-a.b)) AS e FROM qu a JOIN qu p ON p.stream_id=a.stream_id AND p.frame_index=a.frame_index AND p.candidate=a.candidate AND p.b>=a.b AND (p.b=a.b OR (a.b<={last} AND p.b<={last + 1})) GROUP BY ALL)"""


_FWD = """qm AS MATERIALIZED (SELECT a.stream_id, a.frame_index, a.candidate, a.b, sum(p.e*pow(0.5e0, a.frame_index-p.frame_index)) AS e FROM qd a JOIN qd p ON p.stream_id=a.stream_id AND p.candidate=a.candidate AND p.b=a.b AND p.frame_index<=a.frame_index GROUP BY ALL)"""


def _pair(offset: str, masks: str = "qm") -> str:
    return f"""qx AS (SELECT stream_id, candidate, frame_index, k, b, hi-lo AS width, px+{offset}+0.1e0*e AS mx, py+{offset}+0.1e0*e AS my FROM qp JOIN qb ON k>=lo AND k<hi JOIN {masks} USING (stream_id, candidate, frame_index, b)),
qy AS (SELECT *, mx+coalesce(lag(mx) OVER w,0) AS x2, my+coalesce(lag(my) OVER w,0) AS y2, lag(mx) OVER w AS before FROM qx WINDOW w AS (PARTITION BY stream_id, candidate, k ORDER BY frame_index))"""


_HANN = "0.5e0-0.5e0*cos(2*pi()*n/63)"


@query("a16_quality_index", with_views("dsmp", f"""SELECT stream_id, candidate, {s6('err', 'error')}, {s6('100*(1-0.5e0*ln(1+err)/ln(1.13e0))', 'quality')}, 100*(1-0.5e0*ln(1+err)/ln(1.13e0)) >= 0 AS passed FROM (
 SELECT stream_id, candidate, pow(avg(pow(ef,4)), 1e0/16) AS err FROM (SELECT stream_id, candidate, frame_index, sum(eb*eb)/9 AS ef FROM (
  SELECT stream_id, candidate, frame_index, b, sum(y2/x2-ln(y2/x2)-1)/any_value(width) AS eb FROM qy GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""",
    _pow_cte(_HANN), _mask_ctes(EDGES, "1e5"), _FWD, _pair("1e5")))
def a16(spark, sf):
    out = metrics.quality_index(V.decoded_frames(spark, sf), [("pcm", "dec")], BANDS)
    return out.select(*SONG, r6("error", "error"), r6("quality", "quality"), "passed")


_TH = "(0.1e0/(0.15e0*0.15e0+pow(k*pi()/240,2)))"


@query("a17_high_rate_index", with_views("dsmp", f"""SELECT stream_id, candidate, {s6('pow(avg(pow(e2,2)),0.25e0)', 'err4')}, {s6('pow(avg(pow(e4*e4,2)),1e0/16)', 'err16')}, {s6('any_value(rms)', 'rms')} FROM (
 SELECT stream_id, candidate, frame_index, sum(b2)/9 AS e2, sum(b4*b4)/9 AS e4 FROM (SELECT stream_id, candidate, frame_index, b,
  sum((y2+{_TH})/(x2+{_TH})-ln((y2+{_TH})/(x2+{_TH}))-1)*(0.5e0+0.5e0*tanh(0.5e0*(22-any_value(b))))/any_value(width) AS b2,
  sum((y2+10*{_TH})/(x2+10*{_TH})-ln((y2+10*{_TH})/(x2+10*{_TH}))-1)*(0.5e0+0.5e0*tanh(0.5e0*(22-any_value(b))))/any_value(width) AS b4 FROM qy GROUP BY ALL) GROUP BY ALL)
 JOIN (SELECT stream_id, candidate, sqrt(avg(pow(x-y,2))) AS rms FROM dsmp GROUP BY ALL) USING (stream_id, candidate) GROUP BY ALL""",
    _pow_cte(_HANN), _mask_ctes(EDGES, "0", "3.16e-10", 6), _FWD,
    """qz AS (SELECT a.stream_id, a.frame_index, a.candidate, a.b, sum(p.e*pow(0.1e0, p.frame_index-a.frame_index)) AS e FROM (SELECT *, max(frame_index) OVER (PARTITION BY stream_id) AS top FROM qm) a
 JOIN (SELECT *, max(frame_index) OVER (PARTITION BY stream_id) AS top FROM qm) p ON p.stream_id=a.stream_id AND p.candidate=a.candidate AND p.b=a.b AND p.frame_index>=a.frame_index AND (p.frame_index=a.frame_index OR (p.frame_index<p.top)) GROUP BY ALL)""", _pair("0", "qz")))
def a17(spark, sf):
    out = metrics.high_rate_index(V.decoded_frames(spark, sf), [("pcm", "dec")], BANDS)
    return out.select(*SONG, *[r6(c, c) for c in ("err4", "err16", "rms")])


@query("a20_index16", with_views("dsmp", f"""SELECT stream_id, candidate, {s6('pow(avg(pow(abs(ef),3)),1e0/6)', 'error')} FROM (SELECT stream_id, candidate, frame_index, avg(eb) AS ef FROM (
  SELECT stream_id, candidate, frame_index, b, sum(pow(ln(y2/x2),2))/any_value(width) AS eb FROM qy WHERE before IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
    _pow_cte("0.54e0-0.46e0*cos(2*pi()*n/64)"), _mask_ctes(EDGES, "1e5"), _FWD, _pair("1e5")))
def a20(spark, sf):
    return metrics.index16(V.decoded_frames(spark, sf), "pcm", "dec", BANDS).select(*SONG, r6("error", "error"))


_BARK = "(8.288e-8*hz/(3.4225e-16*pow(hz,4)+1)+0.009694e0/(5.476e-7*pow(hz,2)+1)+1e-4)*16000/66"
_VT = "(0.1e0/(0.15e0*0.15e0+pow(k*pi()/960,2)))"


@query("a18_vocoder_index", with_views("dsmp", f"""SELECT stream_id, candidate, {s6('100*pow(avg(pow(e2,2)),0.25e0)/sqrt(sum(t2))', 'err4')}, {s6('100*pow(avg(pow(e4,4)),1e0/16)/sqrt(sum(t2))', 'err16')}, {s6('any_value(pe)', 'pitch_error')} FROM (
 SELECT stream_id, candidate, frame_index, sum(b2)/9 AS e2, sum(b4*b4)/9 AS e4, sum(bt)/9 AS t2 FROM (SELECT stream_id, candidate, frame_index, b,
  sum(pow(pow(y+{_VT},0.2e0)-pow(x+{_VT},0.2e0),2))/pow(any_value(hi-lo),2) AS b2, sum(pow(pow(y+10*{_VT},0.2e0)-pow(x+10*{_VT},0.2e0),2))/pow(any_value(hi-lo),2) AS b4, sum(pow(x+{_VT},0.4e0))/pow(any_value(hi-lo),2) AS bt
  FROM vb JOIN qb ON k>=lo AND k<hi GROUP BY ALL) GROUP BY ALL) JOIN vp USING (stream_id, candidate) GROUP BY ALL""",
    _pow_cte(_HANN),
    f"qb AS (SELECT * FROM (VALUES {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(BANDS))}) v(b, lo, hi))",
    f"vk AS (SELECT k, sum({_BARK}) OVER (ORDER BY k) AS z, coalesce(sum({_BARK}) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z0 FROM (SELECT k, 16000e0*k/66 AS hz FROM range(0,33) t(k)))",
    # what bin q gives to bin k, first to the higher bins, then from those to the lower ones
    "vw AS MATERIALIZED (SELECT k, q, sum(w) AS w FROM (SELECT a.k, b.k AS q, pow(0.1e0, m.z-b.z)*pow(0.0031623e0, m.z0-a.z0) AS w FROM vk a JOIN vk m ON m.k>=a.k JOIN vk b ON b.k<=m.k) GROUP BY ALL)",
    "vl AS (SELECT k, sum(w) AS total FROM vw GROUP BY 1)",
    "vs AS (SELECT stream_id, candidate, frame_index, vw.k, sum(w*px)/any_value(total) AS x, sum(w*py)/any_value(total) AS y FROM qp JOIN vw ON qp.k=vw.q JOIN vl ON vl.k=vw.k GROUP BY ALL)",
    "v0 AS MATERIALIZED (SELECT stream_id, candidate, frame_index, k, max(frame_index) OVER (PARTITION BY stream_id) AS top, greatest(x, f) AS x, greatest(y, f) AS y FROM (SELECT *, 1e-8*max(x) OVER (PARTITION BY stream_id, candidate, frame_index) AS f FROM vs))",
    "va AS MATERIALIZED (SELECT a.stream_id, a.candidate, a.frame_index, a.k, any_value(a.top) AS top, sum(p.x*pow(0.5e0, a.frame_index-p.frame_index)) AS x, sum(p.y*pow(0.5e0, a.frame_index-p.frame_index)) AS y FROM v0 a JOIN v0 p ON p.stream_id=a.stream_id AND p.candidate=a.candidate AND p.k=a.k AND p.frame_index<=a.frame_index GROUP BY ALL)",
    "vb AS (SELECT a.stream_id, a.candidate, a.frame_index, a.k, sum(p.x*pow(0.1e0, p.frame_index-a.frame_index)) AS x, sum(p.y*pow(0.1e0, p.frame_index-a.frame_index)) AS y FROM va a JOIN va p ON p.stream_id=a.stream_id AND p.candidate=a.candidate AND p.k=a.k AND p.frame_index>=a.frame_index AND (p.frame_index=a.frame_index OR p.frame_index<p.top) GROUP BY ALL)",
    "ve AS MATERIALIZED (SELECT stream_id, candidate, frame_index, list((x-0.8e0*px)*32768 ORDER BY n) AS x, list((y-0.8e0*py)*32768 ORDER BY n) AS y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM dsmp WINDOW w AS (PARTITION BY stream_id, candidate, frame_index ORDER BY n)) WHERE n>0 GROUP BY ALL)",
    "vc AS (SELECT stream_id, candidate, frame_index, lag, sum(x[i]*x[i-lag])/sqrt(sum(x[i]*x[i])*sum(x[i-lag]*x[i-lag])+31) AS cx, sum(y[i]*y[i-lag])/sqrt(sum(y[i]*y[i])*sum(y[i-lag]*y[i-lag])+31) AS cy FROM ve, range(33,64) t(i), range(4,33) u(lag) GROUP BY ALL)",
    "vp AS (SELECT stream_id, candidate, avg(CASE WHEN cx>0.7e0 THEN abs(cx-cy) END) AS pe FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, candidate, frame_index ORDER BY cx DESC, lag) AS r FROM vc) WHERE r=1 GROUP BY ALL)"))
def a18(spark, sf):
    f = V.decoded_frames(spark, sf)
    out = metrics.vocoder_index(f, "pcm", "dec", BANDS)
    pitch = metrics.pitch_peak_error(f, "pcm", "dec", 31, 4, 32)
    return out.join(pitch, SONG).select(*SONG, *[r6(c, c) for c in ("err4", "err16", "pitch_error")])


@query("a19_feature_errors", with_views("dsmp", f"""SELECT stream_id, candidate, {s6('sqrt(sum(m) FILTER (WHERE n<>62))', 'total_error')}, {s6('sqrt(max(m) FILTER (WHERE n<>62))', 'max_error')}, {s6('any_value(pe)', 'pitch_error')} FROM
 (SELECT stream_id, candidate, n, avg(pow(x-y,2)) AS m FROM dsmp GROUP BY ALL) JOIN
 (SELECT a.stream_id, a.candidate, avg(abs(b.x-b.y)) FILTER (WHERE a.x>0.2e0) AS pe FROM dsmp a JOIN dsmp b ON a.stream_id=b.stream_id AND a.candidate=b.candidate AND a.frame_index=b.frame_index AND a.n=63 AND b.n=62 GROUP BY ALL) USING (stream_id, candidate) GROUP BY ALL"""))
def a19(spark, sf):
    return metrics.feature_errors(V.decoded_frames(spark, sf), "pcm", "dec", 64, SONG).select(*SONG, *[r6(c, c) for c in ("total_error", "max_error", "pitch_error")])


@query("a21_highband_distortion", with_views("dsmp ddft", f"""SELECT stream_id, candidate, b AS band, {s6('dt', 'test_distortion')}, {s6('dl', 'low_passed_distortion')}, dt<=dl AS passed FROM (
 SELECT stream_id, candidate, b, 1000*sqrt(sum(pow((pow(greatest(r,fl),0.25e0)-pow(greatest(t,fl),0.25e0))/cnt,2))) AS dt, 1000*sqrt(sum(pow((pow(greatest(r,fl),0.25e0)-pow(greatest(l,fl),0.25e0))/cnt,2))) AS dl FROM (
  SELECT *, max(r) OVER w*1e-3 AS fl, count(*) OVER w AS cnt FROM (SELECT stream_id, candidate, frame_index, b, sum(m*m) AS r, sum(dm*dm) AS t, sum(CASE WHEN k<12 THEN m*m ELSE 0 END) AS l
   FROM ddft JOIN (SELECT * FROM (VALUES {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(BANDS))}) v(b,lo,hi)) ON k>=lo AND k<hi WHERE b>=5 GROUP BY ALL) WINDOW w AS (PARTITION BY stream_id, candidate, b)) GROUP BY ALL)"""))
def a21(spark, sf):
    out = metrics.highband_distortion(V.decoded_frames(spark, sf), "pcm", "dec", BANDS, 12)
    return out.select(*SONG, "band", r6("test_distortion", "test_distortion"), r6("low_passed_distortion", "low_passed_distortion"), "passed")


#: Frames of 64 samples, mirrored by half a window at both ends; windows of 64, 32 and 16 by halves; 16000 samples a second.
_MRD = ("em AS MATERIALIZED (SELECT stream_id, candidate, frame_index, n, x-0.85e0*coalesce(lag(x) OVER o,0) AS x, y-0.85e0*coalesce(lag(y) OVER o,0) AS y FROM dsmp WINDOW o AS (PARTITION BY stream_id, candidate, frame_index ORDER BY n))",
        """wn AS (SELECT s, j, i, CASE WHEN q<0 THEN -q WHEN q>63 THEN 126-q ELSE q END AS n, 0.5e0-0.5e0*cos(2*pi()*i/s) AS w
 FROM (SELECT s, j, i, j*(s//2)+i-s//2 AS q FROM (VALUES (64),(32),(16)) z(s), range(0,9) a(j), range(0,64) b(i) WHERE i<s AND j<=128//s))""",
        """mg AS MATERIALIZED (SELECT stream_id, candidate, frame_index, s, j, k, sqrt(pow(sum(x*w*cos(2*pi()*k*i/s)),2)+pow(sum(x*w*sin(2*pi()*k*i/s)),2)) AS m, sqrt(pow(sum(y*w*cos(2*pi()*k*i/s)),2)+pow(sum(y*w*sin(2*pi()*k*i/s)),2)) AS d
 FROM em JOIN wn USING (n), range(0,33) v(k) WHERE k<=s//2 GROUP BY ALL)""",
        """bk AS (SELECT s, i, k, g/sum(g) OVER (PARTITION BY s, i) AS g FROM (SELECT s, i, k, pow(10e0, (CASE WHEN e<0.5e0 THEN -12*e*e ELSE 3-12*e END)/10) AS g
 FROM (SELECT s, i, k, abs(k-i)*16000e0/s/(24.7e0+0.108e0*k*16000e0/s) AS e FROM (VALUES (64),(32),(16)) z(s), range(0,32) a(i), range(0,33) v(k) WHERE i<s//2 AND k<=s//2)))""",
        "sl AS (SELECT stream_id, candidate, s, avg(abs(lx-ly)) AS l1 FROM (SELECT stream_id, candidate, frame_index, s, j, i, ln(sum(m*g)+1e-9) AS lx, ln(sum(d*g)+1e-9) AS ly FROM mg JOIN bk USING (s, k) GROUP BY ALL) GROUP BY ALL)",
        "sd AS (SELECT stream_id, candidate, s, 1-sum(m*d)/sqrt(sum(m*m)*sum(d*d)+1e-9) AS dc FROM mg GROUP BY ALL)",
        "td AS (SELECT stream_id, candidate, avg(pow(x-y,2))/(sqrt(avg(y*y))+1e-6) AS t FROM em GROUP BY ALL)")


@query("a22_multi_resolution_distance", with_views("dsmp", f"SELECT stream_id, candidate, {s6('10*(avg(2*l1+dc)+10*any_value(t))/13', 'distance')} FROM sl JOIN sd USING (stream_id, candidate, s) JOIN td USING (stream_id, candidate) GROUP BY 1, 2", *_MRD))
def a22(spark, sf):
    out = metrics.multi_resolution_distance(V.decoded_frames(spark, sf), "pcm", "dec", [64, 32, 16])
    return out.select(*SONG, r6("distance", "distance"))

