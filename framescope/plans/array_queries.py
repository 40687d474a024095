"""Queries for array and spectral functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.functions import spectral
from framescope.operators import corpus, features, layout
from framescope.plans import views as V
from framescope.plans.planner_queries import BAND_SQL, BANDS, EDGES
from framescope.plans.registry import query, r6, s6
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]


def mags(spark, sf, **kw):
    return spectral.spectra(V.pcm_frames(spark, sf), {"pcm": ""}, **kw)


def per_bin(df, arr: str, name: str, index: str = "k"):
    return df.select(*ID, F.posexplode(arr).alias(index, "_v")).select(*ID, index, r6("_v", name))


def band_list(alias: str = "e") -> str:
    return f"list({alias} ORDER BY b)"


@query("x02_overlapped_frames", with_views("smp", f"""SELECT stream_id, frame_index, {s6('sum(x*(i+1))', 'moment')} FROM (
 SELECT a.stream_id, a.frame_index, b.x, (b.frame_index-a.frame_index)*64+b.n AS i FROM (SELECT DISTINCT stream_id, frame_index FROM smp) a
 JOIN smp b ON b.stream_id=a.stream_id AND b.frame_index BETWEEN a.frame_index AND a.frame_index+2 JOIN (SELECT stream_id, max(frame_index) AS top FROM smp GROUP BY 1) t ON t.stream_id=a.stream_id
 WHERE a.frame_index<=top-2 AND (b.frame_index-a.frame_index)*64+b.n < 136) GROUP BY ALL"""))
def x02(spark, sf):
    f = features.overlapped(V.pcm_frames(spark, sf), "pcm", 64, 136, "frame")
    return f.select(*ID, r6(A.total(F.transform("frame", lambda x, i: x * (i + 1))), "moment"))


@query("x03_spectrum", with_views("mag", f"SELECT stream_id, frame_index, k::int AS k, {s6('m', 'mag')} FROM mag"))
def x03(spark, sf):
    return per_bin(mags(spark, sf), "mag", "mag")


@query("h01_spectrum_phase", with_views("mag", f"SELECT stream_id, frame_index, {s6('sum(m*cos(ph))', 're')}, {s6('sum(m*sin(ph))', 'im')} FROM mag GROUP BY ALL"))
def h01(spark, sf):
    f = mags(spark, sf, phase=True)
    return f.select(*ID, r6(A.total(F.zip_with("mag", "phase", lambda m, p: m * F.cos(p))), "re"),
                    r6(A.total(F.zip_with("mag", "phase", lambda m, p: m * F.sin(p))), "im"))


@query("x04_band_power", with_views("mag", f"SELECT stream_id, frame_index, b::int AS band, {s6('sum(m*m + 1e-1)/any_value(hi-lo)', 'power')} FROM mag JOIN bands ON k>=lo AND k<hi GROUP BY ALL", BAND_SQL))
def x04(spark, sf):
    f = mags(spark, sf, power=True)
    f = f.withColumn("_b", A.band_means(F.transform("pow", lambda x: x + S.d(0.1)), BANDS))
    return per_bin(f, "_b", "power", "band")


@query("x05_band_pooling", with_views("mag", f"SELECT stream_id, frame_index, b::int AS band, {s6('sum(m)', 'level')} FROM mag JOIN (VALUES " + ", ".join(
    f"({i},{lo},{hi})" for i, (lo, hi) in enumerate([(0, 1), (1, 2), (1, 2), (1, 2), (2, 4), (4, 6), (6, 11), (11, 21), (21, 32)])) + ") v(b,lo,hi) ON k>=lo AND k<hi GROUP BY ALL"))
def x05(spark, sf):
    return per_bin(mags(spark, sf).withColumn("_b", A.band_sums("mag", A.bark_ranges(64))), "_b", "level", "band")


# centre bins of six bands at 16 kHz and 64 samples, from the scale's own formula
_CENTRES = [0.0] + [600 * math.sinh((i * 6 * math.asinh(8000 / 600) / 6) / 6) / 250 for i in range(1, 5)] + [32.0]
_FB = ", ".join(f"({j}, {_CENTRES[j]!r}::double, {_CENTRES[j + 1]!r}::double)" for j in range(5))
FB_SQL = f"""fbs AS (SELECT j, k, (c1-k)/(c1-c0) AS lo_w FROM (VALUES {_FB}) v(j,c0,c1), range(0,33) t(k) WHERE (k>c0 OR (j=0 AND k=0)) AND k<=c1),
fb AS (SELECT stream_id, frame_index, b, sum(m*w) AS v FROM mag JOIN (SELECT j AS b, k, lo_w AS w FROM fbs UNION ALL SELECT j+1, k, 1-lo_w FROM fbs) USING (k) GROUP BY ALL)"""


@query("x06_triangular_bands", with_views("mag", f"SELECT stream_id, frame_index, b::int AS band, {s6('v', 'level')} FROM fb", FB_SQL))
def x06(spark, sf):
    return per_bin(mags(spark, sf).withColumn("_b", A.matvec("mag", A.filter_bank(6, 64, 16000))), "_b", "level", "band")


@query("x07_cepstrum", with_views("mag", f"""SELECT stream_id, frame_index, c::int AS coefficient, {s6('sum(ln(v+1e-9)*sqrt((CASE WHEN c=0 THEN 1e0 ELSE 2e0 END)/6)*cos(pi()*c*(2*b+1)/12))', 'cepstrum')}
 FROM fb, range(0,6) t(c) GROUP BY ALL""", FB_SQL))
def x07(spark, sf):
    f = mags(spark, sf).withColumn("_l", A.log_bands(A.matvec("mag", A.filter_bank(6, 64, 16000))))
    return per_bin(f.withColumn("_c", A.matvec("_l", A.dct_rows(6))), "_c", "cepstrum", "coefficient")


BS = "bsum AS MATERIALIZED (SELECT stream_id, frame_index, b, sum(m) AS e FROM mag JOIN bands ON k>=lo AND k<hi GROUP BY ALL)"


@query("x09_frequency_masking", with_views("mag", f"""SELECT a.stream_id, a.frame_index, a.b::int AS band, {s6('sum(p.e*pow(0.03e0, p.b-a.b))', 'masked')} FROM up a
 JOIN up p ON p.stream_id=a.stream_id AND p.frame_index=a.frame_index AND p.b>=a.b GROUP BY ALL""", BAND_SQL, BS,
    "up AS MATERIALIZED (SELECT a.stream_id, a.frame_index, a.b, sum(p.e*pow(0.1e0, a.b-p.b)) AS e FROM bsum a JOIN bsum p ON p.stream_id=a.stream_id AND p.frame_index=a.frame_index AND p.b<=a.b GROUP BY ALL)"))
def x09(spark, sf):
    f = mags(spark, sf).withColumn("_b", A.frequency_mask(A.band_sums("mag", BANDS), len(BANDS)))
    return per_bin(f, "_b", "masked", "band")


@query("x10_cross_talk", with_views("pcm", f"SELECT stream_id, frame_index, {s6('sum(pow(pcm[i]+0.01e0*pcm[i+32],2))', 'left_energy')}, {s6('sum(pow(pcm[i+32]+0.01e0*pcm[i],2))', 'right_energy')} FROM pcm, range(1,33) t(i) GROUP BY ALL"))
def x10(spark, sf):
    left, right = F.slice("pcm", 1, 32), F.slice("pcm", 33, 32)
    return V.pcm_frames(spark, sf).select(*ID, r6(A.energy(A.cross_talk(left, right)), "left_energy"), r6(A.energy(A.cross_talk(right, left)), "right_energy"))


@query("x11_autocorrelation", with_views("pcm", f"""SELECT stream_id, frame_index, {s6('max(c)', 'peak')}, min_by(lag, (-c, lag))::int AS best_lag FROM (
 SELECT stream_id, frame_index, lag, sum(pcm[i]*pcm[i-lag])/sqrt(sum(pcm[i]*pcm[i])*sum(pcm[i-lag]*pcm[i-lag])+1e-3) AS c FROM pcm, range(33,65) t(i), range(4,33) u(lag) GROUP BY ALL) GROUP BY ALL"""))
def x11(spark, sf):
    f = V.pcm_frames(spark, sf).withColumn("_x", F.slice(A.autocorrelation("pcm", 32, 32, 1e-3), 5, 29))
    top = F.array_max("_x")
    return f.select(*ID, r6(top, "peak"), (F.array_position("_x", top).cast("int") + 3).alias("best_lag"))


@query("f11_voiced_frames", with_views("pcm", """SELECT stream_id, frame_index FROM (SELECT stream_id, frame_index, lag, sum(pcm[i]*pcm[i-lag])/sqrt(sum(pcm[i]*pcm[i])*sum(pcm[i-lag]*pcm[i-lag])+1e-3) AS c
 FROM pcm, range(33,65) t(i), range(4,33) u(lag) GROUP BY ALL) GROUP BY ALL HAVING max(c) > 0.2e0"""))
def f11(spark, sf):
    f = V.pcm_frames(spark, sf)
    return f.where(F.array_max(F.slice(A.autocorrelation("pcm", 32, 32, 1e-3), 5, 29)) > S.d(0.2)).select(*ID)


@query("x15_pre_emphasis", with_views("smp", f"SELECT stream_id, frame_index, {s6('sum(y*y)', 'energy')}, {s6('sum(y*(n+1))', 'moment')} FROM (SELECT *, x-0.85e0*lag(x,1,0e0) OVER (PARTITION BY stream_id ORDER BY frame_index, n) AS y FROM smp) GROUP BY ALL"))
def x15(spark, sf):
    f = layout.windowed(V.pcm_frames(spark, sf), {"_last": lambda w: F.element_at(F.lag("pcm").over(w), -1)}, before=1)
    f = f.withColumn("y", A.pre_emphasis("pcm", F.coalesce("_last", S.d(0))))
    return f.select(*ID, r6(A.energy("y"), "energy"), r6(A.total(F.transform("y", lambda v, i: v * (i + 1))), "moment"))


@query("x16_loudness", with_views("smp", f"SELECT stream_id, frame_index, {s6('sqrt(avg(x*x))', 'rms')}, {s6('20*log10(sqrt(avg(x*x)+1e-12))', 'loudness_db')} FROM smp GROUP BY ALL"))
def x16(spark, sf):
    return V.pcm_frames(spark, sf).select(*ID, r6(A.rms("pcm"), "rms"), r6(A.loudness_db("pcm"), "loudness_db"))


@query("w15_two_frame_sum", with_views("mag", f"SELECT stream_id, frame_index, k::int AS k, {s6('m + coalesce(lag(m) OVER (PARTITION BY stream_id, k ORDER BY frame_index), 0)', 'level')} FROM mag"))
def w15(spark, sf):
    f = layout.windowed(V.pcm_frames(spark, sf), {"_prev": lambda w: F.lag("pcm").over(w)}, before=1)
    f = spectral.spectra(f, {"pcm": "", "_prev": "p"})
    return per_bin(f.withColumn("_s", A.add("mag", "pmag")), "_s", "level")


@query("w35_compressed_log", with_views("mag", f"SELECT stream_id, frame_index, b::int AS band, {s6('v', 'level')} FROM lg", BAND_SQL, BS,
    """/*rec*/ bl AS (SELECT stream_id, frame_index, b, log10(e+1e-9) AS x FROM bsum),
lg AS (SELECT stream_id, frame_index, 0 AS b, greatest(-2e0-0.0e0, -2e0-0.5e0, x) AS v, greatest(-2e0, greatest(-2e0, -2e0-0.5e0, x)) AS top, greatest(-2e0-0.5e0, greatest(-2e0, -2e0-0.5e0, x)) AS fol FROM bl WHERE b=0
 UNION ALL SELECT l.stream_id, l.frame_index, l.b+1, greatest(top-1.5e0, fol-0.5e0, x), greatest(top, greatest(top-1.5e0, fol-0.5e0, x)), greatest(fol-0.5e0, greatest(top-1.5e0, fol-0.5e0, x)) FROM lg l JOIN bl ON bl.stream_id=l.stream_id AND bl.frame_index=l.frame_index AND bl.b=l.b+1)""".replace("greatest(-2e0-0.0e0, -2e0-0.5e0, x) AS v", "greatest(-3.5e0, -2.5e0, x) AS v").replace("greatest(-2e0, greatest(-2e0, -2e0-0.5e0, x))", "greatest(-2e0, -2.5e0, x)").replace("greatest(-2e0-0.5e0, greatest(-2e0, -2e0-0.5e0, x))", "greatest(-2.5e0, x)")))
def w35(spark, sf):
    # drops of 1.5 and 0.5 instead of 8 and 2.5, so that the small test spectra reach both limits
    f = mags(spark, sf).withColumn("_b", A.compressed_log(A.band_sums("mag", BANDS), drop=1.5, follow_drop=0.5))
    return per_bin(f, "_b", "level", "band")


@query("w28_silence_trim", with_views("smp", """SELECT e.stream_id, e.frame_index FROM e JOIN (SELECT stream_id, greatest(coalesce(min(frame_index) FILTER (WHERE e>0.05e0*ref), max(frame_index))-2, 0) AS a,
 least(coalesce(max(frame_index) FILTER (WHERE e>0.05e0*ref), 0)+2, max(frame_index)) AS z FROM e JOIN rf USING (stream_id) GROUP BY 1) s ON s.stream_id=e.stream_id WHERE frame_index>=a AND frame_index<z""",
    "e AS (SELECT stream_id, frame_index, sum(x*x) AS e FROM smp GROUP BY ALL)", "rf AS (SELECT stream_id, list_sort(list(e))[floor(0.9e0*count(*))::int+1] AS ref FROM e GROUP BY 1)"))
def w28(spark, sf):
    f = V.pcm_frames(spark, sf).select(*ID, A.energy("pcm").alias("e"))
    return corpus.trim_silence(f, "e", 0.05, 2).select(*ID)


@query("f05_bandwidth_class", with_views("mag", f"""SELECT stream_id, {s6('wb', 'wb')}, {s6('swb', 'swb')}, {s6('fb', 'fb')}, CASE WHEN swb/wb<1e-5 THEN 'wb' WHEN fb/wb<1e-7 THEN 'swb' ELSE 'fb' END AS bandwidth_class FROM (
 SELECT stream_id, sum(m*m) FILTER (WHERE k<8)/8e0 AS wb, sum(m*m) FILTER (WHERE k>=10 AND k<20)/10e0 AS swb, sum(m*m) FILTER (WHERE k>=22)/11e0 AS fb FROM mg
 JOIN en USING (stream_id, frame_index) JOIN (SELECT stream_id, list_sort(list(e))[floor(0.9e0*count(*))::int+1] AS ref FROM en GROUP BY 1) USING (stream_id) WHERE e > 0.1e0*ref GROUP BY 1)""",
    "mg AS MATERIALIZED (SELECT * FROM mag)", "en AS (SELECT stream_id, frame_index, sum(m*m) AS e FROM mg GROUP BY ALL)"))
def f05(spark, sf):
    out = corpus.bandwidth_class(mags(spark, sf, power=True), "pow", (8, 20, 33), margin=2)
    return out.select("stream_id", *[r6(c, c) for c in ("wb", "swb", "fb")], "bandwidth_class")


@query("k07_mix_at_snr", with_views("smp", f"""SELECT stream_id, frame_index, {s6('sum(pow(x + CASE WHEN en>0 THEN sqrt(es/en*pow(10e0,-(frame_index%30-10)/10e0)) ELSE 0 END*y, 2))', 'energy')} FROM (
 SELECT a.stream_id, a.frame_index, a.x, b.x AS y, sum(a.x*a.x) OVER w AS es, sum(b.x*b.x) OVER w AS en FROM smp a JOIN smp b ON b.stream_id=a.stream_id AND b.frame_index=a.frame_index-1 AND b.n=a.n WINDOW w AS (PARTITION BY a.stream_id, a.frame_index)) GROUP BY ALL"""))
def k07(spark, sf):
    f = layout.windowed(V.pcm_frames(spark, sf), {"noise": lambda w: F.lag("pcm").over(w)}, before=1).where(F.col("noise").isNotNull())
    return f.select(*ID, r6(A.energy(corpus.mix_at_snr("pcm", "noise", (F.col("frame_index") % 30 - 10).cast("double"))), "energy"))


@query("k15_interleaved_signal", with_views("smp", f"SELECT stream_id, frame_index-2 AS frame_index, {s6('sum(y*(4*n+3))', 'moment')} FROM (SELECT *, x-0.85e0*lag(x,1,0e0) OVER (PARTITION BY stream_id ORDER BY frame_index, n) AS y FROM smp) WHERE frame_index>=2 GROUP BY ALL"))
def k15(spark, sf):
    f = corpus.interleaved_training_signal(V.pcm_frames(spark, sf), "pcm", 2)
    return f.select(*ID, r6(A.total(F.transform("signal", lambda v, i: v * (i + 1))), "moment"))


@query("x17_embedding_distance", f"""SELECT vec_id AS item, {s6('sqrt(sum(pow(x-round_even(x*8,0)::double/8,2)))', 'distance')} FROM (SELECT vec_id, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1""")
def x17(spark, sf):
    from framescope.operators.evaluation import embedding_distance
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("reference"))
    d = e.select("item", F.transform("reference", lambda x: F.rint(x * 8) / 8).alias("degraded"))
    return embedding_distance(e, d).select("item", r6("distance", "distance"))


@query("j11_reference_and_degraded", f"""SELECT vec_id AS item, label, {s6('sqrt(sum(pow(x-round_even(x*16,0)::double/16,2)))', 'distance')} FROM (SELECT vec_id, label, unnest(embedding)::double AS x FROM embeddings) GROUP BY ALL""")
def j11(spark, sf):
    """Equi-join on the item, one distance per pair; no pair of different items is ever formed."""
    from framescope.operators.evaluation import embedding_distance
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label", F.col("embedding").cast("array<double>").alias("reference"))
    d = e.select("item", F.transform("reference", lambda x: F.rint(x * 16) / 16).alias("degraded"))
    return embedding_distance(e, d).join(e.select("item", "label"), "item").select("item", "label", r6("distance", "distance"))


assert EDGES[-1] == 33
