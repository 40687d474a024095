"""Queries for projections, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import layout, quantiles
from framescope.plans import views as V
from framescope.plans.registry import clamp_sql as CL
from framescope.plans.registry import draw_sql, query, r6, s6
from framescope.plans.views import with_views

ID = ["stream_id", "frame_index"]
DIFFICULTY_SQL = (
    "CASE WHEN analysis_valid=0 THEN 0e0 ELSE " + CL(
        f"0.28e0*{CL('activity')} + 0.20e0*{CL('noisiness')} + 0.16e0*{CL('tonality')} + 0.14e0*{CL('bandwidth/20e0')}"
        f" + 0.12e0*{CL('activity_probability')} + 0.10e0*{CL('abs(tonality_slope)*4e0')}"
        f" + 0.10e0*{CL('activity*(1.1e0-0.5e0*tonality)')}") + " END")
TW_SQL = CL("0.55e0*activity + 0.45e0*noisiness")


def frame_columns(name: str, cols, sql: dict, view=V.telemetry, sql_view: str = "tel", ident=("stream_id", "frame_index")):
    """A query that computes columns row by row; doubles are rounded."""
    body = ", ".join([*ident, *[v.format(n=k) if "{n}" in v else s6(v, k) for k, v in sql.items()]])

    @query(name, with_views(sql_view, f"SELECT {body} FROM {sql_view.split()[-1]}"))
    def run(spark, sf):
        df = view(spark, sf)
        return df.select(*ident, *[c.alias(k) if "{n}" in sql[k] else r6(c, k) for k, c in cols().items()])
    return run


frame_columns("p01_clamp", lambda: {"x": S.clamp(F.col("packet_bytes") / S.d(500) - S.d(0.5), 0, 1)},
              {"x": CL("packet_bytes/500e0 - 0.5e0")})
frame_columns("p02_frame_difficulty", lambda: {"difficulty": S.frame_difficulty()}, {"difficulty": DIFFICULTY_SQL})
frame_columns("p03_classify", lambda: {"segment_class": S.classify_segment(S.frame_difficulty())},
              {"segment_class": "(CASE WHEN x>=0.82e0 THEN 'killer' WHEN x>=0.67e0 THEN 'hard' WHEN x>=0.50e0 THEN 'active'"
               " WHEN x>=0.32e0 THEN 'steady' ELSE 'easy' END) AS {n}".replace("x>=", f"({DIFFICULTY_SQL})>=")})
frame_columns("p04_transient_weight", lambda: {"transient_weight": S.transient_weight()}, {"transient_weight": TW_SQL})
frame_columns("p05_calm_base", lambda: {"calm_base": S.calm_base()},
              {"calm_base": f"0.88e0 + (1e0-0.88e0)*{CL('0.7e0*tonality + 0.3e0*(1e0-noisiness)')}"})
frame_columns("p06_target_bitrate",
              lambda: {"target_bitrate_bps": S.target_bitrate(F.col("requested_bitrate_bps"), F.col("activity") * S.d(1.25))},
              {"target_bitrate_bps": "greatest(6000, round_even(requested_bitrate_bps*(activity*1.25e0), 0)::bigint) AS {n}"})
frame_columns("p09_decibels",
              lambda: {"db": S.db20(F.col("value")), "power_db": S.power_db(F.col("activity")),
               "ratio_db": S.d(10) * F.log10(F.greatest(F.col("noisiness"), S.d(1e-20)))},
              {"db": "20e0*log10(value)", "power_db": "10e0*log10(activity + 1e-12)",
               "ratio_db": "10e0*log10(greatest(noisiness, 1e-20))"})
frame_columns("p12_pitch_cents", lambda: {"cents": S.pitch_cents("pitch"), "cents_class": S.pitch_class(F.col("pitch") * S.d(1.0017))},
              {"cents": "round_even(1200*log2(pitch/62.5e0 + 1e-8), 0)::bigint AS {n}",
               "cents_class": "(CASE WHEN pitch>0 THEN greatest(0, least(179, round_even(60*log2(pitch*1.0017e0/62.5e0), 0))) ELSE 0 END)::bigint AS {n}"},
              V.pitch_frames, "f0", ("item", "frame_index"))
frame_columns("p13_period_cents", lambda: {"cents": S.period_cents((F.col("packet_bytes") % 224 + 32).cast("double"))},
              {"cents": "1200e0*log2(256e0/(packet_bytes % 224 + 32))"})
frame_columns("p14_mu_law", lambda: {"u": S.lin2ulaw(F.col("event_id") * 71 % 65536 - 32768.0),
                             "x": S.ulaw2lin(S.lin2ulaw(F.col("event_id") * 71 % 65536 - 32768.0))},
              {"u": "{u} AS {{n}}".format(u="greatest(0e0, least(255e0, 128 + round_even(sign(v)*128*ln(1+255e0/32768e0*abs(v))/ln(256e0), 0)::double))".replace("v)", "(event_id*71 % 65536 - 32768)::double)")),
               "x": "sign(u-128)*32768e0/255e0*(exp(abs(u-128)/128e0*ln(256e0))-1)".replace(
                   "u-128", "greatest(0e0, least(255e0, 128 + round_even(sign(v)*128*ln(1+255e0/32768e0*abs(v))/ln(256e0), 0)::double)) - 128".replace("v)", "(event_id*71 % 65536 - 32768)::double)"))})
frame_columns("p15_bark_erb", lambda: {"bark": S.bark(F.col("value") * 16), "hz": S.inv_bark(S.bark(F.col("value") * 16)),
                               "erb": S.erb(F.col("value") * 16), "hz2": S.inv_erb(S.erb(F.col("value") * 16))},
              {"bark": "6*asinh(value*16/600)", "hz": "600*sinh(asinh(value*16/600))",
               "erb": "24.7e0*(4.37e0*(value*16)+1)", "hz2": "value*16"})
frame_columns("p17_spreading_decay", lambda: {"right": S.spreading_decay(F.col("packet_bytes") % 480, 480, 48000, 0.1),
                                      "left": S.spreading_decay(F.col("packet_bytes") % 480, 480, 48000, 0.0031623)},
              {k: f"pow({b}e0, (8.288e-8*f/(3.4225e-16*pow(f,4)+1) + 0.009694e0/(5.476e-7*f*f+1) + 1e-4)*50e0)".replace("f*f", "(50e0*(packet_bytes%480))*(50e0*(packet_bytes%480))").replace("*f/", "*(50e0*(packet_bytes%480))/").replace("pow(f,4)", "pow(50e0*(packet_bytes%480),4)")
               for k, b in (("right", 0.1), ("left", 0.0031623))})
BW_SQL = ("CASE WHEN toc & 128 <> 0 THEN (CASE (toc >> 5) & 3 WHEN 0 THEN 'NB' WHEN 1 THEN 'WB' WHEN 2 THEN 'SWB' ELSE 'FB' END)"
          " WHEN toc & 96 = 96 THEN (CASE WHEN toc & 16 <> 0 THEN 'FB' ELSE 'SWB' END)"
          " ELSE (CASE (toc >> 5) & 3 WHEN 0 THEN 'NB' WHEN 1 THEN 'MB' WHEN 2 THEN 'WB' ELSE 'SWB' END) END")
MODE_SQL = "CASE WHEN toc & 128 <> 0 THEN 'transform' WHEN toc & 96 = 96 THEN 'hybrid' ELSE 'speech' END"
CHAN_SQL = "CASE WHEN toc & 4 <> 0 THEN 2 ELSE 1 END"
SPF_SQL = ("(CASE WHEN toc & 128 <> 0 THEN 120 << ((toc >> 3) & 3) WHEN toc & 96 = 96 THEN (CASE WHEN toc & 8 <> 0 THEN 960 ELSE 480 END)"
           " WHEN (toc >> 3) & 3 = 3 THEN 2880 ELSE 480 << ((toc >> 3) & 3) END)::bigint")
NFR_SQL = "(CASE WHEN len < 1 THEN -1 WHEN toc & 3 = 0 THEN 1 WHEN toc & 3 <> 3 THEN 2 WHEN len < 2 THEN -4 ELSE b1 & 63 END)"
frame_columns("p18_packet_header",
              lambda: {"mode": S.packet_mode("toc"), "bandwidth": S.packet_bandwidth("toc"), "channels": S.packet_channels("toc"),
               "frame_samples": S.samples_per_frame("toc")},
              {"mode": f"({MODE_SQL}) AS {{n}}", "bandwidth": f"({BW_SQL}) AS {{n}}", "channels": f"({CHAN_SQL}) AS {{n}}",
               "frame_samples": f"{SPF_SQL} AS {{n}}"}, V.packets, "pk")
frame_columns("p19_packet_samples",
              lambda: {"frames": S.frames_per_packet("toc", "b1", "len"), "samples": S.samples_per_packet("toc", "b1", "len")},
              {"frames": f"{NFR_SQL} AS {{n}}",
               "samples": f"(CASE WHEN {NFR_SQL} < 0 THEN {NFR_SQL} WHEN {NFR_SQL}*{SPF_SQL}*25 > 144000 THEN -4 ELSE {NFR_SQL}*{SPF_SQL} END)::bigint AS {{n}}"},
              V.packets, "pk")
frame_columns("p21_quantizer_level",
              lambda: {"level": S.quantizer_level(3, 5, 15, F.col("frame_index") % 26),
               "lambda_": S.level_lambda(S.quantizer_level(3, 5, 15, F.col("frame_index") % 26))},
              {"level": "least(3 + (8*(frame_index % 26) + 8)//16, 15)::bigint AS {n}",
               "lambda_": "0.0002e0*exp(least(3 + (8*(frame_index % 26) + 8)//16, 15)/(15/ln(0.0135e0/0.0002e0)))"})
# Rate table (rate, share, rate below, share below), restated for the SQL.
_RS = [(12000, 11000, 0, 0), (16000, 15000, 12000, 11000), (20000, 18000, 16000, 15000), (24000, 21000, 20000, 18000),
       (32000, 28000, 24000, 21000), (64000, 50000, 32000, 28000)]
frame_columns("p22_rate_split", lambda: {"share": S.rate_split(F.col("packet_bytes") * 50, True, True)},
              {"share": "(CASE " + " ".join(
                  f"WHEN packet_bytes*50 < {x1} THEN ({lo}*({x1}-packet_bytes*50) + {hi}*(packet_bytes*50-{x0}))//{x1 - x0}"
                  for x1, hi, x0, lo in _RS) + " ELSE 50000 + (packet_bytes*50-64000)//2 END)::bigint AS {n}"})
frame_columns("p23_quantize16", lambda: {"q": S.quantize16((F.col("value") - 245) * 150), "c": S.clip16((F.col("value") - 245) * 150)},
              {"q": "greatest(-32767e0, least(floor(0.5e0 + (value-245)*150), 32767e0))",
               "c": "greatest(-32767e0, least((value-245)*150, 32767e0))"})


@query("p08_kbps", with_views("tel", f"SELECT stream_id, {s6('sum(packet_bytes)*8e0*48000/count(*)/960/1000', 'kbps')} FROM tel GROUP BY 1"))
def p08(spark, sf):
    t = V.telemetry(spark, sf)
    return t.groupBy("stream_id").agg(r6(S.kbps(F.sum("packet_bytes"), F.count(F.lit(1)), F.first("input_samples")), "kbps"))


@query("p10_downmix", with_views("pcm", f"""SELECT stream_id, frame_index, {s6('sum(pow((l+r)/2,2))', 'mid')}, {s6('sum(pow((l-r)/2,2))', 'side')}
FROM (SELECT stream_id, frame_index, pcm[i] AS l, pcm[i+32] AS r FROM pcm, range(1, 33) t(i)) GROUP BY ALL"""))
def p10(spark, sf):
    f = V.pcm_frames(spark, sf)
    left, right = F.slice("pcm", 1, 32), F.slice("pcm", 33, 32)
    return f.select(*ID, r6(A.energy(F.zip_with(left, right, lambda x, y: (x + y) * 0.5)), "mid"),
                    r6(A.energy(F.zip_with(left, right, lambda x, y: (x - y) * 0.5)), "side"))


MIX = [[0.7, 0.3], [0.5, -0.5], [0.25, 1.0]]


@query("p11_channel_matrix", with_views("pcm", f"""SELECT stream_id, frame_index, r AS out_channel,
 {s6('sum(pow(w0*pcm[i] + w1*pcm[i+32], 2))', 'energy')} FROM pcm, range(1, 33) t(i),
 (VALUES (0, 0.7e0, 0.3e0), (1, 0.5e0, -0.5e0), (2, 0.25e0, 1e0)) m(r, w0, w1) GROUP BY ALL"""))
def p11(spark, sf):
    f = V.pcm_frames(spark, sf)
    chans = [F.slice("pcm", 1, 32), F.slice("pcm", 33, 32)]
    mixed = F.array(*[A.energy(mix_channels(chans, row)) for row in MIX])
    return f.select(*ID, F.posexplode(mixed).alias("out_channel", "e")).select(*ID, "out_channel", r6("e", "energy"))


def mix_channels(channels, row):
    """One output channel: the weighted sum of the input channels' sample arrays."""
    out = A.scale(channels[0], F.lit(float(row[0])))
    for c, w in list(zip(channels, row))[1:]:
        out = A.add(out, A.scale(c, F.lit(float(w))))
    return out


@query("p16_perceptual_weight", with_views("tel", f"""SELECT stream_id, frame_index, {s6('w/max(w) OVER ()', 'weight')} FROM
 (SELECT *, pow(10e0, (20*log10(greatest(12194e0*12194e0*f2*f2/greatest((f2+20.6e0*20.6e0)*sqrt((f2+107.7e0*107.7e0)*(f2+737.9e0*737.9e0))*(f2+12194e0*12194e0),1e-20),1e-20))+2)/20)
   *(1+0.45e0*exp(-0.5e0*pow((hz-3200)/1400,2))) AS w FROM (SELECT *, pow(greatest(packet_bytes*12e0,1e0),2) AS f2, packet_bytes*12e0 AS hz FROM tel))"""))
def p16(spark, sf):
    t = V.telemetry(spark, sf).select(*ID, S.perceptual_weight(F.col("packet_bytes") * S.d(12)).alias("w"))
    return t.select(*ID, r6(F.col("w") / t.agg(F.max("w")).scalar(), "weight"))


@query("p24_normalise_gain", with_views("pcm", f"""SELECT stream_id, frame_index,
 {s6("pow(10e0, (-6 + 6*" + draw_sql('stream_id*100000+frame_index', 11, 'level') + ")/20)*32767/max(abs(x))", 'gain')},
 {s6("pow(10e0, (-6 + 6*" + draw_sql('stream_id*100000+frame_index', 11, 'level') + ")/20)*32767/max(abs(x))*min(x)", 'lowest')}
 FROM smp GROUP BY stream_id, frame_index""".replace("FROM smp", "FROM (SELECT stream_id, frame_index, unnest(pcm) AS x FROM pcm)")))
def p24(spark, sf):
    f = V.pcm_frames(spark, sf)
    level = S.d(-6) + S.d(6) * S.draw(F.col("stream_id") * 100000 + F.col("frame_index"), 11, "level")
    gain = normalise_gain("pcm", level)
    return f.select(*ID, r6(gain, "gain"), r6(gain * F.array_min("pcm"), "lowest"))


def normalise_gain(arr, level_db, top: float = 32767.0):
    return F.pow(S.d(10), level_db / S.d(20)) * S.d(top) / F.array_max(F.transform(arr, lambda x: F.abs(x)))


# ------------------------------------------------------------------ predicates
@query("f01_silence", with_views("pcm", f"""SELECT stream_id, frame_index, loud < quantile_cont(loud, 0.5) OVER (PARTITION BY stream_id) - 10e0 AS silent,
 loud < -40e0 AS absolute_silence FROM (SELECT stream_id, frame_index, 20*log10(sqrt(avg(x*x)+1e-12)) AS loud
 FROM (SELECT stream_id, frame_index, unnest(pcm) AS x FROM pcm) GROUP BY ALL)"""))
def f01(spark, sf):
    # margins narrower than the defaults, so that the test frames fall on both sides
    return silence(V.pcm_frames(spark, sf).select(*ID, A.loudness_db("pcm").alias("loudness_db")), 10.0, -40.0).select(
        *ID, "silent", "absolute_silence")


def silence(frames, below_median_db: float = 40.0, absolute_db: float = -75.0):
    med = quantiles.quantiles(frames, "loudness_db", {"median_db": 0.5})
    return (layout.attach(frames, med)
            .withColumn("silent", F.col("loudness_db") < F.col("median_db") - S.d(below_median_db))
            .withColumn("absolute_silence", F.col("loudness_db") < S.d(absolute_db)))


@query("f03_voicing_gate", with_views("f0", """SELECT item, frame_index FROM (SELECT *, max(rms) OVER (PARTITION BY item) AS top FROM f0)
 WHERE voicing=1 AND rms > 0.05e0*top AND pitch BETWEEN 65 AND 500 AND (gender<>'female' OR pitch >= 125)"""))
def f03(spark, sf):
    f = layout.stream_stats(V.pitch_frames(spark, sf), [F.max("rms").alias("rms_max")], ("item",))
    return f.where(S.voicing_gate(F.col("voicing") == 1, "rms", "rms_max", "pitch", F.col("gender") == "female")).select(
        "item", "frame_index")


frame_columns("f04_confidence_gate", lambda: {"confidence": S.confidence_gate("confidence", "pitch")},
              {"confidence": "CASE WHEN confidence < 0.4e0 OR pitch < 62.5e0 OR pitch > 500 THEN 0e0 ELSE confidence END"},
              V.pitch_frames, "f0", ("item", "frame_index"))


@query("f06_minimum_length", with_views("clips", "SELECT path, length FROM clips WHERE length >= 10*40"))
def f06(spark, sf):
    return minimum_length(V.clips(spark, sf), 40).select("path", "length")


def minimum_length(items, overlap: int):
    return items.where(F.col("length") >= 10 * overlap)


@query("f07_rate_gate", with_views("clips", """SELECT path, fs FROM (SELECT path, CASE path % 4 WHEN 0 THEN 8000 WHEN 1 THEN 16000 WHEN 2 THEN 44100 ELSE 48000 END AS fs FROM clips) WHERE fs >= 44100"""))
def f07(spark, sf):
    k = F.col("path") % 4
    c = V.clips(spark, sf).select("path", F.when(k == 0, 8000).when(k == 1, 16000).when(k == 2, 44100).otherwise(48000).alias("fs"))
    return rate_gate(c, 44100)


def rate_gate(items, target: int):
    return items.where(F.col("fs") >= target)


@query("f09_run_uuid", """SELECT s_suppkey AS run FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE
 substr(md5(s_suppkey::varchar),1,8)||'-'||substr(md5(s_suppkey::varchar),9,4)||'-'||substr(md5(s_suppkey::varchar),13,4)||'-'||substr(md5(s_suppkey::varchar),17,4)||'-'||substr(md5(s_suppkey::varchar),21,12) END AS folder FROM supplier)
 WHERE regexp_full_match(folder, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')""")
def f09(spark, sf):
    h = F.md5(F.col("s_suppkey").cast("string"))
    folder = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(
        F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), folder.alias("folder")).where(
        S.run_id_is_uuid("folder")).select("run")


@query("f10_active_packets", with_views("tel", "SELECT stream_id, count(*) FILTER (WHERE value*1000 > 1e5) AS active, sum(packet_bytes*8) FILTER (WHERE value*1000 > 1e5)::bigint AS active_bits FROM tel GROUP BY 1"))
def f10(spark, sf):
    on = F.col("value") * 1000 > S.d(1e5)
    return V.telemetry(spark, sf).groupBy("stream_id").agg(
        F.count_if(on).alias("active"), F.sum(F.when(on, F.col("packet_bytes") * 8)).alias("active_bits"))


frame_columns("f12_thresholds", lambda: {"passed": S.within_thresholds([("tonality", 0.5), ("noisiness", 0.7), ("activity", 0.9)])},
              {"passed": "(tonality <= 0.5e0 AND noisiness <= 0.7e0 AND activity <= 0.9e0) AS {n}"})
