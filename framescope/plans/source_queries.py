"""Queries for readers and writers: a view is written to the shared folder and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import evaluation as E
from framescope.operators import layout, ranking
from framescope.plans import views as V
from framescope.plans.metric_queries import ALL as SEARCH_CTES
from framescope.plans.metric_queries import songs
from framescope.plans.packet_queries import payloads
from framescope.plans.registry import query, r6, s6
from framescope.plans.telemetry_queries import CTES as SEG_CTES
from framescope.plans.telemetry_queries import segments
from framescope.plans.views import with_views
from framescope.sources import readers as R
from framescope.sources import writers as W

ID = ["stream_id", "frame_index"]
Q16 = "greatest(-32768, least(floor(0.5e0+x*32768), 32767))/32768e0"


def part(length):
    """Part number and file stem: long streams are written as several files."""
    return layout.segment_of("frame_index", length)


def joined(df, value: str, ext: str, length: int):
    """One file per stream and segment, rows in order; `value` is text made of hex digits."""
    g = df.select("stream_id", "frame_index", part(length).alias("p"), F.col(value).alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "h"))), lambda s: s["h"]), "")
    name = F.concat(F.col("stream_id").cast("string"), F.lit("-"), F.lpad(F.col("p").cast("string"), 8, "0"), F.lit(ext))
    return g.groupBy("stream_id", "p").agg(body.alias("hexed")).select(name.alias("name"), F.unhex("hexed").alias("content"))


def numbered(df, index: str, length: int):
    return df.select(F.substring_index("stream_id", "-", 1).cast("long").alias("stream_id"),
                     (F.substring_index("stream_id", "-", -1).cast("long") * length + F.col(index)).alias("frame_index"),
                     *[c for c in df.columns if c not in ("stream_id", index)])


@query("s01_read_pcm", with_views("smp", f"SELECT stream_id::bigint AS stream_id, frame_index, {s6(f'sum({Q16})', 'total')}, {s6(f'sum(pow({Q16},2))', 'energy')}, 2 AS channels FROM smp GROUP BY ALL"))
def s01(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "pcm")
    f = V.pcm_frames(spark, sf).withColumn("h", W.int16_bytes("pcm"))
    W.write_binary_files(joined(f, "h", ".pcm", n), path)
    b = numbered(R.read_pcm(spark, path, "s16", 2, 32), "block_index", n)
    flat = F.flatten("pcm")
    return b.select(*ID, r6(A.total(flat), "total"), r6(A.energy(flat), "energy"), F.size("pcm").alias("channels"))


def le(v, width):
    h = F.lpad(F.hex(v), width * 2, "0")
    return F.concat(*[F.substring(h, 2 * (width - i) - 1, 2) for i in range(width)])


@query("s02_read_wav", with_views("smp", f"SELECT stream_id::bigint AS stream_id, 'read' AS outcome, count(*)//64 AS blocks, {s6(f'sum(pow({Q16},2))', 'energy')} FROM smp WHERE stream_id%3<>2 GROUP BY ALL UNION ALL SELECT DISTINCT stream_id::bigint, 'rejected', 0, NULL::double FROM smp WHERE stream_id%3=2"))
def s02(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "wav")
    raw = joined(V.pcm_frames(spark, sf).withColumn("h", W.int16_bytes("pcm")), "h", ".wav", n)
    size = F.length("content")
    sid = F.substring_index("name", "-", 1).cast("long")
    rate = F.when(sid % 3 == 2, F.lit(16000)).otherwise(F.lit(48000))
    head = F.concat(F.hex(F.lit("RIFF")), le(size + 36, 4), F.hex(F.lit("WAVEfmt ")), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(2), 2),
                    le(rate, 4), le(rate * 4, 4), le(F.lit(4), 2), le(F.lit(16), 2), F.hex(F.lit("data")), le(size, 4))
    W.write_binary_files(raw.select("name", F.concat(F.unhex(head), "content").alias("content")), path)
    good, bad = R.read_wav(spark, path, block=32)
    sid = F.substring_index("stream_id", "-", 1).cast("long").alias("stream_id")
    ok = good.select(sid, A.energy(F.flatten("pcm")).alias("e")).groupBy("stream_id").agg(
        F.lit("read").alias("outcome"), F.count(F.lit(1)).alias("blocks"), r6(F.sum("e"), "energy"))
    return ok.unionByName(bad.select(sid).distinct().select(
        "stream_id", F.lit("rejected").alias("outcome"), F.lit(0).cast("long").alias("blocks"), F.lit(None).cast("double").alias("energy")))


@query("s03_read_telemetry", with_views("tel", f"""SELECT stream_id, frame_index, packet_bytes, analysis_valid::bigint AS analysis_valid, {s6("CASE WHEN event_id%10=0 THEN 0e0 ELSE round(tonality,6) END", 'tonality')}, {s6('round(activity,6)', 'activity')}, bandwidth::bigint AS bandwidth, 0::bigint AS in_dtx FROM tel"""))
def s03(spark, sf):
    path = layout.scratch_path(spark, "telemetry")
    t = V.telemetry(spark, sf)
    six = lambda c: F.format_string("%.6f", F.col(c))
    t.select("stream_id", "frame_index", "input_samples", "packet_bytes", "requested_bitrate_bps", "analysis_valid", F.lit("FB").alias("selected_bandwidth"),
             F.when(F.col("event_id") % 10 == 0, "").otherwise(six("tonality")).alias("analysis_tonality"),
             six("activity").alias("analysis_activity"), F.col("bandwidth").alias("analysis_bandwidth")).write.csv(path, header=True, emptyValue="")
    r = R.read_telemetry(spark, path)
    return r.select(F.col("stream_id").cast("long").alias("stream_id"), "frame_index", "packet_bytes", "analysis_valid",
                    r6("analysis_tonality", "tonality"), r6("analysis_activity", "activity"), F.col("analysis_bandwidth").alias("bandwidth"), "in_dtx")


@query("s04_plan_round_trip", with_views("tel", f"SELECT stream_id, frame_index, {s6('round_even(96000*(0.5e0+activity),0)', 'target_bitrate_bps')}, {s6('0.5e0+activity', 'scale')} FROM tel"))
def s04(spark, sf):
    path = layout.scratch_path(spark, "plan")
    s = S.d(0.5) + F.col("activity")
    W.write_plan(V.telemetry(spark, sf).select(*ID, s.alias("scale"), (S.d(96000) * s).alias("target_bitrate_bps")), path)
    return R.read_plan(spark, path).select(F.col("stream_id").cast("long").alias("stream_id"), "frame_index",
                                           r6("target_bitrate_bps", "target_bitrate_bps"), r6("scale", "scale"))


@query("s05_enum_plans", with_views("tel", """SELECT frame_index, count(*) AS lines, count(*) FILTER (WHERE event_id%7<5) AS bandwidth_rows, count(*) FILTER (WHERE event_id%5 IN (1,2)) AS channel_rows FROM tel GROUP BY 1"""))
def s05(spark, sf):
    p1, p2 = layout.scratch_path(spark, "bandwidth-plan"), layout.scratch_path(spark, "channels-plan")
    t = V.telemetry(spark, sf).select("frame_index", "event_id")
    names = F.array(*[F.lit(x) for x in ("nb", "MB", "wb", "SWB", "fb", "auto", "?")])
    t.select(F.concat_ws(",", "frame_index", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")))).write.text(p1)
    t.select(F.concat_ws(",", "frame_index", F.when(F.col("event_id") % 5 == 4, "x").otherwise((F.col("event_id") % 5).cast("string")))).write.text(p2)
    b = R.read_bandwidth_plan(spark, p1).groupBy("frame_index").agg(F.count(F.lit(1)).alias("bandwidth_rows"))
    c = R.read_channels_plan(spark, p2).groupBy("frame_index").agg(F.count(F.lit(1)).alias("channel_rows"))
    out = t.groupBy("frame_index").agg(F.count(F.lit(1)).alias("lines")).join(b, "frame_index", "left").join(c, "frame_index", "left")
    return out.select("frame_index", "lines", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("bandwidth_rows", "channel_rows")])


@query("s06_write_segments", with_views("tel", f"SELECT stream_id, segment_index, frames, segment_class, {s6('round(avg_packet_bytes,3)', 'avg_packet_bytes')}, {s6('round(budget_scale,6)', 'budget_scale')} FROM sm", *SEG_CTES))
def s06(spark, sf):
    path = layout.scratch_path(spark, "segments")
    W.write_segments(segments(spark, sf), path)
    r = spark.read.csv(path, header=True)
    return r.select(*[F.col(c).cast("long").alias(c) for c in ("stream_id", "segment_index", "frames")], "segment_class",
                    r6(F.col("avg_packet_bytes"), "avg_packet_bytes"), r6(F.col("budget_scale"), "budget_scale"))


@query("s07_read_packet_log", with_views("pk", 'SELECT stream_id, frame_index, "check", len AS bytes FROM pk'))
def s07(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "packets")
    p = payloads(spark, sf, "check")
    h = F.concat(F.lpad(F.hex(F.length("payload").cast("long")), 8, "0"), F.lpad(F.hex("check"), 8, "0"), F.hex("payload"))
    W.write_binary_files(joined(p.withColumn("h", h), "h", ".bit", n), path)
    return numbered(R.read_packet_log(spark, path, max_packet=1 << 20), "seq", n).select(*ID, "check", F.length("payload").cast("long").alias("bytes"))


def text_files(df, line, ext: str, path: str, length: int):
    """Ordered lines as small text files, one per stream and segment."""
    hexed = df.withColumn("_h", F.hex(F.concat(line, F.lit("\n"))))
    W.write_binary_files(joined(hexed, "_h", ext, length), path)


@query("s08_read_loss_trace", with_views("pk", "SELECT stream_id, frame_index, lost FROM pk"))
def s08(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "loss")
    text_files(V.packets(spark, sf), F.col("lost").cast("string"), ".txt", path, n)
    return numbered(R.read_loss_trace(spark, path).withColumnRenamed("trace_id", "stream_id"), "seq", n)


@query("s09_read_feature_matrix", f"SELECT label::bigint AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS frame_index, {s6('list_sum(list_transform(embedding[1:18], lambda x: x::double)) + embedding[20]::double', 'total')}, trunc(0.1::float + 50::float*embedding[19] + 100::float)::bigint AS period, {s6('list_sum(list_transform(embedding[21:36], lambda x: x::double))', 'lpc_total')}, {s6('list_sum(list_transform(embedding[37:64], lambda x: x::double))', 'rest_total')} FROM embeddings")
def s09(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "features")
    e = V.table(spark, sf, "embeddings").select(F.col("label").alias("stream_id"), "vec_id", F.col("embedding").alias("f"))
    e = layout.dense_index(e, ["stream_id"], F.floor(F.col("vec_id") / S.d(4096)), ["vec_id"])

    def body(batches):
        for b in batches:
            raw = [v.as_py() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pa.array(r, pa.float32()).to_numpy().tobytes().hex() for r in raw])],
                                             names=["stream_id", "frame_index", "h"])

    hexed = e.select("stream_id", "frame_index", "f").mapInArrow(body, T.StructType([
        e.schema["stream_id"], T.StructField("frame_index", T.LongType()), T.StructField("h", T.StringType())]))
    W.write_binary_files(joined(hexed, "h", ".f32", n), path)
    m = numbered(R.read_feature_matrix(spark, path, width=64).withColumnRenamed("source_name", "stream_id"), "row", n)

    def whole(c):
        return A.total(F.transform(c, lambda x: x.cast("double")))

    return m.select(*ID, r6(whole("features"), "total"), "period", r6(whole("lpc"), "lpc_total"), r6(whole("rest"), "rest_total"))


@query("s11_read_manifest", "SELECT s_name AS name, CASE s_nationkey%2 WHEN 0 THEN 'pool0' ELSE 'pool1' END AS pool, s_name||'.wav' AS wav FROM supplier")
def s11(spark, sf):
    path = layout.scratch_path(spark, "manifest")
    s = V.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "pool0").otherwise("pool1").alias("pool"),
                                              F.concat("s_name", F.lit(".wav")).alias("wav"))
    s.write.json(path)
    return R.read_manifest(spark, path, multi_line=False)


@query("s12_read_catalogue", "SELECT source AS client, 'clip_'||doc_id||'.mp3' AS path, CASE WHEN doc_id%2=0 THEN 'male_masculine' ELSE 'female_feminine' END AS gender FROM documents WHERE doc_id%13<>0")
def s12(spark, sf):
    path = layout.scratch_path(spark, "catalogue")
    i = F.col("doc_id")
    gender = F.when(i % 2 == 0, "male_masculine").otherwise("female_feminine")
    line = F.concat_ws("\t", "source", F.concat(F.lit("clip_"), i, F.lit(".mp3")), *[F.lit("x")] * 6, gender, F.lit("y"))
    V.table(spark, sf, "documents").select(F.when(i % 13 == 0, F.concat(F.lit("broken\t"), i)).otherwise(line)).write.text(path)
    return R.read_clip_catalogue(spark, path)


@query("s13_list_audio", "SELECT 'n'||s_nationkey||'/'||'s'||s_suppkey AS item FROM supplier WHERE s_suppkey%2=0")
def s13(spark, sf):
    path = layout.scratch_path(spark, "audio")
    s = V.table(spark, sf, "supplier")
    base = F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey")
    one = F.unhex(F.lit("00"))
    files = s.select(F.concat(base, F.lit(".wav")).alias("name"), one.alias("content")).unionByName(
        s.where("s_suppkey % 2 = 0").select(F.concat(base, F.lit("-features.f32")).alias("name"), one.alias("content")))
    W.write_binary_files(files, path)
    out = R.list_audio(spark, path, ".wav", "-features.f32")
    return out.select(F.regexp_extract("stem_path", r"(n\d+/s\d+)$", 1).alias("item"))


@query("s14_read_stats", with_views("tel", f"SELECT 'm'||stream_id AS metric, {s6('avg(activity)', 'mean')}, {s6('max(activity)', 'top')}, {s6('max_by(value, frame_index)', 'last_score')} FROM tel GROUP BY stream_id"))
def s14(spark, sf):
    p1, p2 = layout.scratch_path(spark, "stats"), layout.scratch_path(spark, "scores")
    n = layout.segment_length(spark)
    t = V.telemetry(spark, sf)
    st = t.groupBy("stream_id").agg(F.avg("activity").alias("a"), F.max("activity").alias("b"))
    lines = F.concat(F.lit("mean score: "), F.col("a").cast("string"), F.lit("\nbottom mean score: 0\ntop mean score: "), F.col("b").cast("string"), F.lit("\n"))
    W.write_binary_files(st.select(F.concat(F.lit("stats_m"), "stream_id", F.lit(".txt")).alias("name"), F.encode(lines, "UTF-8").alias("content")), p1)
    text_files(t, F.concat(F.lit("SCORE: "), F.col("value").cast("string"), F.lit("\nother line 1:2")), ".log", p2, n)
    wide = R.read_stats(spark, p1).groupBy("metric").pivot("label", ["mean score", "top mean score"]).agg(F.first("value"))
    run = F.concat(F.lit("m"), F.substring_index("run", "-", 1)).alias("metric")
    logged = R.read_prefixed_scores(spark, p2, "SCORE:")
    last = logged.select(run, F.substring_index("run", "-", -1).cast("long").alias("p"), "line", "score").groupBy("metric").agg(
        F.max_by("score", F.struct("p", "line")).alias("last_score"))
    return wide.join(last, "metric").select("metric", r6(F.col("mean score"), "mean"), r6(F.col("top mean score"), "top"), r6("last_score", "last_score"))


@query("s15_read_f0", with_views("f0", f"SELECT item AS stream_id, frame_index, {s6('round(pitch,6)', 'pitch')}, voicing::double AS voicing FROM f0"))
def s15(spark, sf):
    n, path = layout.segment_length(spark), layout.scratch_path(spark, "f0")
    p = V.pitch_frames(spark, sf).withColumnRenamed("item", "stream_id")
    text_files(p, F.concat(F.format_string("%.9f", "pitch"), F.lit("  "), F.col("voicing").cast("string")), ".f0", path, n)
    r = R.read_f0(spark, path).withColumnRenamed("item", "stream_id").withColumnRenamed("frame_index", "i")
    return numbered(r, "i", n).select(*ID, r6(F.round("pitch", 6), "pitch"), "voicing")


@query("s16_write_report", with_views("dsmp ddft", f"SELECT candidate, songs, {s6('score', 'score')}, (SELECT count(*) FROM sg) AS song_rows FROM st", *SEARCH_CTES))
def s16(spark, sf):
    path = layout.scratch_path(spark, "report")
    m = layout.cut_lineage(songs(spark, sf))
    s = layout.cut_lineage(ranking.stage_summary(m))
    W.write_report(m, s, ranking.promoted(s, 3), path)
    rows = spark.read.json(f"{path}/song-results", schema="candidate string, score double").agg(F.count(F.lit(1))).scalar()
    doc = spark.read.text(f"{path}/report").select(F.from_json("value", "promoted_candidates array<string>, summary array<string>").alias("d"))
    each = doc.select(F.explode("d.summary").alias("j")).select(F.from_json("j", "candidate string, songs long, score double").alias("x"))
    return each.select("x.candidate", "x.songs", r6(F.col("x.score"), "score"), rows.alias("song_rows"))


@query("s17_write_score_table", with_views("scores", "SELECT bitrate, " + ", ".join(
    f"printf('%.3f (%.2f)', avg(score) FILTER (WHERE condition='{c}'), stddev_pop(score) FILTER (WHERE condition='{c}')) AS {c}" for c in "ANR") + " FROM scores GROUP BY 1"))
def s17(spark, sf):
    path = layout.scratch_path(spark, "table")
    W.write_score_table(E.formatted_table(E.score_table(V.scores(spark, sf), list("ANR")), list("ANR")), path)
    return spark.read.csv(path, header=True, schema="bitrate int, A string, N string, R string")


@query("g01_text_functions", """SELECT doc_id, parse_filename('/data/'||lang||'/mic_F'||doc_id||'.wav', true) AS stem, CASE WHEN doc_id%2=0 THEN 'female' ELSE 'male' END AS gender, (doc_id*3)::double AS value, lang AS name FROM documents""")
def g01(spark, sf):
    d = V.table(spark, sf, "documents")
    path = F.concat(F.lit("/data/"), "lang", F.lit("/mic_F"), "doc_id", F.lit(".wav"))
    side = F.when(F.col("doc_id") % 2 == 0, F.lit("mic_F_1")).otherwise(F.lit("mic_M_1"))
    obj = F.to_json(F.struct(F.col("lang").alias("name"), (F.col("doc_id") * 3).alias("score")))
    line = F.concat(F.lit("label:"), F.get_json_object(obj, "$.score"))
    return d.select("doc_id", R.stem(path).alias("stem"), F.when(side.contains("mic_F"), "female").otherwise("male").alias("gender"),
                    F.substring_index(line, ":", -1).cast("double").alias("value"), F.get_json_object(obj, "$.name").alias("name"))
