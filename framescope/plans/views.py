"""Input views over the given tables, in Spark and as SQL text with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators.layout import dense_index

CANDIDATES = {"q08": 8, "q16": 16, "q32": 32, "q64": 64}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ratio(k: int, m: int):
    return (F.col("event_id") * k % m).cast("double") / F.lit(float(m))


def event_features(e: DataFrame) -> DataFrame:
    """Frame features from events, before any numbering (also usable on a stream)."""
    return e.select(
        F.col("user_id").alias("stream_id"), "event_id", "ts", "event_type", "value",
        F.lit(960).alias("input_samples"), F.lit(960).alias("encoded_samples"),
        (F.floor(F.col("value") * 4).cast("long") + 3).alias("packet_bytes"),
        F.lit(96000).cast("long").alias("requested_bitrate_bps"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("analysis_valid"),
        _ratio(37, 1000).alias("tonality"), _ratio(61, 997).alias("activity"),
        _ratio(17, 101).alias("activity_probability"), _ratio(71, 103).alias("music_prob"),
        (F.col("event_id") % 21).cast("int").alias("bandwidth"),
        ((F.col("event_id") * 29 % 1000).cast("double") / F.lit(2000.0) - F.lit(0.25)).alias("tonality_slope"),
        _ratio(53, 991).alias("noisiness"), _ratio(43, 907).alias("max_pitch_ratio"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(60.0))
    return dense_index(event_features(table(spark, sf, "events")), ["stream_id"], minute, ["ts", "event_id"])


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select(
        "stream_id", "frame_index", "event_id",
        (F.col("event_id") * 61 % 256).cast("int").alias("toc"),
        (F.col("event_id") * 7 % 256).cast("int").alias("b1"),
        F.col("packet_bytes").alias("len"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("lost"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("has_lbrr"),
        (F.col("event_id") * 2654435761 % 4294967296).alias("check"))


def pcm_frames(spark: SparkSession, sf: str) -> DataFrame:
    # the given vectors all have length 1; a gain by id gives loud and quiet frames
    gain = (F.col("vec_id") * 37 % 100 + 1).cast("double") / F.lit(50.0)
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("stream_id"), "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * gain).alias("pcm"))
    return dense_index(e, ["stream_id"], F.floor(F.col("vec_id") / F.lit(4096.0)), ["vec_id"]).drop("vec_id")


def decoded_frames(spark: SparkSession, sf: str, names=tuple(CANDIDATES)) -> DataFrame:
    """Every frame once per candidate: candidate, pcm (reference), dec."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.lit(float(CANDIDATES[n])).alias("q")) for n in names]))
    f = pcm_frames(spark, sf).withColumn("_g", grid)
    return f.select("stream_id", "frame_index", F.col("_g.c").alias("candidate"), "pcm",
                    F.transform("pcm", lambda x: F.rint(x * F.col("_g.q")) / F.col("_g.q")).alias("dec"))


def pitch_frames(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    pitch = F.when(F.col("event_type") == "signup", F.lit(0.0)).otherwise(
        F.lit(62.5) * F.pow(F.lit(2.0), (F.col("value") % F.lit(60.0)) / F.lit(20.0)))
    return t.select(
        F.col("stream_id").alias("item"), "frame_index", "event_id", pitch.alias("pitch"),
        F.col("event_type").isin("click", "view", "purchase").cast("int").alias("voicing"),
        F.when(F.col("stream_id") % 2 == 0, "female").otherwise("male").alias("gender"),
        F.col("value").alias("rms"),
        (pitch * F.pow(F.lit(2.0), ((F.col("event_id") % 13) - 6).cast("double") / F.lit(120.0))).alias("estimate"),
        _ratio(53, 991).alias("confidence"))


def clips(spark: SparkSession, sf: str) -> DataFrame:
    docs, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return (docs.select("doc_id", "lang", "source", "n_chars").join(lab.select("doc_id", "quality"), "doc_id", "left")
            .select("lang", F.col("source").alias("client"), F.col("doc_id").alias("path"),
                    F.when(F.col("quality") == 1, "female").when(F.col("quality") == 0, "male").alias("gender"),
                    F.col("n_chars").alias("length")))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("item"), (F.col("l_linenumber") * 3000).alias("bitrate"),
                      F.col("l_returnflag").alias("condition")).agg(
        (F.sum(F.rint(F.col("l_extendedprice") * 100)) / F.lit(100.0) / F.count(F.lit(1))).alias("score"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("run"), F.col("s_acctbal").alias("eval_loss"),
        ((k * 37) % 101).cast("double").alias("pesq_mean"), ((k * 53) % 97).cast("double").alias("warpq_mean"),
        ((k * 17) % 89).cast("double").alias("pitch_error_mean"), ((k * 29) % 83).cast("double").alias("voicing_error_mean"))


SQL = {
    "tel": """tel AS (SELECT user_id AS stream_id, event_id, ts, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  960 AS input_samples, 960 AS encoded_samples, cast(floor(value*4) as bigint) + 3 AS packet_bytes,
  96000::bigint AS requested_bitrate_bps, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS analysis_valid,
  (event_id*37 % 1000)::double/1000 AS tonality, (event_id*61 % 997)::double/997 AS activity,
  (event_id*17 % 101)::double/101 AS activity_probability, (event_id*71 % 103)::double/103 AS music_prob,
  (event_id % 21)::int AS bandwidth, (event_id*29 % 1000)::double/2000 - 0.25e0 AS tonality_slope,
  (event_id*53 % 991)::double/991 AS noisiness, (event_id*43 % 907)::double/907 AS max_pitch_ratio FROM events)""",
    "pk": """pk AS (SELECT stream_id, frame_index, event_id, (event_id*61 % 256)::int AS toc, (event_id*7 % 256)::int AS b1,
  packet_bytes AS len, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS lost,
  CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS has_lbrr, event_id*2654435761 % 4294967296 AS "check" FROM tel)""",
    "pcm": """pcm AS (SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
  list_transform(embedding::double[], lambda x: x * ((vec_id*37 % 100 + 1)::double/50e0)) AS pcm FROM embeddings)""",
    "smp": "smp AS (SELECT stream_id, frame_index, i - 1 AS n, pcm[i] AS x FROM pcm, range(1, 65) t(i))",
    "cand": "cand AS (SELECT * FROM (VALUES ('q08', 8e0), ('q16', 16e0), ('q32', 32e0), ('q64', 64e0)) v(candidate, q))",
    "dsmp": """dsmp AS (SELECT stream_id, frame_index, candidate, n, x, round_even(x*q, 0)::double/q AS y FROM smp, cand)""",
    "dft": """dft AS (SELECT stream_id, frame_index, k,
  sum(x*(0.5e0-0.5e0*cos(2*pi()*n/63))*cos(2*pi()*k*n/64)) AS re,
  -sum(x*(0.5e0-0.5e0*cos(2*pi()*n/63))*sin(2*pi()*k*n/64)) AS im
  FROM smp, range(0, 33) t(k) GROUP BY ALL)""",
    "mag": "mag AS (SELECT stream_id, frame_index, k, sqrt(re*re+im*im) AS m, atan2(im, re) AS ph FROM dft)",
    "ddft": """ddft AS (SELECT stream_id, frame_index, candidate, k,
  sqrt(pow(sum(x*w*c),2)+pow(sum(x*w*s),2)) AS m, sqrt(pow(sum(y*w*c),2)+pow(sum(y*w*s),2)) AS dm
  FROM (SELECT *, 0.5e0-0.5e0*cos(2*pi()*n/63) AS w, cos(2*pi()*k*n/64) AS c, sin(2*pi()*k*n/64) AS s
        FROM dsmp, range(0, 33) t(k)) GROUP BY ALL)""",
    "f0": """f0 AS (SELECT stream_id AS item, frame_index, event_id,
  CASE WHEN event_type='signup' THEN 0e0 ELSE 62.5e0*pow(2e0, (value % 60e0)/20e0) END AS pitch,
  CASE WHEN event_type IN ('click','view','purchase') THEN 1 ELSE 0 END AS voicing,
  CASE WHEN stream_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender, value AS rms,
  CASE WHEN event_type='signup' THEN 0e0 ELSE 62.5e0*pow(2e0, (value % 60e0)/20e0) END * pow(2e0, ((event_id % 13) - 6)::double/120e0) AS estimate,
  (event_id*53 % 991)::double/991 AS confidence FROM tel)""",
    "clips": """clips AS (SELECT lang, source AS client, d.doc_id AS path,
  CASE WHEN quality=1 THEN 'female' WHEN quality=0 THEN 'male' END AS gender, n_chars AS length
  FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)""",
    "scores": """scores AS (SELECT l_partkey AS item, l_linenumber*3000 AS bitrate, l_returnflag AS condition,
  sum(round_even(l_extendedprice*100, 0)::double)/100e0/count(*) AS score FROM lineitem GROUP BY ALL)""",
    "runs": """runs AS (SELECT s_suppkey AS run, s_acctbal AS eval_loss, ((s_suppkey*37)%101)::double AS pesq_mean,
  ((s_suppkey*53)%97)::double AS warpq_mean, ((s_suppkey*17)%89)::double AS pitch_error_mean,
  ((s_suppkey*29)%83)::double AS voicing_error_mean FROM supplier)""",
}
NEEDS = {"pk": ["tel"], "f0": ["tel"], "smp": ["pcm"], "dsmp": ["smp", "cand"], "dft": ["smp"], "mag": ["dft"],
         "ddft": ["dsmp"]}


def with_views(names, body: str, *extra: str) -> str:
    """SQL with the named views (and what they need) in front, then `extra` CTEs."""
    order: list[str] = []

    def need(n):
        for m in NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    recursive = "RECURSIVE " if any("UNION ALL" in e and "/*rec*/" in e for e in extra) else ""
    ctes = [SQL[n] for n in order] + list(extra)
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body
