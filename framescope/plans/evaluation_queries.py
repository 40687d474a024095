"""Queries for evaluation tables, pitch accuracy, runs and conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from framescope.functions import registry as R
from framescope.functions import scalar as S
from framescope.operators import evaluation as E
from framescope.plans import views as V
from framescope.plans.registry import query, r6, s6
from framescope.plans.views import with_views

CONDS = ["A", "N", "R"]


@query("a23_score_table", with_views("scores", "SELECT bitrate, " + ", ".join(
    f"{s6(f'avg(score) FILTER (WHERE condition={c!r})', c + '_mean')}, {s6(f'stddev_pop(score) FILTER (WHERE condition={c!r})', c + '_std')}" for c in CONDS) + " FROM scores GROUP BY 1"))
def a23(spark, sf):
    t = E.score_table(V.scores(spark, sf), CONDS)
    return t.select("bitrate", *[r6(c, c) for c in t.columns[1:]])


@query("a24_difference_table", with_views("scores", "SELECT bitrate, " + ", ".join(
    f"{s6(f'avg({c}-A)', c + '_mean')}, {s6(f'stddev_pop({c}-A)', c + '_std')}" for c in ("N", "R")) + """ FROM (SELECT bitrate, item, any_value(score) FILTER (WHERE condition='A') AS A,
 any_value(score) FILTER (WHERE condition='N') AS N, any_value(score) FILTER (WHERE condition='R') AS R FROM scores GROUP BY ALL) GROUP BY 1"""))
def a24(spark, sf):
    t = E.difference_table(V.scores(spark, sf), "A", ["N", "R"])
    return t.select("bitrate", *[r6(c, c) for c in t.columns[1:]])


@query("a25_box_summary", with_views("scores", f"""SELECT bitrate, condition, {s6('q1', 'q1')}, {s6('median', 'median')}, {s6('q3', 'q3')}, {s6('min(score) FILTER (WHERE score>=q1-1.5e0*(q3-q1))', 'whisker_low')}, {s6('max(score) FILTER (WHERE score<=q3+1.5e0*(q3-q1))', 'whisker_high')}
 FROM scores JOIN (SELECT bitrate, condition, quantile_cont(score,0.25) AS q1, quantile_cont(score,0.5) AS median, quantile_cont(score,0.75) AS q3 FROM scores GROUP BY ALL) USING (bitrate, condition) GROUP BY bitrate, condition, q1, median, q3"""))
def a25(spark, sf):
    b = E.box_summary(V.scores(spark, sf))
    return b.select("bitrate", "condition", *[r6(c, c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


LANG = """lr AS (SELECT lang, doc_id AS clip, 1+(doc_id*37%100)/100e0 AS reference_score, (1+(doc_id*37%100)/100e0)*(0.95e0+(doc_id*53%97)/800e0) AS test_score FROM documents),
lv0 AS (SELECT *, (sqrt(reference_score)-sqrt(test_score))/sqrt(reference_score) AS r FROM lr),
lv AS (SELECT lang, avg(r) AS mean_difference, min(r) AS worst_difference, min_by(clip, (r, clip)) AS worst_clip, NOT (min(r) < -0.1e0 OR avg(r) < -0.025e0) AS passed FROM lv0 GROUP BY 1)"""


def language_results(spark, sf):
    i = F.col("doc_id")
    ref = S.d(1) + (i * 37 % 100) / S.d(100)
    return V.table(spark, sf, "documents").select("lang", i.alias("clip"), ref.alias("reference_score"),
                                                  (ref * (S.d(0.95) + (i * 53 % 97) / S.d(800))).alias("test_score"))


@query("a26_language_verdict", with_views("", f"SELECT lang, passed, {s6('mean_difference', 'mean_difference')}, {s6('worst_difference', 'worst_difference')} FROM lv", LANG))
def a26(spark, sf):
    v = E.language_verdict(language_results(spark, sf))
    return v.select("lang", "passed", r6("mean_difference", "mean_difference"), r6("worst_difference", "worst_difference"))


@query("t06_overall_worst", with_views("", "SELECT min_by(lang, (mean_difference, lang)) AS worst_language, count(*) FILTER (WHERE passed) AS passed, count(*) AS languages FROM lv", LANG))
def t06(spark, sf):
    return E.overall_worst(E.language_verdict(language_results(spark, sf))).select("worst_language", "passed", "languages")


def pitch_pairs(spark, sf):
    f = V.pitch_frames(spark, sf)
    test = f.where(F.col("estimate") > 0).select("item", "frame_index", F.col("estimate").alias("test_pitch"),
                                                    ((F.col("event_id") % 7 != 0).cast("int") * F.col("voicing")).alias("test_voicing"))
    return f.join(test, ["item", "frame_index"])


PP = "pp AS (SELECT *, estimate AS test_pitch, CASE WHEN event_id%7<>0 THEN voicing ELSE 0 END AS test_voicing FROM f0 WHERE estimate>0)"


@query("j07_pitch_pairs", with_views("f0", f"SELECT item, frame_index, {s6('pitch', 'pitch')}, {s6('test_pitch', 'test_pitch')} FROM pp", PP))
def j07(spark, sf):
    return pitch_pairs(spark, sf).select("item", "frame_index", r6("pitch", "pitch"), r6("test_pitch", "test_pitch"))


@query("a27_pitch_error", with_views("f0", f"SELECT item, {s6('avg(abs(pitch-test_pitch))', 'pitch_error')}, {s6('avg((voicing<>test_voicing)::int)', 'voicing_error')} FROM pp GROUP BY 1", PP))
def a27(spark, sf):
    return E.pitch_errors(pitch_pairs(spark, sf)).select("item", r6("pitch_error", "pitch_error"), r6("voicing_error", "voicing_error"))


@query("h04_metric_registry", with_views("f0", f"SELECT item, 'pitch_error' AS metric, -1 AS direction, {s6('avg(abs(pitch-test_pitch))', 'score')} FROM pp GROUP BY 1 UNION ALL SELECT item, 'voicing_error', -1, {s6('avg((voicing<>test_voicing)::int)', 'score')} FROM pp GROUP BY 1", PP))
def h04(spark, sf):
    pairs, out = pitch_pairs(spark, sf), None
    for name, a, b in (("pitch_error", "pitch", "test_pitch"), ("voicing_error", "voicing", "test_voicing")):
        direction, column = R.METRICS[name]
        part = pairs.groupBy("item").agg(r6(F.avg(column(a, b)), "score")).select(
            "item", F.lit(name).alias("metric"), F.lit(direction).alias("direction"), "score")
        out = part if out is None else out.unionByName(part)
    return out


CENTS = """ct AS (SELECT *, round_even(1200*log2(pitch*1.0017e0/62.5e0+1e-8),0) AS cents, 1200*log2(estimate/62.5e0+1e-8) AS model_cents, voicing=1 AND pitch BETWEEN 65 AND 500 AND (gender<>'female' OR pitch>=125) AS voiced FROM f0)"""


def cents_frames(spark, sf):
    p = F.col("pitch")
    return V.pitch_frames(spark, sf).withColumn("cents", S.pitch_cents(p * S.d(1.0017))).withColumn(
        "model_cents", S.d(1200) * F.log2(F.col("estimate") / S.d(62.5) + S.d(1e-8))).withColumn(
        "voiced", (F.col("voicing") == 1) & p.between(65, 500) & ((F.col("gender") != "female") | (p >= 125)))


@query("a28_raw_pitch_accuracy", with_views("f0", f"SELECT gender, {s6('count(*) FILTER (WHERE voiced AND abs(cents-model_cents)<50)/count(*) FILTER (WHERE voiced)', 'accuracy')}, count(*) FILTER (WHERE voiced) AS voiced_frames FROM ct GROUP BY ROLLUP (gender)", CENTS))
def a28(spark, sf):
    return E.raw_pitch_accuracy(cents_frames(spark, sf)).select("gender", r6("accuracy", "accuracy"), "voiced_frames")


@query("a29_accuracy_by_level", with_views("f0", f"SELECT event_id%3 AS model, CASE WHEN event_id%5=0 THEN NULL ELSE (event_id%5)*5 END AS snr, {s6('avg((abs(cents-model_cents)<50)::int)', 'accuracy')}, event_id%5=0 AS clean FROM ct GROUP BY ALL", CENTS))
def a29(spark, sf):
    f = cents_frames(spark, sf).withColumn("model", F.col("event_id") % 3).withColumn(
        "snr", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 5 * 5))
    return E.accuracy_by_level(f).select("model", "snr", r6("accuracy", "accuracy"), "clean")


@query("a30_confidence_accuracy", with_views("f0", f"SELECT item, {s6('1-avg(confidence*(event_id%11=0)::int)', 'accuracy')} FROM f0 GROUP BY 1"))
def a30(spark, sf):
    f = V.pitch_frames(spark, sf).withColumn("label", F.col("frame_index")).withColumn(
        "predicted", F.col("frame_index") + (F.col("event_id") % 11 == 0).cast("int"))
    return E.confidence_weighted_accuracy(f).select("item", r6("accuracy", "accuracy"))


@query("j08_offset_sweep", with_views("f0", """SELECT item, max(c)::bigint AS matches FROM (SELECT a.item, s, count(*) FILTER (WHERE a.voicing<>0 AND abs(a.pitch-b.estimate)<25) AS c FROM
 (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM f0) a, range(-10,10) t(s) JOIN f0 b ON b.item=a.item AND b.frame_index=((a.frame_index-s)%a.n+a.n)%a.n GROUP BY ALL) GROUP BY 1"""))
def j08(spark, sf):
    f = V.pitch_frames(spark, sf).select("item", "frame_index", "voicing", F.col("pitch").alias("reference"), "estimate")
    return E.best_shift_matches(f)


CELL = "cell AS (SELECT item*1000 + bitrate//300 + (CASE condition WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS item, score FROM scores)"


def cells(spark, sf):
    """Every item, rate and condition as one scored item of its own."""
    c = F.col("condition")
    code = F.when(c == "A", 0).when(c == "N", 1).otherwise(2)
    return V.scores(spark, sf).select((F.col("item") * 1000 + F.floor(F.col("bitrate") / S.d(300)) + code).alias("item"), "score")


@query("a32_extremes_mean", with_views("scores", f"""SELECT {s6('avg(score)', 'mean')}, {s6('sum(score) FILTER (WHERE lo<=20)/20', 'bottom_mean')}, {s6('sum(score) FILTER (WHERE hi<=20)/20', 'top_mean')} FROM
 (SELECT score, row_number() OVER (ORDER BY score, item) AS lo, row_number() OVER (ORDER BY score DESC, item DESC) AS hi FROM cell)""", CELL))
def a32(spark, sf):
    s = cells(spark, sf)
    return E.extremes_mean(s, 1, "item").select(*[r6(c, c) for c in ("mean", "bottom_mean", "top_mean")])


@query("t03_listing", with_views("scores", """SELECT item, pos AS position, part FROM (SELECT item, row_number() OVER (ORDER BY score, item)-1 AS pos, count(*) OVER () AS n FROM cell), LATERAL (
 SELECT unnest(['bottom','top','middle']) AS part) WHERE (part='bottom' AND pos<20) OR (part='top' AND pos>=n-20) OR (part='middle' AND pos>n//2-10 AND pos<=n//2+10)""", CELL))
def t03(spark, sf):
    return E.listing(cells(spark, sf), "item").select("item", "position", "part")


@query("f08_complete_results", with_views("scores", "SELECT item FROM scores WHERE condition IN ('A','N','R') GROUP BY 1 HAVING count(DISTINCT condition)=3"))
def f08(spark, sf):
    return E.complete_results(V.scores(spark, sf).withColumnRenamed("condition", "metric"), CONDS)


@query("j15_failed_items", "SELECT p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber=1)")
def j15(spark, sf):
    asked = V.table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    done = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("item"))
    return E.failed_items(asked, done)


VEC = """vq AS (SELECT user_id AS vector, CASE WHEN event_id%2=0 THEN 'dec' ELSE 'm.dec' END AS reference, avg(value) - 49 AS quality FROM events GROUP BY ALL)"""


def vectors(spark, sf):
    ref = F.when(F.col("event_id") % 2 == 0, "dec").otherwise("m.dec")
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("vector"), ref.alias("reference")).agg((F.avg("value") - 49).alias("quality"))


@query("j16_either_reference", with_views("", f"SELECT vector, bool_or(quality>=0) AS passed, {s6('max(quality)', 'best_quality')} FROM vq GROUP BY 1", VEC))
def j16(spark, sf):
    return E.best_of_references(vectors(spark, sf)).select("vector", "passed", r6("best_quality", "best_quality"))


@query("a33_average_quality", with_views("", f"SELECT channels, {s6('max(m)', 'average_quality')} FROM (SELECT vector//12 AS channels, reference, CASE WHEN count(*)=12 THEN avg(quality) ELSE 0 END AS m FROM vq GROUP BY ALL) GROUP BY 1", VEC))
def a33(spark, sf):
    v = vectors(spark, sf).withColumn("channels", F.floor(F.col("vector") / S.d(12)))
    return E.average_quality(v).select("channels", r6("average_quality", "average_quality"))


@query("j17_condition_names", """SELECT regexp_extract(name,'^(.*)_([0-9]+)_([^_]+)$',1) AS item, regexp_extract(name,'^(.*)_([0-9]+)_([^_]+)$',2)::int AS bitrate,
 count(*) FILTER (WHERE regexp_extract(name,'_([^_]+)$',1)='N') AS n, count(*) FILTER (WHERE regexp_extract(name,'_([^_]+)$',1)='R') AS r FROM (SELECT DISTINCT 'clip_'||l_partkey||'_'||l_linenumber*3000||'_'||l_returnflag AS name FROM lineitem) GROUP BY ALL""")
def j17(spark, sf):
    li = V.table(spark, sf, "lineitem")
    names = li.select(F.concat(F.lit("clip_"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber") * 3000, F.lit("_"), "l_returnflag").alias("name")).distinct()
    return conditions_of(names).groupBy("item", "bitrate").agg(
        F.count_if(F.col("condition") == "N").alias("n"), F.count_if(F.col("condition") == "R").alias("r"))


def conditions_of(names):
    p = r"^(.*)_([0-9]+)_([^_]+)$"
    return names.select("name", F.regexp_extract("name", p, 1).alias("item"), F.regexp_extract("name", p, 2).cast("int").alias("bitrate"),
                        F.regexp_extract("name", p, 3).alias("condition"))


_Z = ["eval_loss", "pesq_mean", "warpq_mean", "pitch_error_mean", "voicing_error_mean"]
ZSQL = "zr AS (SELECT run, " + ", ".join(f"{'' if m == 'pesq_mean' else '-'}(({m}-avg({m}) OVER ())/stddev_pop({m}) OVER ()) AS z_{m}" for m in _Z) + " FROM runs)"


@query("a34_mixed_score", with_views("runs", f"SELECT run, {s6('(' + '+'.join('z_' + m for m in _Z) + ')/5', 'mix')} FROM zr", ZSQL))
def a34(spark, sf):
    return E.normalised_runs(V.runs(spark, sf)).select("run", r6("mix", "mix"))


@query("a34_covariance", with_views("runs", " UNION ALL ".join(f"SELECT 'z_{a}' AS a, 'z_{b}' AS b, {s6(f'covar_samp(z_{a}, z_{b})', 'covariance')} FROM zr" for a in _Z for b in _Z), ZSQL))
def a34b(spark, sf):
    c = E.covariance(E.normalised_runs(V.runs(spark, sf)), [f"z_{m}" for m in _Z])
    return c.select("a", "b", r6("covariance", "covariance"))


@query("w31_run_ranks", with_views("runs", " UNION ALL ".join(f"SELECT run, '{m}' AS metric, row_number() OVER (ORDER BY {'-' if m == 'pesq_mean' else ''}{m}, run) AS rank FROM runs" for m in _Z)))
def w31(spark, sf):
    return E.run_ranks(V.runs(spark, sf), {"pesq_mean"}, _Z)


#: Metrics as fractions of integers (multiplier of the event id, denominator), so that a mean's last digit never depends on the order of adding.
_FRACTIONS = {"validation_loss": (37, 1000), "pesq": (61, 997), "warpq": (53, 991), "pitch_error": (71, 103), "voicing_error": (1, 21)}


def _unit(metric):
    return 1 if metric == "voicing_error" else _FRACTIONS[metric][1]


def _mean_sql(metric):
    k, m = _FRACTIONS[metric]
    den = f"({_unit(metric)} * count(*))"
    return f"((2000000 * sum(event_id*{k} % {m}) + {den})::bigint // (2 * {den})) / 1e6 AS {metric}"


def _mean(metric):
    k, m = _FRACTIONS[metric]
    den = F.count(F.lit(1)) * _unit(metric)
    return F.floor((F.sum(F.col("event_id") * k % m) * 2000000 + den) / (den * 2)).cast("double") / F.lit(1e6)


@query("a39_run_record", with_views("tel", f"""SELECT stream_id AS run, {s6('max_by(value, frame_index)', 'last_score')}, {', '.join(map(_mean_sql, _FRACTIONS))} FROM tel GROUP BY 1"""))
def a39(spark, sf):
    t = V.telemetry(spark, sf).withColumnRenamed("stream_id", "run")
    losses = t.groupBy("run").agg(_mean("validation_loss").alias("validation_loss"))
    log = t.select("run", F.col("frame_index").alias("line"), F.col("value").alias("score"))
    names = [m for m in _FRACTIONS if m != "validation_loss"]
    stats = t.groupBy("run").agg(*[_mean(m).alias(m) for m in names]).select(
        "run", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in names])).alias("p")).select("run", "p.*")
    out = E.run_record(losses, log, stats)
    return out.select("run", r6("last_score", "last_score"), *_FRACTIONS)


def conditions(scores):
    """The conditions that occur, in order: a handful of names."""
    return [r[0] for r in scores.select("condition").distinct().orderBy("condition").collect()]


@query("u02_conditions_long", with_views("scores", f"SELECT bitrate, item, condition, {s6('score', 'score')} FROM scores"))
def u02(spark, sf):
    scores = V.scores(spark, sf)
    names = conditions(scores)
    wide = scores.groupBy("bitrate", "item").pivot("condition", names).agg(F.first("score"))
    long = wide.unpivot(["bitrate", "item"], names, "condition", "score").where(F.col("score").isNotNull())
    return long.select("bitrate", "item", "condition", r6("score", "score"))


@query("u03_result_files", with_views("scores", f"SELECT 'score-'||condition AS metric, item, {s6('avg(score)', 'score')}, CASE WHEN r%2=0 THEN count(*) END AS n FROM (SELECT *, dense_rank() OVER (ORDER BY condition) AS r FROM scores) GROUP BY condition, r, item"))
def u03(spark, sf):
    """Every condition is a result file; each second one also has the column n."""
    s = V.scores(spark, sf)
    files = []
    for i, name in enumerate(conditions(s)):
        cols = [r6(F.avg("score"), "score"), *([F.count(F.lit(1)).alias("n")] if i % 2 else [])]
        files.append(s.where(F.col("condition") == name).groupBy("item").agg(*cols).withColumn("metric", F.lit(f"score-{name}")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)


@query("u05_merged_corpus", with_views("clips", "SELECT path, 'female' AS folder FROM clips WHERE gender='female' UNION ALL SELECT path, 'male' FROM clips WHERE gender='male'"))
def u05(spark, sf):
    c = V.clips(spark, sf)
    return (c.where("gender = 'female'").select("path").withColumn("folder", F.lit("female"))
            .unionByName(c.where("gender = 'male'").select("path").withColumn("folder", F.lit("male"))))
