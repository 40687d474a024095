"""Evaluation tables: items by rate and condition, languages, pitch, runs, conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import scalar as S
from framescope.operators import layout
from framescope.operators.quantiles import quantiles_of

RUN_METRICS = {"eval_loss": -1, "pesq_mean": 1, "warpq_mean": -1, "pitch_error_mean": -1, "voicing_error_mean": -1}


def score_table(scores: DataFrame, conditions: list[str]) -> DataFrame:
    """Mean and population deviation per bitrate, one pair of columns per condition."""
    return scores.groupBy("bitrate").pivot("condition", conditions).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def formatted_table(table: DataFrame, conditions: list[str]) -> DataFrame:
    return table.select("bitrate", *[F.format_string("%.3f (%.2f)", F.col(f"{c}_mean"), F.col(f"{c}_std")).alias(c) for c in conditions])


def difference_table(scores: DataFrame, base: str, conditions: list[str]) -> DataFrame:
    """Per bitrate, mean and deviation of the paired difference to the base condition."""
    wide = scores.groupBy("bitrate", "item").pivot("condition", [base, *conditions]).agg(F.first("score"))
    aggs = []
    for c in conditions:
        d = F.col(c) - F.col(base)
        aggs += [F.avg(d).alias(f"{c}_mean"), F.stddev_pop(d).alias(f"{c}_std")]
    return wide.groupBy("bitrate").agg(*aggs)


def box_summary(scores: DataFrame) -> DataFrame:
    """Quartiles and the outermost values within 1.5 quartile distances."""
    keys = ["bitrate", "condition"]
    s = F.col("score")
    q = quantiles_of(scores, {"q1": (s, 0.25), "median": (s, 0.5), "q3": (s, 0.75)}, keys)
    reach = S.d(1.5) * (F.col("q3") - F.col("q1"))
    # few, large groups: the quartiles are spread over the items' segments, not joined on the group alone
    return layout.attach(scores, q, keys, "item").groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(s >= F.col("q1") - reach, s)).alias("whisker_low"),
        F.max(F.when(s <= F.col("q3") + reach, s)).alias("whisker_high"))


def language_verdict(results: DataFrame, worst: float = -0.1, mean: float = -0.025) -> DataFrame:
    """Per language: relative difference of root scores, its mean and minimum, the worst clip, pass or fail."""
    rel = (F.sqrt("reference_score") - F.sqrt("test_score")) / F.sqrt("reference_score")
    out = results.withColumn("_r", rel).groupBy("lang").agg(
        F.avg("_r").alias("mean_difference"), F.min("_r").alias("worst_difference"),
        F.min(F.struct("_r", "clip"))["clip"].alias("worst_clip"))
    return out.withColumn("passed", ~((F.col("worst_difference") < S.d(worst)) | (F.col("mean_difference") < S.d(mean))))


def overall_worst(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.min(F.struct("mean_difference", "lang"))["lang"].alias("worst_language"),
                        F.min(F.struct("worst_difference", "worst_clip"))["worst_clip"].alias("worst_clip"),
                        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("languages"))


def pitch_errors(pairs: DataFrame, keys=("item",)) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg(F.abs(F.col("pitch") - F.col("test_pitch"))).alias("pitch_error"),
                                    F.avg((F.col("voicing") != F.col("test_voicing")).cast("double")).alias("voicing_error"))


def raw_pitch_accuracy(frames: DataFrame, limit: float = 50.0) -> DataFrame:
    """Share of voiced frames within `limit` cents, overall and per gender."""
    hit = F.col("voiced") & (F.abs(F.col("cents") - F.col("model_cents")) < S.d(limit))
    return frames.rollup("gender").agg((F.count_if(hit) / F.count_if("voiced")).alias("accuracy"),
                                       F.count_if("voiced").alias("voiced_frames"))


def best_shift_matches(frames: DataFrame, limit: float = 25.0, lo: int = -10, hi: int = 9, keys=("item",)) -> DataFrame:
    """Per item the most matches over circular shifts lo..hi of the estimate.  Shifting by i compares
    frame f with f-i; rows near the ends are also placed where they wrap to."""
    keys = list(keys)
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    f = layout.attach(frames, sizes, keys).withColumn("_own", F.lit(True))
    i, n = F.col("frame_index"), F.col("_n")
    laps = F.sequence(F.ceil((S.d(-hi) - i) / n), F.floor((n - S.d(1) - S.d(lo) - i) / n))
    f = f.withColumn("_lap", F.explode(laps)).withColumn("_own", F.col("_lap") == 0).withColumn("frame_index", i + F.col("_lap") * n)
    f = layout.windowed(f, {"_est": lambda w: F.collect_list("estimate").over(w.rowsBetween(-hi, -lo))}, hi, -lo, keys)
    f = f.where("_own")
    counts = [F.count_if((F.col("voicing") != 0) & (F.abs(F.col("reference") - F.col("_est")[k]) < S.d(limit))).alias(f"_c{k}")
              for k in range(hi - lo + 1)]
    return f.groupBy(*keys).agg(*counts).select(*keys, F.greatest(*[F.col(f"_c{k}") for k in range(hi - lo + 1)]).alias("matches"))


def accuracy_by_level(frames: DataFrame) -> DataFrame:
    """Accuracy per model and noise level; the clean level (null) stands apart."""
    hit = (F.abs(F.col("cents") - F.col("model_cents")) < S.d(50)).cast("double")
    return frames.groupBy("model", "snr").agg(F.avg(hit).alias("accuracy")).withColumn("clean", F.col("snr").isNull())


def confidence_weighted_accuracy(frames: DataFrame, keys=("item",)) -> DataFrame:
    miss = F.col("confidence") * (F.col("predicted") != F.col("label")).cast("double")
    return frames.groupBy(*keys).agg((S.d(1) - F.avg(miss)).alias("accuracy"))


def extremes_mean(scores: DataFrame, direction: int, item: str, n: int = 20) -> DataFrame:
    """Mean of all, and of the n best and worst; the last two always divide by n."""
    key = S.d(direction) * F.col("score")

    def edge(best: bool, name: str):
        order = [key.desc() if best else key.asc(), F.col(item).desc() if best else F.col(item).asc()]
        top = scores.orderBy(*order).limit(n)
        return top.agg((F.sum("score") / S.d(n)).alias(name))

    return scores.agg(F.avg("score").alias("mean")).select(
        "mean", edge(False, "v").scalar().alias("bottom_mean"), edge(True, "v").scalar().alias("top_mean"))


def listing(scores: DataFrame, item: str, n: int = 20) -> DataFrame:
    """Rows of the top, middle and bottom n by ascending score."""
    r = layout.rank_all(scores, F.col("score"), F.col(item), "_rank")
    total = scores.agg(F.count(F.lit(1))).scalar()
    pos, half, mid = F.col("_rank") - 1, n // 2, F.floor(total / F.lit(2))
    part = F.array_compact(F.array(
        F.when(pos < n, "bottom"), F.when(pos >= total - n, "top"),
        F.when((pos > mid - half) & (pos <= mid + half), "middle")))
    return r.select(item, "score", pos.alias("position"), F.explode(part).alias("part"))


def complete_results(results: DataFrame, metrics: list[str], item: str = "item") -> DataFrame:
    """Items for which every requested metric is present."""
    return results.where(F.col("metric").isin(metrics)).groupBy(item).agg(
        F.count_distinct("metric").alias("_n")).where(F.col("_n") == len(metrics)).select(item)


def failed_items(requested: DataFrame, scored: DataFrame, item: str = "item") -> DataFrame:
    return requested.join(scored, item, "left_anti")


def best_of_references(results: DataFrame) -> DataFrame:
    """A decode passes if it matches any of its references."""
    return results.groupBy("vector").agg(F.bool_or(F.col("quality") >= 0).alias("passed"), F.max("quality").alias("best_quality"))


def average_quality(results: DataFrame, vectors: int = 12) -> DataFrame:
    """Mean per reference set, 0 unless all vectors are there; the better set counts."""
    per_set = results.groupBy("channels", "reference").agg(
        F.when(F.count(F.lit(1)) == vectors, F.avg("quality")).otherwise(S.d(0)).alias("mean"))
    return per_set.groupBy("channels").agg(F.max("mean").alias("average_quality"))


def normalised_runs(runs: DataFrame, metrics=RUN_METRICS) -> DataFrame:
    """Signed z-scores of every metric and their mean, `mix`."""
    stats = runs.agg(F.struct(*[F.avg(m).alias(f"{m}_mu") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_sd") for m in metrics])).scalar()
    r = runs.withColumn("_s", stats)
    zs = {m: S.d(sign) * (F.col(m) - F.col(f"_s.{m}_mu")) / F.col(f"_s.{m}_sd") for m, sign in metrics.items()}
    r = r.select(*runs.columns, *[z.alias(f"z_{m}") for m, z in zs.items()])
    return r.withColumn("mix", sum(F.col(f"z_{m}") for m in metrics) / S.d(len(metrics)))


def covariance(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of every pair, as rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = runs.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("covariance")) for a, b in pairs]).alias("m"))
    return one.select(F.explode("m").alias("p")).select("p.*")


def run_ranks(runs: DataFrame, higher_is_better: set[str], metrics: list[str], run: str = "run") -> DataFrame:
    """Rank of every run in every metric; ties by run id."""
    long = runs.select(run, F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), (F.col(m) * S.d(-1 if m in higher_is_better else 1)).alias("key")) for m in metrics])).alias("p"))
    long = long.select(run, "p.metric", "p.key")
    return layout.rank_all(long, F.col("key"), F.col(run), "rank", ("metric",)).select(run, "metric", "rank")


def run_record(losses: DataFrame, log: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per run: validation loss, the last logged score, the mean of each metric."""
    last = log.groupBy("run").agg(F.max_by("score", "line").alias("last_score"))
    means = stats.groupBy("run").pivot("metric", ["pesq", "warpq", "pitch_error", "voicing_error"]).agg(F.first("mean"))
    return losses.join(last, "run").join(means, "run")


def embedding_distance(reference: DataFrame, degraded: DataFrame, key: str = "item") -> DataFrame:
    return reference.join(degraded, key).select(key, A.distance("reference", "degraded").alias("distance"))
