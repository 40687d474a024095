"""Two-stage search: work grid, stage results, gate, promotion, stored results."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.functions import scalar as S

MEANS = ["avg_kbps", "snr_delta", "lsd_delta", "perceptual_spectral_delta", "stereo_image_delta", "flux_mse_delta",
         "overall_mean_delta", "attack_mean_delta", "calm_mean_delta", "score", "env_corr"]
COUNTS = ["frames_better_than_baseline", "frames_worse_than_baseline"]


def work_grid(songs: DataFrame, candidates: list[str]) -> DataFrame:
    """Every song with every candidate; the candidate list is part of the plan, not a table."""
    return songs.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates])))


def only_listed(songs: DataFrame, manifest: DataFrame, key: str = "song") -> DataFrame:
    return songs.join(manifest.select(key), key, "left_semi")


def stage_summary(metrics: DataFrame) -> DataFrame:
    """Per candidate: means and sums; the gate wants a negative mean score and no song at .02 or above."""
    return metrics.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("songs"), *[F.avg(c).alias(c) for c in MEANS], *[F.sum(c).alias(c) for c in COUNTS],
        ((F.avg("score") < S.d(0)) & (F.max("score") < S.d(0.02))).alias("passed_gate_all_songs"))


def ranked(summary: DataFrame, n: int = 3) -> DataFrame:
    """The n lowest scores."""
    top = summary.orderBy("score", "candidate").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("score", "candidate")))


def promoted(summary: DataFrame, n: int = 3) -> DataFrame:
    """Those that passed the gate first, then by score, cut to n."""
    order = [F.col("passed_gate_all_songs").desc(), F.col("score").asc(), F.col("candidate").asc()]
    return summary.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def full_stage(frames: DataFrame, winners: DataFrame) -> DataFrame:
    """Second stage reads only the promoted candidates."""
    return frames.join(F.broadcast(winners.select("candidate")), "candidate", "left_semi")


class StageStore:
    """Results of a search under one folder, in parts that count once they are committed.

    A run writes its rows into a part of its own; when that has finished, a commit file that names the part's data files is moved to
    `_commits`.  Readers take the files that commits name, so a part that failed, is being written or is written again by a stray
    task is not seen.  Where two runs computed the same key, the rows of the part that began first count, so none repeats.  Commits
    are files of different names: nothing is locked, and a rename onto a new name is all the file system has to offer."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def committed(self) -> dict[str, list[str]]:
        """Data files by part, oldest part first."""
        out = {}
        for name in self._names("_commits"):
            if name.startswith("part-"):
                stream = self._fs.open(self._at(f"_commits/{name}"))
                try:
                    out[name] = bytes(stream.readAllBytes()).decode().split()
                finally:
                    stream.close()
        return out

    def append(self, rows: DataFrame) -> str:
        """Writes `rows` as a new part and commits it."""
        part = f"part-{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        files = [n for n in self._names(part) if n.endswith(".parquet")]
        draft = self._at(f"_commits/.{part}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray("\n".join(files).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._at(f"_commits/{part}")):
            raise OSError(f"no commit of {part}")
        return part

    def rows(self) -> DataFrame | None:
        """All committed rows, each key from one part; None if there are none."""
        parts = [(part, files) for part, files in self.committed().items() if files]
        if not parts:
            return None
        paths = [f"{self.path}/{part}/{f}" for part, files in parts for f in files]
        everything = self.spark.read.parquet(*paths)
        if len(parts) == 1:
            return everything
        named = everything.withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), "/(part-[0-9]+-[0-9a-f]+)/[^/]*$", 1))
        owner = named.groupBy(*self.keys).agg(F.min("_part").alias("_part"))
        return named.join(owner, [*self.keys, "_part"]).select(*everything.columns)


def with_stored(spark: SparkSession, path: str, work: DataFrame, keys: list[str], compute) -> DataFrame:
    """All stored rows, after computing and committing those that `work` asks for and no commit holds.  An empty or missing folder
    counts as nothing stored; keys are not null."""
    store = StageStore(spark, path, keys)
    done = store.rows()
    if done is not None:
        work = work.join(done.select(*keys), keys, "left_anti")
    store.append(compute(work))
    return store.rows()
