"""Sinks with fixed columns, order and decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_DECIMALS = {"start_s": 3, "end_s": 3, "avg_packet_bytes": 3, "packet_stddev": 3, "mean_activity": 6, "mean_tonality": 6,
                    "mean_music_prob": 6, "mean_bandwidth": 3, "raw_difficulty": 6, "smoothed_difficulty": 6, "budget_scale": 6}
SEGMENT_ORDER = ["segment_index", "start_s", "end_s", "frames", "avg_packet_bytes", "packet_stddev", "mean_activity",
                 "mean_tonality", "mean_music_prob", "mean_bandwidth", "raw_difficulty", "smoothed_difficulty", "budget_scale",
                 "segment_class"]


def write_segments(segments: DataFrame, path: str) -> None:
    cols = [F.format_string(f"%.{SEGMENT_DECIMALS[c]}f", F.col(c)).alias(c) if c in SEGMENT_DECIMALS else F.col(c) for c in SEGMENT_ORDER]
    segments.select("stream_id", *cols).write.mode("overwrite").csv(path, header=True)


def write_plan(plan: DataFrame, path: str) -> None:
    """Bitrate rounded half to even, scale with six digits."""
    plan.select("stream_id", "frame_index", F.rint("target_bitrate_bps").cast("long").alias("target_bitrate_bps"),
                F.format_string("%.6f", F.col("scale").cast("double")).alias("scale")).write.mode("overwrite").csv(path, header=True)


def write_report(songs: DataFrame, summary: DataFrame, promoted: DataFrame, path: str) -> None:
    """Song rows and stage summary as JSON lines, and the small parts as one document.
    Song rows stay distributed; only one row per candidate goes into the document."""
    songs.write.mode("overwrite").json(f"{path}/song-results")
    summary.write.mode("overwrite").json(f"{path}/summary")
    doc = summary.agg(F.sort_array(F.collect_list(F.struct("score", F.to_json(F.struct("*")).alias("row")))).alias("s"))
    names = promoted.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("n"))
    doc.select(F.to_json(F.struct(names.select("n").scalar().alias("promoted_candidates"),
                                  F.transform("s", lambda x: x["row"]).alias("summary"))).alias("value")).write.mode("overwrite").text(f"{path}/report")


def write_score_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def write_binary_files(files: DataFrame, base: str) -> None:
    """One file per row (columns name, content), written by the tasks themselves to the shared folder."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType())])

    def body(batches):
        import pandas as pd
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(base)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                target = f"{root}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    files.select("name", "content").mapInPandas(body, schema).write.format("noop").mode("overwrite").save()


def int16_bytes(samples):
    """Array of samples in [-1, 1) as little-endian 16-bit text of hex digits, for unhex."""
    def two(x):
        v = F.pmod(F.greatest(F.lit(-32768.0), F.least(F.floor(F.lit(0.5) + x * 32768).cast("double"), F.lit(32767.0))).cast("long"), F.lit(65536))
        h = F.lpad(F.hex(v), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.array_join(F.transform(samples, two), "")
