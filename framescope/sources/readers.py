"""Readers: raw audio, WAV, logs, plans, traces, feature rows, catalogues, score texts.

Every reader returns a lazy DataFrame; schemas are fixed, never inferred.
"""

from __future__ import annotations

import re
import struct
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TELEMETRY_INTS = ["frame_index", "input_samples", "encoded_samples", "packet_bytes", "requested_bitrate_bps", "analysis_valid",
                  "analysis_bandwidth", "forced_channels", "in_dtx", "final_range"]
TELEMETRY_DOUBLES = ["analysis_tonality", "analysis_activity", "analysis_activity_probability", "analysis_music_prob",
                     "analysis_tonality_slope", "analysis_noisiness", "analysis_max_pitch_ratio"]
TELEMETRY_STRINGS = ["selected_bandwidth", "signal"]
BANDWIDTH_NAMES = ["NB", "MB", "WB", "SWB", "FB"]
MAX_PACKET = 1500
RANGE_BYTES = 8 << 20  # of a file that one task reads at a time
OPEN_BYTES = 64 << 10  # that could be read in the time it takes to open a file
MOST_TASKS = 20_000
LISTING_TASKS = 256  # that pass on the names of files
FEATURE_LAYOUTS = {
    2: {"width": 36, "cepstrum": (0, 18), "periods": (18, 19), "pitch_corr": (19, 20), "lpc": (20, 36)},
    1: {"width": 55, "cepstrum": (0, 18), "periods": (36, 37), "pitch_corr": (37, 38), "lpc": (39, 55)},
}
SAMPLES = {"s16": (2, 32768.0), "s24": (3, 8388608.0), "f32": (4, 1.0)}


def stem(path) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, content; what is not selected is not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path).select("path", "length", "content")


# ---------------------------------------------------------------- files in pieces
def _location(uri: str):
    """(file system, path in it) of a file that Spark has listed."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)


def _opens(files: DataFrame) -> bool:
    """Whether tasks can open these files themselves.  Schemes that only Spark knows are read through it, a file at a time."""
    first = files.select("path").first()
    try:
        return first is None or _location(first[0]) is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _spans(files: DataFrame, unit: int) -> DataFrame:
    """path, size, start, stop: byte ranges of about RANGE_BYTES, a whole number of `unit` each, dealt over the tasks.  `files` has path, first and
    size (where its data begin and how many bytes they are); start and stop count from first."""
    step = max(1, RANGE_BYTES // unit) * unit
    starts = F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    spans = files.select("path", "first", "size", starts.alias("start"))
    return _dealt(spans.withColumn("stop", F.least("size", F.col("start") + step)))


def _dealt(spans: DataFrame, tasks: int | None = None) -> DataFrame:
    """As many tasks as the ranges have RANGE_BYTES, the opening of their files counted, up to MOST_TASKS: a long file is read by many, and
    many short ones share a task.  Without a number the small rows would be put back into one."""
    return spans.repartition(_tasks(spans) if tasks is None else tasks, "path", "start")


def _tasks(spans: DataFrame) -> int:
    ranges, effort = spans.agg(F.count(F.lit(1)), F.sum(F.col("stop") - F.col("start") + OPEN_BYTES)).first()
    return min(max(-(-(effort or 0) // RANGE_BYTES), 1), max(ranges, 1), MOST_TASKS)


def _pieces(files: DataFrame, spans: DataFrame, more: int = 0) -> DataFrame:
    """`spans` with raw: their bytes and up to `more` after them (not beyond the data)."""
    length = F.least(F.col("size"), F.col("stop") + more) - F.col("start")
    if not _opens(files):
        held = files.select(F.col("path").alias("_path"), "content")
        cut = F.substring(F.col("content"), (F.col("first") + F.col("start") + 1).cast("int"), length.cast("int"))
        return spans.join(held, F.col("path") == F.col("_path")).withColumn("raw", cut).drop("_path", "content")
    asked = spans.withColumn("_length", length)
    names = spans.columns
    schema = T.StructType([*spans.schema.fields, T.StructField("raw", T.BinaryType())])

    def body(batches):
        for b in batches:
            for i in range(b.num_rows):
                store, where = _location(b.column("path")[i].as_py())
                with store.open_input_file(where) as f:
                    raw = f.read_at(b.column("_length")[i].as_py(), b.column("first")[i].as_py() + b.column("start")[i].as_py())
                yield pa.RecordBatch.from_arrays([*[b.column(n).slice(i, 1) for n in names], pa.array([raw], pa.binary())], [*names, "raw"])

    return asked.mapInArrow(body, schema)


def _whole(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit(0).cast("long").alias("first"), F.col("length").alias("size")).coalesce(LISTING_TASKS)


def _decode(raw: bytes, fmt: str) -> np.ndarray:
    width, full = SAMPLES[fmt]
    raw = raw[: len(raw) // width * width]
    if fmt == "s16":
        return np.frombuffer(raw, dtype="<i2").astype(np.float64) / full
    if fmt == "f32":
        return np.frombuffer(raw, dtype="<f4").astype(np.float64)
    b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v) / full


def _block_rows(pieces: DataFrame, fmt: str, channels: int, block: int) -> DataFrame:
    """path, block_index, pcm.  A few blocks per batch, so that a piece never becomes one big batch."""
    unit = SAMPLES[fmt][0] * channels * block

    def body(batches):
        for b in batches:
            for path, start, raw in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), b.column("raw"), strict=True):
                x = _decode(raw.as_py(), fmt)
                x = x[: len(x) // channels * channels].reshape(-1, channels)
                for i in range(0, len(x), 256 * block):
                    rows = [{"path": path, "block_index": start // unit + j // block, "pcm": x[j:j + block].T.tolist()} for j in range(i, min(len(x), i + 256 * block), block)]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("path", pa.string()), ("block_index", pa.int64()), ("pcm", pa.list_(pa.list_(pa.float64())))])
    return pieces.select("path", "start", "raw").mapInArrow(body, "path string, block_index long, pcm array<array<double>>")


def read_pcm(spark: SparkSession, path: str, fmt: str = "s16", channels: int = 2, block: int = 960) -> DataFrame:
    """Raw interleaved samples scaled to [-1, 1): stream_id, block_index, pcm[channel][sample].  A long file is read by many tasks."""
    files = _files(spark, path)
    spans = _spans(_whole(files), SAMPLES[fmt][0] * channels * block)
    rows = _block_rows(_pieces(files, spans), fmt, channels, block)
    return rows.select(stem(F.col("path")).alias("stream_id"), "block_index", "pcm")


def wav_data(size: int, read, channels: int, rate: int, bits: int):
    """((begin, bytes) of the samples, None) or (None, what is wrong with the file).  `read(at, n)` gives bytes of the file; only
    the heads of chunks are read."""
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None, "not a WAV file"
    pos, form = 12, None
    while pos + 8 <= size:
        name, length = struct.unpack("<4sI", read(pos, 8))
        if name == b"fmt " and length >= 16:
            form = struct.unpack("<HHIIHH", read(pos + 8, 16))
        if name == b"data":
            if form is None:
                return None, "no format chunk"
            if (form[1], form[2], form[5]) != (channels, rate, bits):
                return None, f"unexpected format: {form[1]} channels, {form[2]} Hz, {form[5]} bit"
            return (pos + 8, min(length, size - pos - 8)), None
        pos += 8 + length + (length & 1)
    return None, "no data chunk"


def read_wav(spark: SparkSession, path: str, channels: int = 2, rate: int = 48000, bits: int = 16, block: int = 960):
    """(blocks, rejects): files of another format go to the second table.  The samples of a long file are read by many tasks."""
    files = _files(spark, path, "*.wav")
    direct = _opens(files)

    def body(batches):
        for b in batches:
            rows = []
            for i, (uri, size) in enumerate(zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)):
                try:
                    if direct:
                        store, where = _location(uri)
                        with store.open_input_file(where) as f:
                            found, problem = wav_data(size, lambda at, n, f=f: f.read_at(n, at), channels, rate, bits)
                    else:
                        raw = b.column("content")[i].as_py()
                        found, problem = wav_data(size, lambda at, n, raw=raw: raw[at:at + n], channels, rate, bits)
                except struct.error:
                    found, problem = None, "a chunk is cut short"
                rows.append({"path": uri, "first": found[0] if found else None, "size": found[1] if found else None, "problem": problem})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("first", pa.int64()), ("size", pa.int64()), ("problem", pa.string())]))

    heads = files.select("path", "length", *([] if direct else ["content"])).mapInArrow(body, "path string, first long, size long, problem string")
    fmt = "s16" if bits == 16 else "s24"
    spans = _spans(heads.where(F.col("problem").isNull()), SAMPLES[fmt][0] * channels * block)
    rows = _block_rows(_pieces(files, spans), fmt, channels, block)
    good = rows.select(stem(F.col("path")).alias("stream_id"), "block_index", "pcm")
    return good, heads.where(F.col("problem").isNotNull()).select(stem(F.col("path")).alias("stream_id"), "problem")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Frame logs by column name in every file; blank or missing cells are 0; no rows at all is an error.

    Spark's reader takes one header for all files, so files are read per distinct header and united by name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start"))
    headers = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    parts = [spark.read.csv([unquote(f) for f in h["files"]], header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True) for h in headers]
    if not parts:
        raise ValueError(f"no telemetry rows in {path}")
    parts = [p.select("*", F.col("_metadata.file_path").alias("_file")) for p in parts]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if raw.limit(1).count() == 0:
        raise ValueError(f"no telemetry rows in {path}")

    def cell(name, kind):
        if name not in raw.columns:
            return F.lit(0).cast(kind).alias(name)
        return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")).cast(kind), F.lit(0).cast(kind)).alias(name)

    return raw.select(stem(F.col("_file")).alias("source_name"),
                      *[cell(c, "long") for c in TELEMETRY_INTS], *[cell(c, "double") for c in TELEMETRY_DOUBLES],
                      *[F.col(c) for c in TELEMETRY_STRINGS if c in raw.columns],
                      *[F.col(c) for c in raw.columns if c == "stream_id"])


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    schema = "stream_id string, frame_index long, target_bitrate_bps double, scale double"
    return spark.read.csv(path, header=True, schema=schema)


def _plan_lines(spark, path, pattern):
    lines = spark.read.text(path)
    i, v = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    return lines.select(stem(F.col("_metadata.file_path")).alias("source_name"), i.alias("i"), v.alias("v")).where(F.col("i") != "")


def read_bandwidth_plan(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not `integer,known name` are skipped."""
    rows = _plan_lines(spark, path, r"^\s*([+-]?\d+),([^,\r\n]{1,31})")
    return rows.where(F.upper("v").isin(BANDWIDTH_NAMES)).select(
        "source_name", F.col("i").cast("long").alias("frame_index"), F.upper("v").alias("bandwidth"))


def read_channels_plan(spark: SparkSession, path: str) -> DataFrame:
    rows = _plan_lines(spark, path, r"^\s*([+-]?\d+),\s*([+-]?\d+)")
    return rows.where(F.col("v").cast("int").isin(1, 2)).select(
        "source_name", F.col("i").cast("long").alias("frame_index"), F.col("v").cast("int").alias("channels"))


def packet_chains(raw: bytes, span: int, left: int, max_packet: int):
    """(entries, exits, counts) for a piece of a packet log: where a packet may begin within its first bytes, where the chain of packets from there leaves
    the piece's `span` bytes (or meets a bad length: minus that place, less 1), and how many packets that is.  Places whose own length is bad
    are left out.  `left`: bytes of the file from the piece's start on."""
    data = np.frombuffer(raw, np.uint8)

    def following(at):
        """Where the packet at each place ends; -1 where that is no packet."""
        at = np.asarray(at)
        inside = at + 8 <= left
        safe = np.where(inside, at, 0)
        size = sum(data[safe + k].astype(np.int64) << (24 - 8 * k) for k in range(4)) if len(data) >= 4 else np.full(len(at), 1 << 40)
        return np.where(inside & (size <= max_packet) & (at + 8 + size <= left), at + 8 + size, -1)

    first = np.arange(max(0, min(span, 8 + max_packet, left - 7)))
    now = following(first)
    entries, now = first[now >= 0], now[now >= 0]
    counts = np.ones(len(entries), np.int64)
    open_ = np.flatnonzero((now < span) & (now + 8 <= left))
    while len(open_):
        here = now[open_]
        there = following(here)
        now[open_] = np.where(there >= 0, there, -here - 1)
        counts[open_] += there >= 0
        open_ = open_[(there >= 0) & (there < span) & (there + 8 <= left)]
    return entries, now, counts


def read_packet_log(spark: SparkSession, path: str, max_packet: int = MAX_PACKET) -> DataFrame:
    """Length-prefixed packets; a file cut short, or with a length above `max_packet`, ends with a row whose payload is null.

    A long log is read by many tasks, though a packet's place follows from all before it: every piece finds the chains of
    lengths that may lead through it, one small row each; in order of the pieces those rows tell where the true chain enters
    each; then all pieces are cut."""
    files = _files(spark, path)
    more = 8 + max_packet
    spans = _spans(_whole(files), 1)
    tasks = _tasks(spans)
    pieces = _pieces(files, spans, more)

    def chains(batches):
        for b in batches:
            for i in range(b.num_rows):
                start, stop, size = (b.column(c)[i].as_py() for c in ("start", "stop", "size"))
                found = packet_chains(b.column("raw")[i].as_py(), stop - start, size - start, max_packet)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in ("path", "size", "start", "stop")], *[pa.array([x], pa.list_(pa.int64())) for x in found]],
                                                 ["path", "size", "start", "stop", "entries", "exits", "counts"])

    def entered(batches):
        current = at = seq = None
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                path_, size, start, stop = (b.column(c)[i].as_py() for c in ("path", "size", "start", "stop"))
                if path_ != current:
                    current, at, seq = path_, 0, 0
                if at is None or at >= stop or at + 8 > size:
                    continue
                rows.append({"path": path_, "start": start, "entry": at - start, "seq": seq})
                entries, exits, counts = (b.column(c)[i].values.to_numpy() for c in ("entries", "exits", "counts"))
                k = int(np.searchsorted(entries, at - start))
                if k == len(entries) or entries[k] != at - start or exits[k] < 0:
                    at = None  # the log ends in this piece
                else:
                    at, seq = start + int(exits[k]), seq + int(counts[k])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("entry", pa.int64()), ("seq", pa.int64())]))

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                path_, size, start, stop, at, seq = (b.column(c)[i].as_py() for c in ("path", "size", "start", "stop", "entry", "seq"))
                raw, left, rows = b.column("raw")[i].as_py(), size - start, []
                while at < stop - start and at + 8 <= left:
                    length, check = struct.unpack(">iI", raw[at:at + 8])
                    bad = length < 0 or length > max_packet or at + 8 + length > left
                    rows.append({"path": path_, "seq": seq, "check": None if bad else check, "payload": None if bad else raw[at + 8:at + 8 + length]})
                    if bad:
                        break
                    at, seq = at + 8 + length, seq + 1
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("check", pa.int64()), ("payload", pa.binary())])
    lists = "path string, size long, start long, stop long, entries array<long>, exits array<long>, counts array<long>"
    ways = pieces.select("path", "size", "start", "stop", "raw").mapInArrow(chains, lists).repartition("path").sortWithinPartitions("path", "start")
    ways = ways.mapInArrow(entered, "path string, start long, entry long, seq long")
    known = _pieces(files, _dealt(spans.join(ways, ["path", "start"]), tasks), more)
    rows = known.select("path", "size", "start", "stop", "entry", "seq", "raw").mapInArrow(cut, "path string, seq long, check long, payload binary")
    return rows.select(stem(F.col("path")).alias("stream_id"), "seq", "check", "payload")


def _numbered_lines(spark, path):
    """Lines with their position in their file.  Long files are read in blocks: a line's number is its place in the block plus the
    lines of the blocks before."""
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                                                             F.monotonically_increasing_id().alias("_id"), "value")
    blocks = t.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return t.join(blocks, ["_file", "_start"]).select(stem(F.col("_file")).alias("source_name"), (F.col("_ahead") + F.col("_id") - F.col("_first")).cast("int").alias("line"),
                                                      F.regexp_replace("value", r"\r$", "").alias("text"))


def read_loss_trace(spark: SparkSession, path: str) -> DataFrame:
    return _numbered_lines(spark, path).where(F.trim("text") != "").select(
        F.col("source_name").alias("trace_id"), F.col("line").cast("long").alias("seq"), F.trim("text").cast("int").alias("lost"))


def read_f0(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("text"), r"\s+")
    return _numbered_lines(spark, path).where(F.trim("text") != "").select(
        F.col("source_name").alias("item"), F.col("line").cast("long").alias("frame_index"),
        parts[0].cast("double").alias("pitch"), parts[1].cast("double").alias("voicing"))


def read_feature_matrix(spark: SparkSession, path: str, version: int = 2, width: int | None = None) -> DataFrame:
    """Rows of float32 features cut into their named parts; period = trunc(0.1 + 50x + 100).  Rows may hold more values than the
    layout names, `width` in all: those come as `rest`."""
    lay = FEATURE_LAYOUTS[version]
    named = lay["width"]
    width = width or named
    files = _files(spark, path)

    def body(batches):
        for b in batches:
            for i in range(b.num_rows):
                m = np.frombuffer(b.column("raw")[i].as_py(), dtype="<f4")
                m, first = m[: len(m) // width * width].reshape(-1, width), b.column("start")[i].as_py() // (4 * width)
                for j in range(0, len(m), 4096):
                    part = m[j:j + 4096]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b.column("path")[i].as_py()] * len(part)), pa.array(np.arange(first + j, first + j + len(part))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)), pa.array(part.ravel()))],
                        names=["path", "row", "f"])

    def cut(name):
        a, z = lay[name]
        return F.slice("f", a + 1, z - a)

    rows = _pieces(files, _spans(_whole(files), 4 * width)).select("path", "start", "raw").mapInArrow(body, "path string, row long, f array<float>")

    def f32(v):
        return F.lit(v).cast("float")

    period = (f32(0.1) + f32(50) * cut("periods")[0] + f32(100)).cast("long")
    return rows.select(stem(F.col("path")).alias("source_name"), "row", F.concat(cut("cepstrum"), cut("pitch_corr")).alias("features"),
                       period.alias("period"), cut("lpc").alias("lpc"), F.slice("f", named + 1, max(width - named, 0)).alias("rest"))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Song list: one JSON array, or one object per line."""
    return spark.read.json(path, multiLine=multi_line, schema="name string, pool string, wav string")


def read_clip_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON object language -> list of clips, as rows."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return t.select(F.explode("m").alias("lang", "clips")).select("lang", F.explode("clips").alias("clip"))


def read_clip_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated catalogue; client, path and gender are columns 0, 1 and 8; short rows are dropped."""
    parts = F.split("value", "\t")
    t = spark.read.text(path).where(F.size(parts) >= 9)
    return t.select(parts[0].alias("client"), parts[1].alias("path"), parts[8].alias("gender")).where(F.col("client") != "client_id")


def list_audio(spark: SparkSession, path: str, ext: str = ".wav", with_features: str | None = None) -> DataFrame:
    """Files below a folder by extension; optionally only those with a feature file of the same stem."""
    def names(pattern):
        # content is never read: only the listing is used
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
                .load(path).select(F.col("path"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem_path"), F.col("length")))
    out = names(f"*{ext}")
    if with_features:
        other = names(f"*{with_features}").select(F.expr(f"left(path, length(path) - {len(with_features)})").alias("stem_path"))
        out = out.join(other, "stem_path", "left_semi")
    return out


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """`stats_<metric>.txt` files: number after the last colon of each labelled line."""
    t = _numbered_lines(spark, path)
    return t.where(F.col("text").contains(":")).select(
        F.regexp_extract("source_name", r"^stats_(.*)$", 1).alias("metric"), F.trim(F.substring_index("text", ":", 1)).alias("label"),
        F.trim(F.substring_index("text", ":", -1)).cast("double").alias("value"))


def read_prefixed_scores(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Numbers of log lines that start with `prefix`."""
    t = _numbered_lines(spark, path).where(F.startswith("text", F.lit(prefix)))
    return t.select(F.col("source_name").alias("run"), "line", F.trim(F.substring_index("text", prefix, -1)).cast("double").alias("score"))

