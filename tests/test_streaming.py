"""Live rules."""

import random

import pytest
from pyspark.sql import functions as F

from framescope.operators import layout
from framescope.streaming import operators as ST


def plain_gaps(rows, delay):
    """rows: (stream, seq, sent, arrival) in order of arrival."""
    top, latest, seen, out = {}, {}, set(), []
    for s, seq, ts, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if seq > top.get(s, -1):
            out += [(s, q, "lost") for q in range(top.get(s, -1) + 1, seq)]
        else:
            out.append((s, seq, "restored" if (s, seq) not in seen and ts >= latest[s] - delay else "late"))
        seen.add((s, seq))
        top[s], latest[s] = max(seq, top.get(s, -1)), max(ts, latest.get(s, ts))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_gap_events(short_segments, files, monkeypatch):
    rnd = random.Random(2)
    rows = [(s, q, 60 * q, 60 * q + rnd.choice([0, 0, 0, 90, 400, 3000])) for s, n in ((1, 200), (2, 30)) for q in range(n) if rnd.random() < 0.8]
    rows += [(1, 50, 3000, 9000), (1, 50, 3000, 9001), (3, 7, 5, 5)]
    df = short_segments.createDataFrame(rows, "stream_id long, seq long, ts long, arrival long").withColumns({c: F.timestamp_seconds(c) for c in ("ts", "arrival")})
    live = ST.replay(short_segments, df, F.lit(0), files, order="arrival")
    got = ST.gap_events(ST.live_gaps(live, "10 minutes"), block=3).collect()
    want = plain_gaps(rows, 600)
    assert sorted(tuple(r) for r in got) == want
    assert {e for _, _, e in want} == {"lost", "restored", "late"}


def test_stream_equals_batch(spark, sf):
    from framescope.plans import load
    a = load.QUERIES["st10_static_plan"](spark, sf)
    b = load.QUERIES["j05_plan_in_force"](spark, sf)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_closed_replay_emits_the_last_windows(spark):
    hours = [(1, 1), (1, 2), (1, 30), (1, 100), (1, 101), (2, 99)]
    df = spark.createDataFrame([(s, h, 100, "view") for s, h in hours] + [(1, 200, 100, "error")], "stream_id long, h long, packet_bytes long, event_type string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).drop("h")
    talk = df.where("event_type != 'error'")

    def rows(operator, table, length, **params):
        live = ST.replay(spark, df, F.when(F.col("ts") < F.timestamp_seconds(F.lit(50 * 3600)), 0).otherwise(1), 2, ST.closing_event(table, "1 day", length))
        out = ST.run_to_table(operator(live, delay="1 day", **params)).collect()
        return sorted((r["stream_id"], int(r["start"].timestamp()) // 3600, r["packets" if "packets" in r else "frames"]) for r in out)

    want = [(1, h - h % 4 - back) for s, h in hours + [(1, 200)] if s == 1 for back in (0, 4, 8)] + [(2, 96 - back) for back in (0, 4, 8)]
    assert rows(ST.sliding_rates, df, "12 hours", size="12 hours", slide="4 hours") == sorted((s, h, want.count((s, h))) for s, h in set(want))
    spurts = rows(ST.talk_spurts, talk, "6 hours", active=F.col("event_type") != "error", gap="6 hours")
    assert spurts == [(1, 1, 2), (1, 30, 1), (1, 100, 2), (2, 99, 1)]


def test_slices_are_cut_into_bounded_files_in_order(spark, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 10)
    times = [(7 * i) % 60 for i in range(60)]
    df = spark.createDataFrame([(1, t, t) for t in times] + [(2, 100, t) for t in (1, 5)], "stream_id long, excess long, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    live = ST.replay(spark, df, F.when(F.col("seq") < 40, 0).otherwise(1), 2, order="ts")
    per_file = live.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    files = ST.run_to_table(per_file).groupBy("file", "at").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z")).orderBy("at").collect()
    assert sum(r["n"] for r in files) == 62 and max(r["n"] for r in files) <= 20 and len(files) >= 5
    assert all(x["z"] < y["a"] for x, y in zip(files, files[1:]))


def frames_with(spark, rows):
    return spark.createDataFrame(rows, "stream_id long, seq long, sec long, excess long, frame_ms int, active boolean, value double").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def run_rule(spark, df, rule, files, delay="60 seconds", closed=True, **params):
    closing = ST.closing_event(df, delay, "1 second") if closed else None
    live = ST.replay(spark, df, F.floor(F.unix_seconds("ts") / F.lit(1e9)).cast("int"), files, closing, order="ts")
    return sorted(tuple(r) for r in ST.ordered(live, rule, delay, **params).collect())


def test_ordered_rules_do_not_depend_on_slices(short_segments):
    """Most rows are one stream's, which is many segments; order is by time, not by number or place in a file."""
    rnd = random.Random(5)
    rows = [(1 if i % 4 else 2, i, (i * 37) % 300, rnd.randint(-40, 60), rnd.choice([10, 20, 40, 60]), rnd.random() < 0.05, rnd.random() * 10) for i in range(300)]
    df = frames_with(short_segments, rows)
    want = {"gate": [], "cls": [], "level": []}
    for s in (1, 2):
        quiet = cls = level = 0
        for _, seq, _, excess, ms, active, value in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            quiet = 0 if active else quiet + ms
            gate = int(not active and 200 < quiet <= 600)
            quiet = 200 if quiet > 600 else quiet
            want["gate"].append((s, seq, gate))
            new = sum(value >= t for t in (3, 7))
            if new > cls and value < (3, 7)[cls] + 0.5 or new < cls and value > (3, 7)[cls - 1] - 0.5:
                new = cls
            if new != cls:
                want["cls"].append((s, seq, new))
            cls, level = new, max(0, level + excess)
            if level >= 100:
                want["level"].append((s, seq, level))
    for files in (1, 4):
        assert run_rule(short_segments, df, ST.silence_gate(), files) == sorted(want["gate"])
    assert run_rule(short_segments, df, ST.class_changes([3.0, 7.0], [0.5, 0.5]), 3) == sorted(want["cls"])
    assert run_rule(short_segments, df, ST.bucket_alarm(100), 2) == sorted(want["level"])


def test_late_rows_are_counted_and_silent_streams_expire(spark):
    def at(s, seq, sec):
        return (s, seq, sec, 10, 20, False, 0.0)
    df = frames_with(spark, [at(1, 0, 0), at(2, 1, 1), at(1, 2, 500), at(1, 3, 5), at(2, 4, 2000), at(1, 5, 2100)]).withColumn("part", F.expr("CASE WHEN seq < 3 THEN 0 WHEN seq < 4 THEN 1 WHEN seq < 5 THEN 2 ELSE 3 END"))
    # Each part is one micro-batch; number 3 comes after the watermark has passed its time.
    live = ST.replay(spark, df, F.col("part"), 4).drop("part")
    out = layout.scratch_path(spark, "ordered")
    ST.start_ordered(live, ST.bucket_alarm(0), out, "60 seconds", expire="10 minutes").awaitTermination()
    assert [(r["stream_id"], r["seq"]) for r in spark.read.parquet(f"{out}/late").collect()] == [(1, 3)]
    got = sorted((r["stream_id"], r["seq"], r["level"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(1, 0, 10), (1, 2, 20), (2, 1, 10), (2, 4, 10)]  # stream 2 began anew


def test_one_jump_is_one_row(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1 << 40, 1), (1, (1 << 40) - 3, 2), (1, 5, 3)], "stream_id long, seq long, at long").withColumn("arrival", F.timestamp_seconds("at"))
    df = df.withColumn("ts", F.timestamp_seconds(F.when(F.col("seq") == 5, F.lit(-1000)).otherwise(F.col("at"))))
    got = sorted(tuple(r) for r in ST.live_gaps(ST.replay(spark, df.drop("at"), F.lit(0), 1), "1 minute").collect())
    assert got == [(1, 1, (1 << 40) - 1, "lost"), (1, 5, 5, "late"), (1, (1 << 40) - 3, (1 << 40) - 3, "restored")]


@pytest.mark.parametrize("most, want", [(6, 3), (2, 5)])
def test_micro_batches_do_not_grow_with_the_table(spark, monkeypatch, most, want):
    """Of 10 files 3 slices make 3 micro-batches, or as many as BATCH_FILES asks for; times rise from one to the next."""
    monkeypatch.setattr(ST, "FILE_ROWS", 10)
    monkeypatch.setattr(ST, "BATCH_FILES", most)
    df = spark.createDataFrame([(i,) for i in range(95)], "at long").withColumn("ts", F.timestamp_seconds("at"))
    seen = []
    live = ST.replay(spark, df, F.floor(F.col("at") / 40).cast("int"), 3, order="ts")
    live.writeStream.foreachBatch(lambda rows, n: seen.append(sorted(r["at"] for r in rows.collect()))).option(
        "checkpointLocation", layout.scratch_path(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == want and [x for part in seen for x in part] == list(range(95))


def test_state_maps_travel_in_small_integers():
    from framescope.operators import recurrence
    assert [recurrence.StateMap(n).kinds[0].elementType.typeName() for n in (61, 128, 129, 40_000)] == ["byte", "byte", "short", "long"]
