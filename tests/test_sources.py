"""Readers on small files, good and bad."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.sources import readers as R


def test_wav_gate(spark, tmp_path):
    for name, ch, rate in (("good", 2, 48000), ("mono", 1, 48000), ("slow", 2, 16000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(ch)
            w.setframerate(rate)
            w.setsampwidth(2)
            w.writeframes(np.arange(2000, dtype="<i2").tobytes())
    (tmp_path / "junk.wav").write_bytes(b"hello")
    good, bad = R.read_wav(spark, str(tmp_path))
    assert [r["stream_id"] for r in good.select("stream_id").distinct().collect()] == ["good"]
    assert sorted(r["stream_id"] for r in bad.collect()) == ["junk", "mono", "slow"]
    first = good.orderBy("block_index").first()["pcm"]
    np.testing.assert_allclose(first[0][:3], np.array([0, 2, 4]) / 32768)
    np.testing.assert_allclose(first[1][:3], np.array([1, 3, 5]) / 32768)


@pytest.mark.parametrize("fmt", ["s16", "s24", "f32"])
def test_raw_formats(spark, tmp_path, fmt):
    x = np.array([0, 1, -1, 1000, -32768, 32767, 5, -7])
    raw = {"s16": x.astype("<i2").tobytes(), "f32": (x / 32768).astype("<f4").tobytes(),
           "s24": b"".join(struct.pack("<i", int(v) * 256)[:3] for v in x)}[fmt]
    (tmp_path / "a.pcm").write_bytes(raw)
    rows = R.read_pcm(spark, str(tmp_path), fmt, 1, 3).orderBy("block_index").collect()
    assert [len(r["pcm"][0]) for r in rows] == [3, 3, 2]
    np.testing.assert_allclose(np.concatenate([r["pcm"][0] for r in rows]), x / 32768, atol=1e-7)


def test_packet_log_cut_short(spark, tmp_path):
    one = struct.pack(">iI", 3, 7) + b"abc"
    (tmp_path / "ok.bit").write_bytes(one * 2)
    (tmp_path / "short.bit").write_bytes(one + struct.pack(">iI", 10, 1) + b"xy")
    (tmp_path / "long.bit").write_bytes(one + struct.pack(">iI", 1501, 1) + bytes(1501))
    rows = R.read_packet_log(spark, str(tmp_path)).collect()
    assert sum(r["payload"] is not None for r in rows) == 4
    assert sorted(r["stream_id"] for r in rows if r["payload"] is None) == ["long", "short"]


def test_telemetry_blank_and_empty(spark, tmp_path):
    head = "frame_index,packet_bytes,analysis_activity,input_samples\n"
    (tmp_path / "t.csv").write_text(head + "0,,0.5,960\n1,12,,960\n")
    rows = R.read_telemetry(spark, str(tmp_path / "t.csv")).orderBy("frame_index").collect()
    assert [(r["packet_bytes"], r["analysis_activity"], r["analysis_noisiness"]) for r in rows] == [(0, 0.5, 0.0), (12, 0.0, 0.0)]
    (tmp_path / "e.csv").write_text(head)
    with pytest.raises(ValueError):
        R.read_telemetry(spark, str(tmp_path / "e.csv"))


def test_feature_layouts(spark, tmp_path):
    x = np.arange(110, dtype="<f4") / 100
    (tmp_path / "f.f32").write_bytes(x.tobytes())
    r = R.read_feature_matrix(spark, str(tmp_path), version=1).orderBy("row").collect()
    assert len(r) == 2 and len(r[0]["features"]) == 19 and len(r[0]["lpc"]) == 16
    assert r[0]["period"] == int(np.float32(0.1) + np.float32(50) * x[36] + np.float32(100))


def test_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"name": "a", "pool": "p", "wav": "a.wav"}, {"name": "b", "pool": "p", "wav": "b.wav"}]')
    assert [r["name"] for r in R.read_manifest(spark, str(tmp_path / "m.json")).orderBy("name").collect()] == ["a", "b"]
    (tmp_path / "c.json").write_text('{"en": ["1.mp3", "2.mp3"], "de": ["3.mp3"]}')
    assert R.read_clip_lists(spark, str(tmp_path / "c.json")).count() == 3
    (tmp_path / "b.txt").write_text("0,FB\n1,xx\nnonsense\n2,wb\n")
    assert [r["bandwidth"] for r in R.read_bandwidth_plan(spark, str(tmp_path / "b.txt")).orderBy("frame_index").collect()] == ["FB", "WB"]


def test_telemetry_columns_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("frame_index,packet_bytes,analysis_tonality\n1,200,0.5\n2,210,\n")
    (tmp_path / "c.csv").write_text("packet_bytes,frame_index\n300,7\n")
    got = {(r["frame_index"], r["packet_bytes"], r["analysis_tonality"]) for r in R.read_telemetry(spark, str(tmp_path)).collect()}
    assert got == {(1, 200, 0.5), (2, 210, 0.0), (7, 300, 0.0)}


def test_packets_above_the_limit_end_a_log(spark, tmp_path):
    import struct
    (tmp_path / "x.bit").write_bytes(struct.pack(">iI", 2000, 5) + b"z" * 2000)
    assert [r["payload"] for r in R.read_packet_log(spark, str(tmp_path)).collect()] == [None]
    assert [len(r["payload"]) for r in R.read_packet_log(spark, str(tmp_path), max_packet=4000).collect()] == [2000]


@pytest.mark.parametrize("opens", [True, False])
def test_a_file_of_several_ranges_gives_the_same_rows(spark, tmp_path, monkeypatch, opens):
    rng = np.random.default_rng(4)
    x = rng.integers(-32768, 32767, 5001, dtype="<i2")
    (tmp_path / "pcm").mkdir()
    (tmp_path / "pcm" / "a.pcm").write_bytes(x.tobytes())
    (tmp_path / "wav").mkdir()
    with wave.open(str(tmp_path / "wav" / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setframerate(48000)
        w.setsampwidth(2)
        w.writeframes(x[:5000].tobytes())
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.f32").write_bytes(rng.random(36 * 50, dtype="<f4").tobytes())
    # Payloads full of zeros and of length fields, which look like packets.
    (tmp_path / "log").mkdir()
    packets = [(i, bytes(rng.integers(0, 2, rng.integers(0, 60), dtype=np.uint8)) if i % 3 else struct.pack(">iI", 4, 9) * rng.integers(0, 6)) for i in range(400)]
    body = b"".join(struct.pack(">iI", len(p), c) + p for c, p in packets)
    for name, raw in (("good", body), ("short", body[:-5]), ("bad", body[:3000] + b"\xff" * 8 + body[3000:]), ("empty", b""), ("seven", b"1234567"), ("tail", body + b"123")):
        (tmp_path / "log" / f"{name}.bit").write_bytes(raw)
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "l.txt").write_text("".join(f"{i % 2}\r\n" if i % 7 else "\n" for i in range(3000)))

    def everything():
        good, bad = R.read_wav(spark, str(tmp_path / "wav"), block=50)
        tables = [R.read_pcm(spark, str(tmp_path / "pcm"), "s16", 2, 30), good, bad, R.read_feature_matrix(spark, str(tmp_path / "f")),
                  R.read_packet_log(spark, str(tmp_path / "log"), 100), R.read_loss_trace(spark, str(tmp_path / "txt"))]
        return [sorted(map(repr, t.collect())) for t in tables]

    whole = everything()
    monkeypatch.setattr(R, "RANGE_BYTES", 500)
    if not opens:
        monkeypatch.setattr(R, "_opens", lambda files: False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        tasks = R.read_pcm(spark, str(tmp_path / "pcm"), "s16", 2, 30).select(F.spark_partition_id()).distinct().count()
        assert tasks > 2 if opens else tasks >= 1  # what only Spark can open is read a file at a time
        assert R.read_loss_trace(spark, str(tmp_path / "txt")).select("seq").count() == sum(i % 7 != 0 for i in range(3000))
        assert everything() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    logs = {}
    for r in R.read_packet_log(spark, str(tmp_path / "log"), 100).collect():
        logs.setdefault(r["stream_id"], []).append((r["seq"], r["check"], r["payload"] and bytes(r["payload"])))
    want = [(i, c, p or None if not p else p) for i, (c, p) in enumerate(packets)]
    got = [(s, c, p or None) for s, c, p in sorted(logs["good"])]
    assert got == [(i, c, p or None) for i, c, p in want] and sorted(logs["short"])[-1] == (399, None, None)
    assert "empty" not in logs and "seven" not in logs and len(logs["tail"]) == 400
    assert sorted(logs["bad"])[-1][2] is None


def test_short_files_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.bit").write_bytes(struct.pack(">iI", 3, i) + b"abc")
    spans = R._spans(R._whole(R._files(spark, str(tmp_path))), 1)
    assert spans.count() == 60 and spans.rdd.getNumPartitions() == 1
    rows = R.read_packet_log(spark, str(tmp_path)).collect()
    assert sorted((r["stream_id"], r["seq"], r["check"], bytes(r["payload"])) for r in rows) == sorted((str(i), 0, i, b"abc") for i in range(60))
