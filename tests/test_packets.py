"""Packet splitting against a scalar re-statement, exhaustively over header bytes and lengths."""

import numpy as np
import pytest

from framescope.functions import packets as P


def frame_samples(toc):
    if toc & 0x80:
        return 120 << ((toc >> 3) & 3)
    if toc & 0x60 == 0x60:
        return 960 if toc & 8 else 480
    k = (toc >> 3) & 3
    return 2880 if k == 3 else 480 << k


def one_size(d):
    if not d:
        return None, 0
    if d[0] < 252:
        return d[0], 1
    if len(d) < 2:
        return None, 0
    return 4 * d[1] + d[0], 2


def plain(packet):
    """Sizes, or None for an invalid packet."""
    if not packet:
        return None
    toc, d = packet[0], packet[1:]
    code = toc & 3
    if code == 0:
        sizes = [len(d)]
    elif code == 1:
        if len(d) % 2:
            return None
        sizes = [len(d) // 2] * 2
    elif code == 2:
        s, used = one_size(d)
        if s is None or s > len(d) - used:
            return None
        sizes = [s, len(d) - used - s]
    else:
        if not d:
            return None
        head, d = d[0], d[1:]
        m = head & 63
        if m == 0 or m * frame_samples(toc) > 5760:
            return None
        room = len(d)
        if head & 0x40:
            while True:
                if room <= 0:
                    return None
                p, d = d[0] if d else 0, d[1:]
                room -= 1 + (254 if p == 255 else p)
                if p != 255:
                    break
        if room < 0:
            return None
        if head & 0x80:
            sizes = []
            for _ in range(m - 1):
                s, used = one_size(d[:room] if room > 0 else b"")
                if s is None:
                    return None
                d, room = d[used:], room - used
                if s > room:
                    return None
                sizes.append(s)
            last = room - sum(sizes)
            if last < 0:
                return None
            sizes.append(last)
        else:
            if room % m:
                return None
            sizes = [room // m] * m
    return None if sizes[-1] > 1275 else sizes


def compare(packets):
    data = np.frombuffer(b"".join(packets), dtype=np.uint8)
    lengths = np.array([len(p) for p in packets])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count, sizes, _ = P.split_batch(data, start, lengths)
    for p, c, s in zip(packets, count, sizes):
        want = plain(p)
        assert (c < 0) == (want is None), (p[:8].hex(), len(p), c, want)
        if want is not None:
            assert s[:c].tolist() == want, (p[:8].hex(), len(p))


def test_every_header_byte():
    packets = [bytes([toc, b1]) + bytes((toc * 7 + b1 + i) % 256 for i in range(n)) for toc in range(256)
               for b1 in (0, 1, 2, 3, 5, 0x41, 0x43, 0x81, 0x83, 0xC2, 0xC6, 0xFF) for n in (0, 1, 2, 3, 30, 61)]
    packets += [bytes([toc]) for toc in range(256)] + [b""]
    compare(packets)


def test_random_and_long():
    rng = np.random.default_rng(2)
    packets = [rng.integers(0, 256, rng.integers(1, 1600), dtype=np.uint8).tobytes() for _ in range(3000)]
    packets += [bytes([3, 0x80 | m]) + rng.integers(0, 20, 300, dtype=np.uint8).tobytes() for m in range(1, 49)]
    packets += [bytes([toc, 0x40 | 2, 255, 255, 3]) + bytes(600) for toc in range(3, 256, 4)]
    compare(packets)


def test_spark_and_udtf_agree(spark, sf):
    from framescope.plans import load
    a = load.QUERIES["x01_packet_frames"](spark, sf).select("stream_id", "frame_index", "frame_no", "frame_bytes")
    b = load.QUERIES["h03_parse_packet_udtf"](spark, sf).where("valid").select("stream_id", "frame_index", "frame_no", "frame_bytes")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_table_function_over_batches(spark):
    """Null and empty payloads are invalid rows; a batch is one call, so columns that go along are repeated per frame."""
    rows = [(1, "a", bytes([0, 1, 2])), (2, None, None), (3, "c", b""), (4, "d", bytes([1, 5, 6, 7, 8])), (5, "e", bytes([1, 5, 6]))]
    spark.createDataFrame(rows, "i int, name string, payload binary").createOrReplaceTempView("some_packets")
    P.register_parse_packets(spark, "i int, name string", name="parse_some")
    got = spark.sql("SELECT * FROM parse_some(TABLE(some_packets))").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 0, 2, True), (2, None, None, None, False), (3, "c", None, None, False), (4, "d", 0, 2, True), (4, "d", 1, 2, True),
                                                        (5, "e", 0, 1, True), (5, "e", 1, 1, True)], key=str)


@pytest.mark.parametrize("toc,want", [(0x00, ("speech", "NB", 1, 480)), (0x7C, ("hybrid", "FB", 2, 960)),
                                      (0x80, ("transform", "NB", 1, 120)), (0xFF, ("transform", "FB", 2, 960)), (0x18, ("speech", "NB", 1, 2880))])
def test_header(spark, toc, want):
    from framescope.functions import scalar as S
    row = spark.createDataFrame([(toc,)], "toc int").select(
        S.packet_mode("toc"), S.packet_bandwidth("toc"), S.packet_channels("toc"), S.samples_per_frame("toc")).first()
    assert tuple(row) == want
