"""Splitting coded packets into frame sizes, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FRAME = 1275          # fixed values
MAX_SAMPLES = 5760


def frame_samples(toc: np.ndarray) -> np.ndarray:
    k = (toc >> 3) & 3
    speech = np.where(k == 3, 2880, 480 << k)
    hybrid = np.where(toc & 8, 960, 480)
    return np.where(toc & 0x80, 120 << k, np.where((toc & 0x60) == 0x60, hybrid, speech))


def split_batch(data: np.ndarray, start: np.ndarray, length: np.ndarray):
    """-> (count per packet or -1, sizes matrix, padding).  `data` holds all payloads back to back."""
    n = len(start)
    data = np.append(data, np.zeros(4, dtype=np.uint8)).astype(np.int64)
    ok = length > 0
    at = lambda pos: data[np.minimum(pos, len(data) - 1)]
    toc = np.where(ok, at(start), 0)
    pos, left = start + 1, length - 1
    code = toc & 3
    count = np.array([1, 2, 2, 0])[code]
    sizes = np.zeros((n, 48), dtype=np.int64)
    last = left.copy()
    pad = np.zeros(n, dtype=np.int64)

    def read_size(on):
        """Reads a one- or two-byte size where `on`; -1 where it does not fit."""
        nonlocal pos, left
        b0, b1 = at(pos), at(pos + 1)
        short = b0 < 252
        fits = np.where(short, left >= 1, left >= 2)
        val = np.where(fits, np.where(short, b0, 4 * b1 + b0), -1)
        used = np.where(on & fits, np.where(short, 1, 2), 0)
        pos, left = pos + used, left - used
        return val

    # two equal frames
    two = ok & (code == 1)
    ok &= ~(two & (left % 2 == 1))
    last = np.where(two, left // 2, last)
    sizes[two, 0] = last[two]
    # two frames, first size written
    var2 = ok & (code == 2)
    s = read_size(var2)
    ok &= ~(var2 & ((s < 0) | (s > left)))
    sizes[var2, 0] = s[var2]
    last = np.where(var2, left - s, last)
    # counted frames
    many = ok & (code == 3)
    ok &= ~(many & (left < 1))
    many &= ok
    head = at(pos)
    m = head & 63
    ok &= ~(many & ((m <= 0) | (frame_samples(toc) * m > MAX_SAMPLES)))
    many &= ok
    count = np.where(many, m, count)
    pos, left = np.where(many, pos + 1, pos), np.where(many, left - 1, left)
    padding = many & ((head & 0x40) != 0)
    while padding.any():
        ok &= ~(padding & (left <= 0))
        padding &= ok
        p = at(pos)
        skip = np.where(p == 255, 254, p)
        pos, left = np.where(padding, pos + 1, pos), np.where(padding, left - 1 - skip, left)
        pad = np.where(padding, pad + skip, pad)
        padding &= p == 255
    ok &= ~(many & (left < 0))
    many &= ok
    vbr = many & ((head & 0x80) != 0)
    last = np.where(vbr, left, last)
    for i in range(47):
        on = vbr & ok & (i < count - 1)
        if not on.any():
            break
        before = left.copy()
        s = read_size(on)
        ok &= ~(on & ((s < 0) | (s > left)))
        on &= ok
        sizes[on, i] = s[on]
        last = np.where(on, last - (before - left) - s, last)
    ok &= ~(vbr & (last < 0))
    cbr = many & ~vbr
    each = left // np.maximum(count, 1)
    ok &= ~(cbr & (each * count != left))
    last = np.where(cbr, each, last)
    fill = (np.arange(48)[None, :] < (count - 1)[:, None]) & (cbr & ok)[:, None]
    sizes = np.where(fill, last[:, None], sizes)
    ok &= last <= MAX_FRAME
    sizes[np.arange(n), np.maximum(count, 1) - 1] = last
    return np.where(ok, count, -1), sizes, np.where(ok, pad, 0)


def split_column(payloads: pa.Array):
    """`split_batch` of a column of byte strings; null ones count as empty."""
    col = payloads.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + col.offset + 1)[col.offset:]
    return split_batch(np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8), off[:-1], np.diff(off))


def parse_packets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `frame_sizes` (null for an invalid packet) and `padding`; drops the payload."""
    keep = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*keep, T.StructField("frame_sizes", T.ArrayType(T.IntegerType())),
                           T.StructField("padding", T.LongType())])

    def body(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            count, sizes, pad = split_column(b.column(b.schema.get_field_index(payload)))
            rows = [None if c < 0 else s[:c] for c, s in zip(count, sizes)]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            cols += [pa.array(rows, type=pa.list_(pa.int32())), pa.array(pad, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(body, schema)


def packet_frames(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per frame of every valid packet."""
    p = parse_packets(df, payload)
    return p.select("*", F.posexplode("frame_sizes").alias("frame_no", "frame_bytes")).drop("frame_sizes")


def register_parse_packets(spark, keep: str, payload: str = "payload", name: str = "parse_packets") -> None:
    """SQL surface over Arrow batches: SELECT * FROM parse_packets(TABLE(SELECT <keep>, payload FROM packets)).

    `keep` is the DDL of the columns that go along.  One row per frame of a valid packet, one row with nulls and valid = false for
    an invalid, empty or null one; a batch is parsed in one call."""
    from pyspark.sql.functions import arrow_udtf

    names = T.StructType.fromDDL(keep).names

    @arrow_udtf(returnType=f"{keep}, frame_no int, frame_bytes int, valid boolean")
    class ParsePackets:
        def eval(self, batch: pa.RecordBatch):
            batch = batch if isinstance(batch, pa.RecordBatch) else pa.RecordBatch.from_struct_array(batch)
            count, sizes, _ = split_column(batch.column(batch.schema.get_field_index(payload)))
            valid = count >= 0
            copies = np.where(valid, count, 1)
            row = np.repeat(np.arange(len(count)), copies)
            number = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            missing = ~valid[row]
            columns = {n: batch.column(batch.schema.get_field_index(n)).take(pa.array(row)) for n in names}
            yield pa.table({**columns, "frame_no": pa.array(number.astype(np.int32), mask=missing),
                            "frame_bytes": pa.array(sizes[row, number].astype(np.int32), mask=missing), "valid": pa.array(~missing)})

    spark.udtf.register(name, ParsePackets)
