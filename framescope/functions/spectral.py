"""Spectra: the one kernel that leaves the JVM.  Whole Arrow batches, one FFT call each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 17  # numbers that a kernel transforms at a time


def window_shape(kind: str, n: int) -> np.ndarray:
    """raised: symmetric raised cosine; hamming: periodic Hamming; none: flat."""
    if kind == "raised":
        return np.hanning(n)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.ones(n)


def flux_features(df: DataFrame, cur: str, prev: str, prev2: str, bands: list[tuple[int, int]]) -> DataFrame:
    """Adds `band_flux` (per band, summed rise against the previous frame) and `onset` (distance from
    the phase-extrapolated prediction).  Spectra never leave the kernel; 0 where a frame is missing."""
    keep = [f for f in df.schema.fields if f.name not in (cur, prev, prev2)]
    schema = T.StructType([*keep, T.StructField("band_flux", T.ArrayType(T.DoubleType())),
                           T.StructField("onset", T.DoubleType())])
    edges = list(bands)

    def matrix(col, width):
        has = ~np.asarray(col.is_null())
        out = np.zeros((len(col), width))
        if has.any():
            out[has] = np.asarray(col.drop_null().flatten(), dtype=np.float64).reshape(-1, width)
        return out, has

    def body(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [b.column(b.schema.get_field_index(c)) for c in (cur, prev, prev2)]
            lengths = [n for c in cols for n in pc.unique(pc.list_value_length(c)).to_pylist() if n]
            if len(set(lengths)) > 1:
                raise ValueError(f"frames of different lengths: {sorted(set(lengths))}")
            width = max(lengths, default=1)
            shape = np.hanning(width)
            (x, _), (p, has1), (q, has2) = (matrix(c, width) for c in cols)
            sx, sp, sq = (np.fft.rfft(m * shape, axis=1) for m in (x, p, q))
            mx, mp = np.abs(sx), np.abs(sp)
            rise = np.maximum(mx - mp, 0.0) * has1[:, None]
            flux = np.stack([rise[:, lo:hi].sum(axis=1) for lo, hi in edges], axis=1)
            turn = 2.0 * np.angle(sp) - np.angle(sq)
            onset = np.abs(sx - mp * np.exp(1j * turn)).sum(axis=1) * has2
            out = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            k = flux.shape[1]
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (len(flux) + 1) * k, k, dtype=np.int32)),
                                                pa.array(np.ascontiguousarray(flux).ravel())))
            out.append(pa.array(onset))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.mapInArrow(body, schema)


def rows_of(column: pa.Array, size: int, last: bool) -> np.ndarray:
    """The first (or last) `size` samples of every list."""
    ends = column.offsets.to_numpy()
    at = ends[1:] - size if last else ends[:-1]
    return column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)[at[:, None] + np.arange(size)]


def _measured(df: DataFrame, inputs: tuple[str, str], names: tuple[str, ...], kernel) -> DataFrame:
    """Replaces two columns of sample lists by the numbers that `kernel` makes of them."""
    keep = [f for f in df.schema.fields if f.name not in inputs]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in names]])

    def body(batches):
        for b in batches:
            if b.num_rows:
                values = kernel(*[b.column(c) for c in inputs])
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *[pa.array(v, from_pandas=True) for v in values]], schema.names)

    return df.mapInArrow(body, schema)


def distances(df: DataFrame, ref: str, dec: str, size: int, weights: list[float]) -> DataFrame:
    """`lsd` and `pse` of every pair of windows: distance of the log spectra, plain and weighted by bin and by masking."""
    shape, base = np.hanning(size), np.array(weights)

    def kernel(x, y):
        ms, md = (np.abs(np.fft.rfft(rows_of(c, size, True) * shape, axis=1)) for c in (x, y))
        gap = np.log10(ms ** 2 + 1e-12) - np.log10(md ** 2 + 1e-12)
        w = base / np.sqrt(np.maximum(ms, 1e-6))
        w /= w.mean(axis=1, keepdims=True)
        return 10 * np.sqrt((gap ** 2).mean(axis=1)), np.sqrt(((gap * w) ** 2).mean(axis=1))

    return _measured(df, (ref, dec), ("lsd", "pse"), kernel)


def flux_changes(df: DataFrame, ref: str, dec: str, size: int) -> DataFrame:
    """`flux_err` and `ref_flux` of windows that hold the samples of the one before them too; for one that does not, null and 0."""
    shape = np.hanning(size)

    def kernel(x, y):
        has = np.diff(x.offsets.to_numpy()) > size
        rises = []
        for c in (x, y):
            now, before = (np.abs(np.fft.rfft(rows_of(c, size, last) * shape, axis=1)) for last in (True, False))
            rises.append(np.maximum(now - before, 0.0))
        return np.where(has, ((rises[0] - rises[1]) ** 2).mean(axis=1), np.nan), np.where(has, rises[0].sum(axis=1), 0.0)

    return _measured(df, (ref, dec), ("flux_err", "ref_flux"), kernel)


def to_lists(mat: np.ndarray, has: np.ndarray) -> pa.Array:
    """The rows of `mat` as lists, in the places that `has` marks; null in the others."""
    ends = np.concatenate([[0], np.cumsum(np.where(has, mat.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(mat, dtype=np.float64).ravel()), mask=pa.array(~has))


def spectra(df: DataFrame, cols: dict[str, str], window: str = "raised", phase: bool = False, power: bool = False,
            gain: float = 1.0) -> DataFrame:
    """Adds, for `cols` input -> prefix, arrays `<prefix>mag` (or `<prefix>pow`) and `<prefix>phase`.
    Frames of one column have equal length, anything else is an error.  A missing frame counts as zeros if another of
    the row's frames tells its length, else its spectrum is null."""
    df = df.withColumn("_frame_size", F.coalesce(*[F.when(F.col(c).isNotNull(), F.size(c)) for c in cols]))
    value = T.ArrayType(T.DoubleType())
    added = []
    for prefix in cols.values():
        added.append(T.StructField(prefix + ("pow" if power else "mag"), value))
        if phase:
            added.append(T.StructField(prefix + "phase", value))
    schema = T.StructType([*df.schema.fields, *added])

    def body(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            arrays = list(b.columns)
            size_of = b.column(b.schema.get_field_index("_frame_size"))
            known, sizes = ~np.asarray(size_of.is_null()), np.asarray(size_of.fill_null(0))
            for name in cols:
                col = b.column(b.schema.get_field_index(name))
                has = ~np.asarray(col.is_null())
                flat = np.asarray(col.drop_null().flatten(), dtype=np.float64)
                each = set(sizes[known].tolist()) | set(pc.unique(pc.list_value_length(col.drop_null())).to_pylist())
                if len(each) > 1:
                    raise ValueError(f"frames of different lengths in {name}: {sorted(each)}")
                width = each.pop() if each else 1
                x = np.zeros((b.num_rows, width))
                x[has] = flat.reshape(int(has.sum()), width)
                spec = np.fft.rfft(x[known] * (gain * window_shape(window, width)), axis=1)
                arrays.append(to_lists(np.abs(spec) ** 2 if power else np.abs(spec), known))
                if phase:
                    arrays.append(to_lists(np.angle(spec), known))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(body, schema).drop("_frame_size")


def one_length(columns) -> int:
    """The length of the frames of some columns, 0 if all are missing; different ones are an error."""
    each = {n for c in columns for n in pc.unique(pc.list_value_length(c.drop_null())).to_pylist()}
    if len(each) > 1:
        raise ValueError(f"frames of different lengths: {sorted(each)}")
    return each.pop() if each else 0


def power_bins(column, width: int, bins: int, window: str, gain: float) -> np.ndarray:
    """Power in the first `bins` bins of frames of `width` samples, a matrix; a missing frame counts as zeros.  Samples are taken in pieces
    of PIECE numbers."""
    out = np.zeros((len(column), bins))
    if width and width // 2 + 1 < bins:
        raise ValueError(f"frames of {width} samples have {width // 2 + 1} bins, {bins} are needed")
    shape, step = gain * window_shape(window, width), max(1, PIECE // max(width, 1))
    for at in range(0, len(column), step):
        piece = column.slice(at, step)
        x = piece.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(width, 1)) * shape if width else np.zeros((0, 1))
        out[at:at + step][~np.asarray(piece.is_null())] = np.abs(np.fft.rfft(x, axis=1)[:, :bins]) ** 2 if len(x) else 0.0
    return out


def multi_resolution_terms(df: DataFrame, ref: str, deg: str, sizes: list[int], ident: list[str], rate: int = 16000) -> DataFrame:
    """Per item and FFT size, the additive pieces of the multi-resolution distance."""
    schema = T.StructType([*[df.schema[c] for c in ident], T.StructField("fft_size", T.IntegerType()),
                           T.StructField("log_l1", T.DoubleType()), T.StructField("cells", T.LongType()),
                           T.StructField("xy", T.DoubleType()), T.StructField("xx", T.DoubleType()),
                           T.StructField("yy", T.DoubleType())])

    def smoother(n):
        src = np.arange(n + 1) / n * rate / 2
        dst = np.arange(n) / n * rate / 2
        dist = np.abs(src[None, :] - dst[:, None]) / (24.7 + 0.108 * src[None, :])
        db = np.where(dist < 0.5, -12 * dist ** 2, 3 - 12 * dist)
        w = 10.0 ** (db / 10)
        return w / w.sum(axis=1, keepdims=True)

    banks = {s: smoother(s // 2) for s in sizes}

    def frames(x, s):
        hop = s // 2
        pad = np.pad(x, ((0, 0), (s // 2, s // 2)), mode="reflect") if x.shape[1] > s // 2 else np.pad(x, ((0, 0), (s // 2, s // 2)))
        v = np.lib.stride_tricks.sliding_window_view(pad, s, axis=1)[:, ::hop]
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s) / s)
        return np.abs(np.fft.rfft(v * w, axis=2))

    def body(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            sig = {}
            for name in (ref, deg):
                col = b.column(b.schema.get_field_index(name))
                sig[name] = np.asarray(col.flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            ids = [b.column(b.schema.get_field_index(c)) for c in ident]
            for s in sizes:
                x, y = frames(sig[ref], s), frames(sig[deg], s)
                lx, ly = (np.log(m @ banks[s].T + 1e-9) for m in (x, y))
                l1 = np.abs(lx - ly).sum(axis=(1, 2))
                cells = np.full(b.num_rows, lx.shape[1] * lx.shape[2], dtype=np.int64)
                cols = [*ids, pa.array(np.full(b.num_rows, s, dtype=np.int32)), pa.array(l1), pa.array(cells),
                        pa.array((x * y).sum(axis=(1, 2))), pa.array((x * x).sum(axis=(1, 2))),
                        pa.array((y * y).sum(axis=(1, 2)))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.mapInArrow(body, schema)
