"""Sequential rules over an ordered stream, run segment by segment.

A rule qualifies if the step of a row is a map of states that can be composed with the next row's and written down as small.
Each segment is reduced to one composed map, these are chained to find the state at the start of every segment,
and then all segments run at once.  A task sees at most one segment, plus at most FANOUT of those small rows.

Inside a task maps are composed by doubling, over all rows of an Arrow batch at a time: after k rounds every row has the map of
the last 2**k rows of its group, so a segment of n rows takes log2(n) rounds of NumPy operations.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framescope.operators.layout import FANOUT, KEYS, ORDER, attach, cut_lineage, segment_length, segment_of

FIRST = -(1 << 62)  # order value of the row that brings the carried state


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


class ClampedLinear:
    """y -> min(hi, max(lo, gain*y + step)) with gain >= 0."""

    cols = ("_gain", "_step", "_lo", "_hi")
    type = T.DoubleType()
    kinds = (T.DoubleType(),) * 4

    @staticmethod
    def read(batch):
        return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ClampedLinear.cols)

    @staticmethod
    def write(maps):
        return [pa.array(m) for m in maps]

    @staticmethod
    def apply(maps, y):
        gain, step, lo, hi = maps
        with np.errstate(invalid="ignore"):
            return np.minimum(hi, np.maximum(lo, np.where(gain == 0, step, gain * y + step)))

    @staticmethod
    def compose(first, then):
        g1, s1, l1, h1 = first
        g2, s2, _, _ = then
        with np.errstate(invalid="ignore"):
            return g1 * g2, np.where(g2 == 0, 0.0, g2 * s1) + s2, ClampedLinear.apply(then, l1), ClampedLinear.apply(then, h1)

    @staticmethod
    def constant(y):
        return np.zeros(len(y)), y, np.full(len(y), -np.inf), np.full(len(y), np.inf)

    @staticmethod
    def states(column):
        return column.to_numpy(zero_copy_only=False).astype(float)

    @staticmethod
    def initial(value, n):
        return np.full(n, float(value))

    @staticmethod
    def write_states(y):
        return pa.array(y)


class FiniteState:
    """state -> next state, written as one column per possible state."""

    type = T.LongType()

    def __init__(self, states: int):
        self.cols = tuple(f"_to{i}" for i in range(states))
        self.kinds = (T.LongType(),) * states

    def read(self, batch):
        return (np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in self.cols], 1),)

    def write(self, maps):
        return [pa.array(np.ascontiguousarray(maps[0][:, i])) for i in range(len(self.cols))]

    def apply(self, maps, y):
        return np.take_along_axis(maps[0], y[:, None], 1)[:, 0]

    def compose(self, first, then):
        return (np.take_along_axis(then[0], first[0], 1),)

    def constant(self, y):
        return (np.repeat(y[:, None], len(self.cols), 1),)

    def states(self, column):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)

    def initial(self, value, n):
        return np.full(n, int(value), np.int64)

    def write_states(self, y):
        return pa.array(y)


class StateMap(FiniteState):
    """state -> next state as one array column `_map`; for rules of many states.  The arrays travel in the smallest integers that hold a state."""

    cols = ("_map",)

    def __init__(self, states: int):
        self.width = states
        item, self.dtype = (T.ByteType(), np.int8) if states <= 1 << 7 else (T.ShortType(), np.int16) if states <= 1 << 15 else (T.LongType(), np.int64)
        self.kinds = (T.ArrayType(item),)

    def read(self, batch):
        return (batch.column("_map").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, self.width),)

    def write(self, maps):
        return [_lists(maps[0].astype(self.dtype))]

    def constant(self, y):
        return (np.repeat(y[:, None], self.width, 1),)


class Decay:
    """y -> gain*y + add for arrays of `width` values; `_gain` is one number a row, or with `per_value` an array like `_add`."""

    cols = ("_gain", "_add")
    type = T.ArrayType(T.DoubleType())

    def __init__(self, width: int, per_value: bool = False):
        self.width, self.per_value = width, per_value
        self.kinds = (self.type if per_value else T.DoubleType(), self.type)

    def read(self, batch):
        gain = batch.column("_gain")
        gain = _matrix(gain, self.width) if self.per_value else gain.to_numpy(zero_copy_only=False).astype(float)[:, None]
        return gain, _matrix(batch.column("_add"), self.width)

    def write(self, maps):
        return [_lists(maps[0]) if self.per_value else pa.array(maps[0][:, 0]), _lists(maps[1])]

    def apply(self, maps, y):
        return maps[0] * y + maps[1]

    def compose(self, first, then):
        return first[0] * then[0], then[0] * first[1] + then[1]

    def constant(self, y):
        return np.zeros((len(y), self.width if self.per_value else 1)), y

    def states(self, column):
        return _matrix(column, self.width)

    def initial(self, value, n):
        return np.full((n, self.width), float(value))

    def write_states(self, y):
        return _lists(y)


# ---------------------------------------------------------------- kernels
def _pick(maps, at):
    return tuple(m[at] for m in maps)


def composed(rule, maps, first: np.ndarray):
    """For every row the map of all rows from `first`, the number of its group's first row, up to itself."""
    at = np.arange(len(first))
    back = at - first
    maps = tuple(m.copy() for m in maps)
    reach, d = int(back.max(initial=0)), 1
    while d <= reach:
        on = np.flatnonzero(back >= d)
        for m, new in zip(maps, rule.compose(_pick(maps, on - d), _pick(maps, on)), strict=True):
            m[on] = new
        d *= 2
    return maps


def _groups(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Numbers of the rows that start a group of equal `names`."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, names: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(n)[row].as_py() for n in names)


def _walk(rows: DataFrame, group: Sequence[str], order: str, schema: T.StructType, body):
    """Runs `body` over rows of each group in order; groups are never split."""
    placed = rows.repartition(*group).sortWithinPartitions(*group, order)
    return placed.mapInArrow(body, schema)


def _fold(rule, rows, group, order):
    """One row per group: its maps composed."""
    names = list(group)
    out = names + list(rule.cols)
    schema = T.StructType([rows.schema[g] for g in names] + [T.StructField(c, k) for c, k in zip(rule.cols, rule.kinds, strict=True)])

    def body(batches):
        held = None  # key, key columns, map of a group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            starts = _groups(b, names)
            ends = np.append(starts[1:], b.num_rows)
            maps = _pick(composed(rule, rule.read(b), np.repeat(starts, ends - starts)), ends - 1)
            keys = [b.column(n).take(pa.array(starts)) for n in names]
            if held and held[0] == _key(b, names, 0):
                for m, new in zip(maps, rule.compose(held[2], _pick(maps, slice(0, 1))), strict=True):
                    m[:1] = new
            elif held:
                yield pa.RecordBatch.from_arrays([*held[1], *rule.write(held[2])], out)
            last = len(starts) - 1
            if last:
                yield pa.RecordBatch.from_arrays([*[k.slice(0, last) for k in keys], *rule.write(_pick(maps, slice(0, last)))], out)
            held = _key(b, names, b.num_rows - 1), [k.slice(last) for k in keys], _pick(maps, slice(last, None))
        if held:
            yield pa.RecordBatch.from_arrays([*held[1], *rule.write(held[2])], out)

    return _walk(rows.select(*names, order, *rule.cols), names, order, schema, body)


def _run(rule, rows, starts, group, order, init, keep, after=None, before=None):
    """`keep` columns of `rows`, and the states after and before each row under these names.  `starts`, if any, holds the state `_in` at
    the start of groups; the others start with `init`."""
    names = list(group)
    rows = rows.withColumn("_in", F.lit(None).cast(rule.type))
    if starts is not None:
        rows = rows.unionByName(starts.select(*names, F.lit(FIRST).cast("long").alias(order), "_in"), allowMissingColumns=True)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in (rows.schema[c] for c in keep)] + [T.StructField(c, rule.type) for c in (after, before) if c])
    # The rows that bring a state have no map of their own.
    rows = rows.withColumns({c: F.coalesce(c, F.array_repeat(F.lit(0).cast(k.elementType), rule.width) if isinstance(k, T.ArrayType) else F.lit(0).cast(k))
                             for c, k in zip(rule.cols, rule.kinds, strict=True)})

    def body(batches):
        held = None  # key and state at the end of the last group
        for b in batches:
            if not b.num_rows:
                continue
            starts_at = _groups(b, names)
            sizes = np.diff(np.append(starts_at, b.num_rows))
            maps = tuple(m.copy() for m in rule.read(b))
            brings = b.column(order).to_numpy(zero_copy_only=False) == FIRST
            if brings.any():
                for m, new in zip(maps, rule.constant(rule.states(b.column("_in").filter(pa.array(brings)))), strict=True):
                    m[brings] = new
            entry = rule.initial(init, len(starts_at))
            if held and held[0] == _key(b, names, 0):
                entry[:1] = held[1]
            y = rule.apply(composed(rule, maps, np.repeat(starts_at, sizes)), np.repeat(entry, sizes, axis=0))
            held = _key(b, names, b.num_rows - 1), y[-1:].copy()
            out = {after: y} if after else {}
            if before:
                out[before] = np.concatenate([y[:1], y[:-1]])
                out[before][starts_at] = entry
            fine = pa.array(~brings)
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(fine) for c in keep], *[rule.write_states(v[~brings]) for v in out.values()]], [*keep, *out])

    needed = list(dict.fromkeys([*names, order, *rule.cols, "_in", *keep]))
    return _walk(rows.select(*needed), names, order, schema, body)


def scan(df: DataFrame, rule, out: str, init, keys=KEYS, order=ORDER, starts: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """Adds `out`: the state after each row, and under `before` that before it.  `df` holds the rule's columns.  Streams start with
    `init`, those in `starts` (keys and `_in`) with the state given there."""
    keys = list(keys)
    n = segment_length(df.sparkSession)
    keep = [c for c in df.columns if c not in rule.cols]
    rows = df.withColumns({"_seg": segment_of(order, n), **{c: F.col(c).cast(k) for c, k in zip(rule.cols, rule.kinds, strict=True)}})
    seg = _fold(rule, rows, [*keys, "_seg"], order).withColumn("_sup", segment_of("_seg", FANOUT))
    sup = _fold(rule, seg, [*keys, "_sup"], "_seg")
    sup_in = _run(rule, sup, starts, keys, "_sup", init, [*keys, "_sup"], before="_in")
    seg_in = _run(rule, seg, sup_in, [*keys, "_sup"], "_seg", init, [*keys, "_seg"], before="_in")
    return _run(rule, rows, seg_in, [*keys, "_seg"], order, init, keep, out, before)


def clamped(df, gain, step=0.0, lo=float("-inf"), hi=float("inf")) -> DataFrame:
    """Puts the four columns of ClampedLinear on `df`."""
    def c(v):
        return (F.lit(v) if isinstance(v, (int, float)) else v).cast("double")
    return (df.withColumn("_gain", c(gain)).withColumn("_step", c(step))
            .withColumn("_lo", c(lo)).withColumn("_hi", c(hi)))


def decaying(df: DataFrame, gain, add) -> DataFrame:
    """Puts the two columns of Decay on `df`."""
    return df.withColumn("_gain", F.lit(float(gain)) if isinstance(gain, (int, float)) else gain).withColumn("_add", add)


# ---------------------------------------------------------------- decays of values that a segment makes itself
def _in_order(table: pa.Table, order: str) -> pa.Table:
    return table.sort_by(order).combine_chunks()


def _fade(rows: np.ndarray, gains, state: np.ndarray):
    """Adds to every row, in place, its gain times the one before; to the first row that of `state`."""
    for row, gain in zip(rows, gains):
        row += gain * state
        state = row


def _segments(rows, values, width, forward, backward, keys, order):
    """One row per segment: its number of frames, its last two places, the map of its forward decay (`_gain`, `_add`) and, if values decay
    `backward` too, what its first frame then holds (`_all`), and what without the last frame (`_but`); no state comes in for either."""
    array = T.ArrayType(T.DoubleType())
    numbers = [T.StructField(c, T.LongType()) for c in ("_part", "_n", "_top", "_next")]
    schema = T.StructType([*[rows.schema[k] for k in keys], *numbers, *[T.StructField(c, array) for c in ("_gain", "_add", "_all", "_but")]])
    none = np.zeros(width)

    def at_start(x):
        x = x.copy()
        _fade(x[::-1], itertools.repeat(backward), none)
        return x[:1] if len(x) else none[None]

    def fold(table):
        table = _in_order(table, order)
        n, place = table.num_rows, table[order].to_numpy()
        x = values(table)
        _fade(x, itertools.repeat(forward), none)
        ends = [np.array(forward ** n)[None], x[-1:], *([at_start(x), at_start(x[:-1])] if backward is not None else [none[None]] * 2)]
        known = [pa.array([v], pa.int64()) for v in (n, place[-1], place[-2] if n > 1 else None)]
        return pa.Table.from_arrays([*[table[c].combine_chunks().slice(0, 1) for c in (*keys, "_part")], *known, *[_lists(e) for e in ends]], schema.names)

    return rows.groupBy(*keys, "_part").applyInArrow(fold, schema)


def decayed_segments(frames: DataFrame, needed: Sequence[str], values, use, schema: T.StructType, forward: np.ndarray, backward: float | None = None,
                     before: bool = False, keys=KEYS, order=ORDER) -> DataFrame:
    """What `use` makes of a stream's segments and of values that decay from frame to frame through the whole stream, without any reach.

    `values` makes a matrix, one row per frame, of the columns `needed` of a segment; each value then takes its share `forward` of the
    frame before and, if `backward` is given, that share of the frame after; there the frame before the last takes nothing from the last one.
    `use` gets the segment, its decayed values and which rows are its own: with `before`, a copy of the frame before may be in
    front.  It returns a table of `schema`.

    Samples move twice, whatever the number of decays: values are made again where they are used, and never leave the task.  In
    between there is one row per segment.  A task holds one segment at a time."""
    keys, n, width = list(keys), segment_length(frames.sparkSession), len(forward)
    home = segment_of(order, n)
    some = list(dict.fromkeys([*keys, order, *needed]))
    segs = _segments(frames.select(*some).withColumn("_part", home), values, width, forward, backward, keys, order)
    segs = cut_lineage(scan(cut_lineage(segs), Decay(width, True), "_end", 0.0, keys, "_part", before="_from"))
    if backward is not None:
        segs = attach(segs, segs.groupBy(*keys).agg(F.max("_top").alias("_last")), keys, "_part")
        but = F.coalesce((F.col("_top") == F.col("_last")) & (F.col("_next") == F.col("_last") - 1), F.lit(False))
        share = [float(f * backward) for f in forward]
        # what the state before the segment adds to its first frame, by way of all frames
        way = F.transform(F.array(*[F.lit(s) for s in share]), lambda s: (F.lit(1.0) - F.pow(s, F.col("_n") - but.cast("int"))) / (F.lit(1.0) - s) * s / F.lit(float(backward)))
        came = F.zip_with("_from", way, lambda y, w: y * w)
        add = F.zip_with(F.when(but, F.col("_but")).otherwise(F.col("_all")), came, lambda x, y: x + y)
        gain = F.when(F.col("_top") >= F.col("_last") - 1, F.lit(0.0)).otherwise(F.pow(F.lit(float(backward)), F.col("_n")))
        segs = decaying(segs.withColumn("_rev", -F.col("_part")), gain, add)
        segs = cut_lineage(scan(segs, Decay(width), "_start", 0.0, keys, "_rev", before="_to"))
    states = segs.select(*keys, "_part", "_from", *(["_to", "_last"] if backward is not None else []))

    def run(table, state):
        table = _in_order(table, order)
        place = table[order].to_numpy()
        own = place // n == table["_part"].to_numpy()
        if not own.any() or not state.num_rows:
            return schema_arrow.empty_table()
        y = values(table)
        start = _matrix(state["_from"].combine_chunks(), width)[0]
        first = int(np.argmax(own))
        y[:first] = start
        _fade(y[first:], itertools.repeat(forward), start)
        if backward is not None:
            gains = np.where(place <= state["_last"][0].as_py() - 2, backward, 0.0)
            _fade(y[::-1], gains[::-1], _matrix(state["_to"].combine_chunks(), width)[0])
        return use(table, y, own)

    schema_arrow = to_arrow_schema(schema)
    part = F.explode(F.sequence(home, segment_of(F.col(order) + 1, n))) if before else home
    rows = frames.withColumn("_part", part)
    return rows.groupBy(*keys, "_part").cogroup(states.groupBy(*keys, "_part")).applyInArrow(run, schema)
