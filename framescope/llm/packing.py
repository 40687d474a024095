"""Token-id output: best-fit-decreasing packing of documents into rows of fixed length.

Every task packs what it reads, in groups of bounded size, so nothing is shuffled.  Documents longer than a row are split
into pieces without loss.  Pieces are placed in decreasing length into the fullest row that still has room; a segment
tree over capacities finds it in logarithmic time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col, lean

PACKED = ("block string, row int, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
          "input_ids binary, position_ids binary")


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RoomTree:
    """Counts open rows by the room they have left; finds the least room that is at least what is asked for."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int):
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def best_fit(self, need: int) -> int:
        """The least room >= need among open rows, or -1."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at & 1 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers; equal lengths keep their order, the earliest row with that room is used last."""
    tree, with_room, rows = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.best_fit(lengths[i])
        if room < 0:
            rows.append([i])
            row, room = len(rows) - 1, capacity
        else:
            row = with_room[room].pop()
            tree.add(room, -1)
            rows[row].append(i)
        left = room - lengths[i]
        if left:
            with_room.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def pack(docs: DataFrame, vocabulary: str, pattern: str, context: int = 2048, end_id: int = 50256, group_tokens: int = 1 << 20,
         pad_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`vocabulary` is a file of `base64 rank` lines on the driver; without special tokens, their strings are ordinary text.

    One row per packed row: block and row number in it, n_tokens (without padding), doc_ids and pieces (piece numbers within
    their documents) in order, cu_seqlens (0, then the end of each segment), input_ids (little-endian int32, `context` of
    them, padded with `pad_id`) and position_ids (the same shape; they restart at every segment).

    Every document gets `end_id` after its tokens, so null and empty texts are packed as that one token.  A null key stays
    null in doc_ids.  Repeated rows are packed each on its own, ties keep the order of reading.  An empty table gives no rows; other
    columns are ignored.  A task holds at most about `group_tokens` tokens and one document at a time; which documents
    share a row depends on how the table is read, and a retried task packs its part in the same way.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    base = docs.select(col(key).cast("long").alias("k"), F.coalesce(col(text), F.lit("")).alias("t"))

    def run(batches):
        import tiktoken
        from pyspark import TaskContext
        encode = tiktoken.Encoding("ordinary", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        part, group, held, keys, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            sizes = np.array([len(x) for x in ids])
            n_pieces = -(-sizes // context)
            owner = np.repeat(np.arange(len(ids)), n_pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            lengths = np.minimum(sizes[owner] - number * context, context)
            rows = best_fit_decreasing(lengths.tolist(), context)
            for start in range(0, len(rows), 128):
                out = {n: [] for n in ("block", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids")}
                for r in range(start, min(start + 128, len(rows))):
                    parts = rows[r]
                    ends = np.cumsum([0, *lengths[parts].tolist()])
                    row, pos = np.full(context, pad_id, "<i4"), np.zeros(context, "<i4")
                    for p, a, z in zip(parts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        first = int(number[p]) * context
                        row[a:z] = ids[owner[p]][first:first + z - a]
                        pos[a:z] = np.arange(z - a)
                    for name, value in zip(out, (f"{part}-{group}", r, int(ends[-1]), [keys[owner[p]] for p in parts], number[parts].tolist(), ends.tolist(), row.tobytes(), pos.tobytes()), strict=True):
                        out[name].append(value)
                types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(np.array([*encode(t.as_py()), end_id], "<i4"))
                keys.append(k.as_py())
                held += len(ids[-1])
                if held >= group_tokens:
                    yield from flush()
                    keys, ids, held, group = [], [], 0, group + 1
        if ids:
            yield from flush()

    return base.mapInArrow(lean(run), PACKED)


def write_packed(packed: DataFrame, folder: str) -> None:
    """Parquet files of the packed rows; `input_ids` of a file's rows, end to end, are its id matrix."""
    packed.write.parquet(folder)
