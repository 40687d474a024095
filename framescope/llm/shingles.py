"""Sets of word shingles of many texts at once, and the reduction of a corpus to the documents that can have a near copy.

Shuffling every shingle as a row would take several times the input.  Here a batch's shingles travel sorted, cut by
hash range, as differences: six bytes each.  Whoever gets a range sees which shingles occur twice or more and sends only
those back, grouped by batch.  A document of n shingles can be similar to another one only if a share `percent` of them is
shared, so all others are done, and for the rest their shared shingles are all that any later step needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import bytewords
from framescope.llm.storage import col, lean

WORDS = 5
KEEP_BITS = np.uint64(16)  # shingles are compared by the upper 48 bits of their hashes
SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each text's distinct shingles, sorted by both.  Fewer than WORDS words are one shingle of their own length."""
    w = bytewords.Words(texts, bytewords.white_space())
    h = w.word_hashes()
    sizes = np.bincount(w.owner, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    out, owners = [], []
    chain = h
    for length in range(1, WORDS + 1):
        if length > 1:
            chain = bytewords.mixed(chain[:-1] + bytewords.mixed(h[length - 1:] ^ SALT)) if len(h) >= length else chain[:0]
        if length == WORDS:
            at = np.flatnonzero(w.owner[:len(chain)] == w.owner[len(w.owner) - len(chain):]) if len(chain) else np.empty(0, np.int64)
        else:
            at = first[sizes == length]
        owners.append(w.owner[at])
        out.append(bytewords.mixed(chain[at] + np.uint64(length)))
    owner, sh = np.concatenate(owners), np.concatenate(out) >> KEEP_BITS
    order = np.lexsort((sh, owner))
    owner, sh = owner[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], sh[new]


def set_keys(owner: np.ndarray, sh: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, key, second key) of every set: equal sets have equal keys, an empty one has key 0."""
    n = np.bincount(owner, minlength=n_texts)
    keys = []
    for salt in (np.uint64(0), SALT):
        sums = np.zeros(len(sh) + 1, np.uint64)
        np.cumsum(bytewords.mixed(sh ^ salt), out=sums[1:])
        ends = np.cumsum(n)
        keys.append(np.where(n > 0, bytewords.mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64)), np.uint64(0)).view(np.int64))
    return n, keys[0], keys[1]


def lowered(t: bytes) -> bytes:
    """A-Z only."""
    return t.lower()


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, n_shingles, set_key, set_check for every row."""
    base = docs.select(col(key).alias("doc"), F.coalesce(col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            parts = [set_keys(*shingle_sets(some), len(some)) for some in text_batches([b.column(1)], bytewords.GROUP_BYTES)]
            n, k, c = (np.concatenate([*(p[i] for p in parts), np.empty(0, np.int64)]) for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k), pa.array(c)], ["doc", "n_shingles", "set_key", "set_check"])

    return base.mapInArrow(lean(run), f"doc {base.schema['doc'].dataType.simpleString()}, n_shingles long, set_key long, set_check long")


# ---------------------------------------------------------------- packed ranges
def packed(sh: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as differences of 4 bytes, or of 8 where one needs more."""
    d = np.diff(sh, prepend=np.uint64(0))
    first, rest = d[:1], d[1:]
    if len(rest) and rest.max() >= 1 << 32:
        return b"\x08" + d.tobytes()
    return b"\x04" + first.tobytes() + rest.astype(np.uint32).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    if body[0] == 8:
        return np.cumsum(np.frombuffer(body, np.uint64, offset=1), dtype=np.uint64)
    d = np.append(np.frombuffer(body, np.uint64, 1, 1), np.frombuffer(body, np.uint32, offset=9).astype(np.uint64))
    return np.cumsum(d, dtype=np.uint64)


def text_batches(columns, size: int):
    """Lists of lower-cased texts of about `size` bytes together, at most 60,000 in one."""
    some, held = [], 0
    for column in columns:
        for t in column:
            some.append(lowered(t.as_py()))
            held += len(some[-1])
            if held >= size or len(some) == 60_000:
                yield some
                some, held = [], 0
    if some:
        yield some


def runs(batches, names: tuple[str, ...]):
    """Groups of rows of equal first column, in a stream sorted by it: (value, list of rows)."""
    value, rows = None, []
    for b in batches:
        for row in zip(*[b.column(n).to_pylist() for n in names], strict=True):
            if rows and row[0] != value:
                yield value, rows
                rows = []
            value = row[0]
            rows.append(row[1:])
    if rows:
        yield value, rows


def shared_sets(docs: DataFrame, n_total: int, percent: int, key: str, text: str, range_size: int = 300_000, batch_bytes: int = 4 << 20) -> DataFrame:
    """set_key, set_check, n_shingles, shared (array of the shingles that another document has too), for documents of which at least
    `percent` of 100 are shared.  Rows of one batch with equal sets count once.

    Three steps: cut by hash range, count within a range (about `range_size` shingles, as `n_total` are spread over as many
    ranges as needed), gather by batch (about `batch_bytes` of text, or 60,000 documents)."""
    n_ranges = max(1, -(-n_total // range_size))
    base = docs.select(F.coalesce(col(text), F.lit("")).cast("binary").alias("t"))
    names = ["range", "batch", "owners", "body"]
    types = (pa.int64(), pa.string(), pa.binary(), pa.binary())

    def cut(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        limits = np.array([-(-(r << 48) // n_ranges) for r in range(n_ranges + 1)], np.uint64)
        for some in text_batches((b.column(0) for b in batches), batch_bytes):
            pieces, sets, seen = [], [], {}
            for i, j in bytewords.groups(some):
                owner, sh = shingle_sets(some[i:j])
                n, k, c = set_keys(owner, sh, j - i)
                place = np.full(j - i, -1, np.int64)
                for d in np.flatnonzero(n).tolist():
                    name = int(k[d]), int(c[d])
                    if name not in seen:
                        seen[name] = place[d] = len(sets)
                        sets.append((*name, int(n[d])))
                own = place[owner]
                pieces.append((own[own >= 0].astype(np.uint16), sh[own >= 0]))
            if not sets:
                continue
            owner, sh = (np.concatenate([p[x] for p in pieces]) for x in (0, 1))
            order = np.argsort(sh)
            owner, sh = owner[order], sh[order]
            edges = np.searchsorted(sh, limits)
            name, number = f"{part}-{number}", number + 1
            rows = [(-1, name, b"", np.array(sets, np.int64).tobytes())]
            rows += [(r, name, owner[a:z].tobytes(), packed(sh[a:z])) for r, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def count(batches):
        for r, rows in runs(batches, ("range", "batch", "owners", "body")):
            if r < 0:
                for name, owners, body in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([owners]), pa.array([body])], ["batch", "range", "owners", "body"])
                continue
            lists = [unpacked(body) for _, _, body in rows]
            sh = np.concatenate(lists)
            owner = np.concatenate([np.frombuffer(o, np.uint16) for _, o, _ in rows])
            source = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
            order = np.argsort(sh, kind="stable")
            s = sh[order]
            same = s[1:] == s[:-1]
            twice = order[np.append(same, False) | np.append(False, same)]
            twice = np.sort(twice)
            edges = np.searchsorted(source[twice], np.arange(len(rows) + 1))
            out = [(rows[i][0], r, owner[twice[a:z]].tobytes(), packed(sh[twice[a:z]])) for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if z > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (types[1], types[0], types[2], types[3]), strict=True)], ["batch", "range", "owners", "body"])

    def gather(batches):
        for _, rows in runs(batches, ("batch", "range", "owners", "body")):
            sets = np.frombuffer(next(b for r, _, b in rows if r < 0), np.int64).reshape(-1, 3)
            parts = [(np.frombuffer(o, np.uint16), unpacked(b)) for r, o, b in rows if r >= 0]
            if not parts:
                continue
            owner, sh = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
            order = np.lexsort((sh, owner))
            owner, sh = owner[order], sh[order].astype(np.int64)
            n = np.bincount(owner, minlength=len(sets))
            ends = np.cumsum(n)
            keep = np.flatnonzero((n * 100 >= sets[:, 2] * percent) & (n > 0))
            for at in range(0, len(keep), 512):
                some = keep[at:at + 512]
                lists = pa.array([sh[ends[d] - n[d]:ends[d]] for d in some], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(sets[some, j]) for j in range(3)], lists], ["set_key", "set_check", "n_shingles", "shared"])

    ranges = base.mapInArrow(lean(cut), "range long, batch string, owners binary, body binary").repartition("range", F.when(F.col("range") < 0, F.col("batch"))).sortWithinPartitions("range")
    found = ranges.mapInArrow(lean(count), "batch string, range long, owners binary, body binary").repartition("batch").sortWithinPartitions("batch", "range")
    return found.mapInArrow(lean(gather), "set_key long, set_check long, n_shingles long, shared array<long>")
