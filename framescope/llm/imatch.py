"""Document fingerprints by I-Match with randomised lexicons.

A term belongs to the lexicon if its inverse document frequency lies in a band.  A text's distinct lexicon terms, sorted, are
hashed once per randomised subset of the lexicon.  The subsets' densities fall in equal ratios from all of the lexicon to a
2048th, so that short and long texts alike have subsets in which few of their terms fall; those are the ones that
survive an edit.  Every part of a fingerprint carries a hash and the number of terms behind it, and parts weigh by one
over it when two fingerprints are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import bytewords
from framescope.llm.storage import col

PARTS, SPARSEST = 64, 11
FACTORS = bytewords.mixed(np.arange(1, PARTS + 1, dtype=np.uint64)) | np.uint64(1)
SHARES = np.array([min(int(2.0 ** (64 - SPARSEST * p / (PARTS - 1))), 2 ** 64 - 1) for p in range(PARTS)], np.uint64)
RARE, COMMON = 1 / 2000, 1 / 20  # the band, as shares of documents: idf from ln 20 to ln 2000


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct lower-case words of each text, sorted by both."""
    w = bytewords.Words(texts, bytewords.letters(digits=True))
    h = w.word_hashes()
    order = np.lexsort((h, w.owner))
    owner, h = w.owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (its hash) and df over all documents; counted per Arrow batch before the shuffle."""
    base = docs.select(F.coalesce(col(text), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            texts = [lowered(t) for t in b.column(0).to_pylist()]
            found = [terms_of(texts[i:j])[1] for i, j in bytewords.groups(texts)]
            term, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return base.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON, text: str = "text", limit: int = 4_000_000) -> np.ndarray:
    """Sorted hashes of the terms in the band.  As each has a share `rare` of the documents at least, there are at most
    (mean distinct terms of a document) / `rare` of them, whatever the size of the corpus; over `limit` is an error."""
    n = docs.count()
    band = document_frequencies(docs, text).filter((F.col("df") >= rare * n) & (F.col("df") <= max(common * n, 1)))
    rows = band.select("term").limit(limit + 1).toPandas()["term"].to_numpy(np.int64)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms in the band; raise `rare`")
    return np.sort(rows.view(np.uint64))


def fingerprints(texts: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, term counts), each of shape (texts, PARTS).  Without a lexicon term all terms of a text count, without any term
    its bytes."""
    owner, term = terms_of(texts)
    if len(words):
        at = np.minimum(np.searchsorted(words, term), len(words) - 1)
        known = words[at] == term
    else:
        known = np.zeros(len(term), bool)
    has = np.bincount(owner[known], minlength=len(texts)) > 0
    use = known | ~has[owner]
    owner, term = owner[use], term[use]
    hashes, counts = np.zeros((len(texts), PARTS), np.uint64), np.zeros((len(texts), PARTS), np.int64)
    for p in range(PARTS):
        member = np.flatnonzero(term * FACTORS[p] <= SHARES[p])
        o = owner[member]
        first = np.flatnonzero(np.diff(o, prepend=-1))
        counts[:, p] = np.bincount(o, minlength=len(texts))
        if len(first):
            # The terms are sorted and distinct, so chaining them by position gives one hash per set.
            place = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
            hashes[o[first], p] = bytewords.mixed(np.add.reduceat(bytewords.mixed(term[member] + place.astype(np.uint64)), first))
    for i in np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0):
        h = bytewords.Words([texts[i]], np.ones(256, bool), b"\n")
        hashes[i] = bytewords.mixed(h.hashes(np.array([0]), np.array([len(texts[i])])) + np.arange(PARTS, dtype=np.uint64))
        counts[i] = 1
    return hashes >> np.uint64(40), np.minimum(counts, 255)


def shown(hashes: np.ndarray, counts: np.ndarray) -> list[str]:
    """Per text, 8 hexadecimal digits per part: 6 of the hash and 2 of the number of terms (255 stands for more)."""
    return [row.tobytes().hex() for row in ((hashes << np.uint64(8)) | counts.astype(np.uint64)).astype(">u4")]


def likeness(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """0 to 1: the weight of the parts that agree, among those in which either side has a term."""
    most = np.maximum(ca, cb)
    weight = np.where(most > 0, 1 / np.maximum(most, 1), 0)
    same = (ha == hb) & (ca == cb)
    return (weight * same).sum(1) / np.maximum(weight.sum(1), 1e-300)


# ---------------------------------------------------------------- each text next to an edited version of itself
def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_report(docs: DataFrame, block_rows: int = 4096, most_blocks: int = 8192, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, comparing every text with its edited
    version and with the next text by descending key (after the last, the first).

    Null and empty texts are empty; equal keys come in the order of a hash of the text, null keys last; repeated rows stand
    for themselves.  A table of one row is its own neighbour, an empty one gives no rows; other columns are ignored.
    Keys are cut into blocks of about `block_rows` rows by approximate quantiles (not more than `most_blocks` numbers reach the
    driver).  A block also gets the first row of the next one; texts are compressed before the one shuffle they take,
    and a task walks its rows in order, holding a few megabytes.
    """
    words = lexicon(docs, text=text)
    k = F.coalesce(col(key).cast("long"), F.lit(-(1 << 63)))
    n = docs.count()
    blocks = max(1, min(most_blocks, n // block_rows))
    cuts = docs.agg(F.percentile_approx(k, [i / blocks for i in range(1, blocks)], 10 * most_blocks)).first()[0] if blocks > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    def numbered(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            block = np.searchsorted(cuts, keys, side="left")
            which, first = np.unique(block, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([int(keys[block == w].max()) for w in which], pa.int64())], ["block", "top"])

    tops = dict(docs.select(k.alias("k")).mapInArrow(numbered, "block int, top long").groupBy("block").agg(F.max("top")).collect())
    ordered = sorted(tops)
    above = {b: ordered[(i + 1) % len(ordered)] for i, b in enumerate(ordered)}  # the highest block's first row follows the lowest block

    def routed(batches):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            block = np.searchsorted(cuts, keys, side="left").tolist()
            out = [[], [], [], [], []]
            for key_, tie, own, t in zip(keys.tolist(), b.column(2).to_pylist(), block, texts, strict=True):
                body = squeeze.compress(t)
                copies = [(own, False)] + ([(above[own], True)] if key_ == tops[own] else [])
                for to, halo in copies:
                    for column, v in zip(out, (to, halo, key_, tie, body), strict=True):
                        column.append(v)
                if len(out[0]) >= 2048:
                    yield routed_batch(out)
                    out = [[], [], [], [], []]
            yield routed_batch(out)

    def routed_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "halo", "k", "tie", "body"])

    t = F.coalesce(col(text), F.lit(""))
    moved = (docs.select(k.alias("k"), t.cast("binary").alias("t"), F.xxhash64(t).alias("tie")).mapInArrow(routed, "block int, halo boolean, k long, tie long, body binary")
             .repartition("block").sortWithinPartitions("block", "halo", F.col("k").desc(), "tie"))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def compared(batches):
        import hashlib
        names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def finish(pairs):
            """pairs: (key, text, next text), in which each next text is the following pair's text unless a block ends there."""
            texts, slots, nexts = [], {}, []
            for i, (_, own, _) in enumerate(pairs):
                slots[id(own)] = i
                texts.append(lowered(own))
            for _, _, following in pairs:
                if id(following) not in slots:
                    slots[id(following)] = len(texts)
                    texts.append(lowered(following))
                nexts.append(slots[id(following)])
            changed = [edited(own, following) for _, own, following in pairs]
            first = len(texts)
            h, c = fingerprints(texts + [lowered(x) for x in changed], shared.value)
            own, other, mod = np.arange(len(pairs)), np.array(nexts), first + np.arange(len(pairs))
            marks = shown(h, c)
            columns = [pa.array([None if p[0] == -(1 << 63) else p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
                       pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]), pa.array([marks[i] for i in own]), pa.array([marks[i] for i in mod]),
                       pa.array(likeness(h[own], c[own], h[mod], c[mod])), pa.array(likeness(h[own], c[own], h[other], c[other]))]
            return pa.RecordBatch.from_arrays(columns, names)

        import zstandard
        expand = zstandard.ZstdDecompressor()
        waiting, pairs, size = None, [], 0
        for b in batches:
            for block, halo, key_, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if waiting and waiting[0] == block and waiting[1]:
                    continue  # more rows with the key of the first halo row
                own = expand.decompress(body).decode("utf-8", "surrogatepass")
                if waiting and waiting[0] == block and not waiting[1]:
                    pairs.append((waiting[2], waiting[3], own))
                    size += len(own)
                    if size >= bytewords.GROUP_BYTES:
                        yield finish(pairs)
                        pairs, size = [], 0
                waiting = (block, halo, key_, own)
        if pairs:
            yield finish(pairs)

    schema = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return moved.mapInArrow(compared, schema).withColumnRenamed("k", key)
