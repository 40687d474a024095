"""Phrase collocation mining on a prefix-free parse.

Parse: four words whose hash is divisible by CHUNK trigger a cut before the first of them.  A chunk reaches from one cut to
the next, plus the words after it that phrases begun before it may need (four at most, none beyond a piece's end).  Copies of a
passage are cut alike, so the dictionary of distinct chunks, with how often the parse holds each, is what is counted: a
phrase belongs to the chunk that owns its first word, so overlaps count once, and it counts as often as its chunk occurs.

Counting goes by length.  Phrases of k words are counted only where both phrases of k - 1 words in them are frequent, which a
Bloom filter of fixed size tells: it never hides a frequent phrase, and what it lets through is counted exactly.  Until
the end a phrase is a 64-bit hash of its words and language, with the number of one chunk that holds it; one last pass over the
dictionary reads the words of each frequent phrase from that chunk.  Expected pairs of phrases with one hash are n*n/2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm import bytewords
from framescope.llm.storage import broadcast_if_small, col, lean, stored

LONGEST = 5
CHUNK = 32  # one window in so many triggers a cut
OWN_WORDS = 4096  # a chunk without a trigger is cut after so many words
BATCH_BYTES = 4 << 20  # of chunks, counted together before their phrases are shuffled
FILTER_BITS = 1 << 26
SMALL_LANGS = 100_000
TOP_ROWS = 200_000  # rows that one sorting task of the ranking gets
SALT = np.uint64(0xA0761D6478BD642F)
BREAKS = b".,;:!?\n\x0b\x0c\r"


def _word_bytes(breaks: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(b" \t" + breaks)] = False
    return t


def _next(chain: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of `length` words from those of length - 1 (`chain`) and of single words."""
    return bytewords.mixed(chain[:-1] + bytewords.mixed(h[length - 1:] ^ SALT)) if len(chain) > 1 else chain[:0]


# ---------------------------------------------------------------- parse
def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(owner, own words, chunk) of the parse of lower-cased texts.  In a chunk words are parted by a blank, pieces by a line feed,
    and a tab stands before the first word that the next chunk owns."""
    w = bytewords.Words(texts, _word_bytes(BREAKS))
    n = len(w.begin)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    h = w.word_hashes()
    is_break = np.zeros(256, np.int64)
    is_break[list(BREAKS)] = 1
    seen = np.cumsum(is_break[w.data])
    first = np.ones(n, bool)  # of a text
    first[1:] = w.owner[1:] != w.owner[:-1]
    piece = first.copy()
    piece[1:] |= seen[w.begin[1:] - 1] != seen[w.end[:-1] - 1]
    window = h
    for length in range(2, LONGEST):
        window = _next(window, h, length)
    cut = first.copy()
    inside = w.owner[:len(window)] == w.owner[n - len(window):]
    cut[:len(window)] |= inside & (window % np.uint64(CHUNK) == 0)
    starts = np.flatnonzero(cut)
    reach = np.diff(np.append(starts, n))
    more = (reach - 1) // OWN_WORDS
    if more.any():
        at = np.repeat(starts, more)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
        cut[at + nth * OWN_WORDS] = True
        starts = np.flatnonzero(cut)
    own_end = np.append(starts[1:], n)
    # Words after the own ones: up to LONGEST - 1, while they stay in the piece.
    end, open_ = own_end.copy(), np.ones(len(starts), bool)
    for _ in range(LONGEST - 1):
        open_ &= end < n
        open_[open_] = ~piece[end[open_]]
        end += open_
    # The words again, each followed by one separator, in one run of bytes.
    size = w.end - w.begin + 1
    to = np.cumsum(size) - size
    flat = np.append(w.data, np.uint8(32))[np.arange(int(size.sum())) + np.repeat(w.begin - to, size)]
    mark = np.where(piece, 10, np.where(cut, 9, 32)).astype(np.uint8)
    flat[to[1:] - 1] = mark[1:]
    body = flat.tobytes()
    a, z = to[starts].tolist(), (to[end - 1] + size[end - 1] - 1).tolist()
    return w.owner[starts], own_end - starts, [body[i:j] for i, j in zip(a, z, strict=True)]


def _text_groups(column: pa.Array):
    """(number of the first, lower-cased texts) of runs of texts of about GROUP_BYTES bytes."""
    first, some, held = 0, [], 0
    for i, t in enumerate(column):
        some.append(t.as_py().lower())
        held += len(some[-1])
        if held >= bytewords.GROUP_BYTES:
            yield first, some
            first, some, held = i + 1, [], 0
    if some:
        yield first, some


def dictionary(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, chunk, own (its words), freq (how often the parse holds it)."""
    base = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            seen: dict[tuple[str, bytes], list[int]] = {}
            held = 0
            for i, texts in _text_groups(b.column(1)):
                owner, own, chunk = chunks_of(texts)
                for o, n, c in zip(owner.tolist(), own.tolist(), chunk, strict=True):
                    entry = seen.setdefault((langs[i + o], c), [n, 0])
                    entry[1] += 1
                    held += 0 if entry[1] > 1 else len(c)
                if held > BATCH_BYTES:
                    yield rows(seen)
                    seen, held = {}, 0
            if seen:
                yield rows(seen)

    def rows(seen):
        keys, values = zip(*seen.items(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
                                           pa.array([v[0] for v in values], pa.int32()), pa.array([v[1] for v in values], pa.int64())], ["lang", "chunk", "own", "freq"])

    return base.mapInArrow(lean(run), "lang string, chunk binary, own int, freq long").groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


# ---------------------------------------------------------------- filters of fixed size
def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    y = bytewords.mixed(x)
    return (y & np.uint64(bits - 1)).astype(np.int64), (y >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def bloom(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter (two places a value) as bytes.  The tasks merge their places into 64-bit words, of which at most bits / 64
    reach the driver, however many values there are."""
    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "mask"])

    words = hashes.select(column).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint8)


def within(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = _places(x, len(filter_) * 8)
    return ((filter_[a >> 3] >> (a & 7).astype(np.uint8)) & (filter_[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


# ---------------------------------------------------------------- counting
class Phrases:
    """Phrases of a group of chunks by length: hash of words and language, place of the first word."""

    def __init__(self, chunks: list[bytes], lang: np.ndarray, own: np.ndarray):
        w = bytewords.Words(chunks, _word_bytes(b"\n"))
        n = len(w.begin)
        seen = np.cumsum(w.data == 10)
        start = np.ones(n, bool)
        start[1:] = (w.owner[1:] != w.owner[:-1]) | (seen[w.begin[1:] - 1] != seen[w.end[:-1] - 1])
        self.words, self.owner, self.piece = w, w.owner, np.cumsum(start)
        sizes = np.bincount(w.owner, minlength=len(chunks))
        self.owned = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) < own[w.owner]
        self.lang, self.h = lang[w.owner], w.word_hashes()

    def ids(self, longest: int):
        """(length, hashes, is a phrase inside one piece) for lengths 1 to `longest`, one entry per place."""
        chain = self.h
        for k in range(1, longest + 1):
            if k > 1:
                chain = _next(chain, self.h, k)
            m = len(chain)
            yield k, bytewords.mixed(chain + self.lang[:m] + np.uint64(k)), self.piece[:m] == self.piece[len(self.piece) - m:]


def _groups(b: pa.RecordBatch):
    """(first, end, Phrases) for groups of bounded size of a batch with chunk, lang_hash and own."""
    chunks = b.column("chunk").to_pylist()
    lang, own = b.column("lang_hash").to_numpy().view(np.uint64), b.column("own").to_numpy()
    for i, j in bytewords.groups(chunks):
        yield i, j, Phrases(chunks[i:j], lang[i:j], own[i:j])


def counted(chunks: DataFrame, lengths: tuple[int, ...], least: int, known: np.ndarray | None) -> DataFrame:
    """h, f, k, witness of the phrases of these lengths with f >= least.  `known` is a filter of the frequent phrases one
    shorter than the shortest of `lengths`; phrases with a part outside of it are not frequent."""
    shared = None if known is None else chunks.sparkSession.sparkContext.broadcast(known)
    low, high = min(lengths), max(lengths)

    def total(parts):
        h, f, k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h = h[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(f[order], at)), pa.array(k[order][at]),
                                           pa.array(np.minimum.reduceat(c[order], at))], ["h", "f", "k", "witness"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            freq, witness = b.column("freq").to_numpy(), b.column("witness").to_numpy()
            for i, _, p in _groups(b):
                held += len(p.words.data)
                parts_ok = None
                for k, h, whole in p.ids(high):
                    if k == low - 1 and shared is not None:
                        parts_ok = whole & within(shared.value, h)
                    if k < low:
                        continue
                    ok = whole & p.owned[:len(h)]
                    if parts_ok is not None:
                        for s in range(k - low + 2):
                            ok &= parts_ok[s:s + len(h)]
                    if k in lengths:
                        at = np.flatnonzero(ok)
                        if len(at):
                            o = p.owner[at] + i
                            parts.append((h[at], freq[o], np.full(len(at), k, np.int8), witness[o]))
                if held >= BATCH_BYTES and parts:
                    yield total(parts)
                    parts, held = [], 0
        if parts:
            yield total(parts)

    rows = chunks.mapInArrow(lean(run), "h long, f long, k byte, witness int")
    return rows.groupBy("h").agg(F.sum("f").alias("f"), F.first("k").alias("k"), F.min("witness").alias("witness")).filter(F.col("f") >= least)


def spelled(chunks: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """lang, phrase, k, f: every frequent phrase with its words, read from the chunk that is its witness."""
    def code(h, witness):
        return bytewords.mixed(h ^ bytewords.mixed(witness.astype(np.int64).view(np.uint64)))

    def coded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(code(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()).view(np.int64))], ["code"])

    filter_ = bloom(frequent.select("h", "witness").mapInArrow(coded, "code long"), "code", bits)
    shared = chunks.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for b in batches:
            langs, witness = b.column("lang"), b.column("witness").to_numpy()
            for i, _, p in _groups(b):
                c = witness[p.owner + i]
                data, found = p.words.data.tobytes(), {}
                for k, h, whole in p.ids(LONGEST):
                    ok = whole & p.owned[:len(h)]
                    at = np.flatnonzero(ok)
                    at = at[within(shared.value, code(h[at], c[at]))]
                    for x, hx in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                        if (hx, int(c[x])) not in found:
                            found[hx, int(c[x])] = (langs[int(p.owner[x]) + i].as_py(), data[p.words.begin[x]:p.words.end[x + k - 1]].replace(b"\t", b" "))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()),
                                                      pa.array([v[0] for v in found.values()], pa.string()), pa.array([v[1] for v in found.values()], pa.binary())],
                                                     ["h", "witness", "lang", "phrase"])

    words = chunks.mapInArrow(lean(run), "h long, witness int, lang string, phrase binary").join(frequent, ["h", "witness"])
    return words.groupBy("h").agg(F.min("lang").alias("lang"), F.min("phrase").cast("string").alias("phrase"), F.first("k").cast("int").alias("k"), F.first("f").alias("f")).drop("h")


# ---------------------------------------------------------------- scores
def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words and more that no longer one of equal count holds.

    Of longer phrases only those with one word more are looked at: if one holds the phrase as often, so does every part of
    it between the two.  Scores are computed with decimals of 38 digits."""
    cand = phrases.filter("k > 1")
    longer = cand.filter("k > 2")
    parts = longer.select("lang", F.expr("substring_index(phrase, ' ', k - 1)").alias("phrase"), "f").unionByName(longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - k)").alias("phrase"), "f"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    cuts = cand.join(most, ["lang", "phrase"], "left").filter(F.coalesce("most", F.lit(0)) < F.col("f")).drop("most")
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(broadcast_if_small(totals, SMALL_LANGS), "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide["a"]).cast("decimal(19,0)") * wide["n"], wide["l"] * wide["r"])
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language by score, count and phrase, with their rank.  A language is first ranked in as many random
    parts as its rows need, what is left of them in fewer parts, and so on, so no task sorts a language whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // max(TOP_ROWS, 2 * top))
    while parts > 1:
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("rank")
        parts = -(-parts * top // max(TOP_ROWS, 2 * top))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to 5 words of each language.

    Texts are lower-cased in A-Z and cut at `.,;:!?` and line ends into pieces, those at blanks and tabs into words.  n counts the
    language's words, a, l and r the occurrences of the phrase and of the two parts of its weakest cut, score is
    floor(1000*a*n / (l*r)).  Phrases with a < least, or within a longer one as frequent, are left out.  Ties of score and a go by
    the phrase's bytes.

    A null language is `und`; null and empty texts have no words; repeated rows all count; languages without such phrases and an
    empty table give no rows; other columns are ignored.  Very long texts are read whole, in chunks."""
    chunks = stored(dictionary(docs, text, lang), "phrase-chunks")
    totals = stored(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n")), "phrase-totals")
    chunks = chunks.withColumns({"lang_hash": F.xxhash64("lang"), "witness": F.xxhash64("lang", "chunk").bitwiseAND(0x7FFFFFFF).cast("int")})
    found, known = None, None
    for lengths in ((1,), (2,), (3,), (4, 5)):
        rows = stored(counted(chunks, lengths, least, known), "phrase-counts")
        found = rows if found is None else found.unionByName(rows)
        known = bloom(rows, "h", filter_bits)
    phrases = stored(spelled(chunks, found, filter_bits), "phrase-words")
    best = stored(scored(phrases, totals), "phrase-scores")
    return ranked(best, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAM = "SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1,2,3,4,5]) AS k) WHERE len(ws) >= k)"
SQL = f"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pc),
n AS (SELECT lang, sum(len(ws))::bigint AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM ({_GRAM}) GROUP BY ALL HAVING count(*) >= 100),
g AS MATERIALIZED (SELECT lang, k, p, f, string_split(p, ' ') AS ws FROM f),
inner_ AS (SELECT lang, k - 1 AS k, unnest([array_to_string(ws[1:k-1], ' '), array_to_string(ws[2:k], ' ')]) AS p, f AS most FROM g WHERE k > 2),
m AS (SELECT lang, k, p, max(most) AS most FROM inner_ GROUP BY ALL),
c AS (SELECT g.lang, g.k, g.p, g.f AS a, unnest(range(1, g.k)) AS cut, g.ws FROM g LEFT JOIN m USING (lang, k, p) WHERE g.k > 1 AND coalesce(most, 0) < g.f),
s AS (SELECT c.lang, c.p, c.a, c.cut, x.f AS l, y.f AS r, n.n, ((1000::hugeint * c.a * n.n) // (x.f::hugeint * y.f))::bigint AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.p = array_to_string(c.ws[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.p = array_to_string(c.ws[c.cut+1:c.k], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS best FROM s),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score FROM b WHERE best = 1)
SELECT * FROM r WHERE rank <= 2000
"""
