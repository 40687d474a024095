"""Benchmark decontamination with SimHash windows, on DataFrame operations only.

Every benchmark item is looked for in windows of its own length in words.  A window and an item are 64-bit SimHashes of their
five-word shingles, each shingle with the number of its occurrence, which makes bags sets: so the angle that a fingerprint
measures follows the weighted Jaccard similarity, long runs of one word included.  Fingerprints of equal window length are cut
into radius + 1 blocks, and two within the radius agree in at least one of them, so the equi-join on (length, block, bits)
finds all pairs within the radius.  Each is then verified by the weighted Jaccard similarity of the shingles themselves.

Shingles are 64-bit hashes of their words, made once per text; windows are slices of that array.

Only windows that share a shingle with an item of their length are fingerprinted.  That loses nothing, as others have
similarity 0, and a similarity of t needs 2t/(1+t) of the item's shingles, which is counted per document first.  Starts
are those that line a shared shingle up with its first or last place in the item, and all starts between two that are two item lengths
apart or less: a window that lines up with none of its shared shingles lies between two such starts, or the nearest
one holds all its shared shingles too.

The expected distance at similarity 0.8 is 10 bits with a deviation of 3; the radius of 24 leaves a miss about five deviations out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.storage import broadcast_if_small, col, stored

SHINGLE, RADIUS, PERCENT = 5, 24, 80
SMALL_ITEMS, SMALL_DOCUMENTS = 2_000_000, 200_000
STRETCH = 4096
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for null or empty texts."""
    t = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(F.length(t) > 0, F.split(t, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words of the array column `words`."""
    run = ", ".join(f"get({words}, i + {j})" for j in range(size))
    return F.expr(f"if(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({run})), array())")


def bag(hashes: str) -> Column:
    """The hashes of the sorted array column `hashes` as a set: the c-th occurrence of a value, c > 1, is a value of its own."""
    return F.expr(f"""case when size(array_distinct({hashes})) = size({hashes}) then {hashes}
        else transform({hashes}, (x, i) -> if(array_position({hashes}, x) = i + 1, x, xxhash64(x, i + 2 - array_position({hashes}, x)))) end""")


def simhash(values: str) -> Column:
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
        aggregate({values}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) * 2 > size({values}), shiftleft(1L, b), 0L))""")


def blocks(fingerprint: str, radius: int) -> Column:
    """(block, its bits) for radius + 1 blocks of a 64-bit fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << b - a) - 1}L").alias("bits"))
                               for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]))


def prepared_items(items: DataFrame, item_key: str, text: str) -> DataFrame:
    i = items.select(col(item_key).alias("item"), words_of(col(text)).alias("iw")).filter(F.size("iw") > 0)
    i = i.withColumns({"m": F.size("iw"), "span": F.least(F.size("iw"), F.lit(SHINGLE))})
    by_span = F.expr("case span " + " ".join(f"when {n} then {name}" for n, name in ((n, f"s{n}") for n in range(1, SHINGLE + 1))) + " end")
    i = i.withColumns({f"s{n}": shingle_hashes("iw", n) for n in range(1, SHINGLE + 1)}).withColumn("ish", by_span)
    i = i.withColumn("sorted", F.array_sort("ish")).withColumn("ibag", bag("sorted"))
    return i.select("item", "m", "span", "ish", "ibag", simhash("ibag").alias("ifp"))


def find(docs: DataFrame, items: DataFrame, radius: int = RADIUS, percent: int = PERCENT, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item: key, text_hash, item_id, position (first word of the best window, from 0),
    n_words, hamming, similarity.

    Null and empty texts and items match nothing.  Rows equal in key and text give one result; of equally similar windows that were
    candidates the first gives the position.  Very long texts are searched whole.
    A document shorter than the item is one window.  Items of fewer than five words are one shingle of all their words.
    Empty tables give no rows; other columns are ignored.
    """
    it = stored(prepared_items(items, item_key, item_text), "leak-items")
    spans = sorted(r[0] for r in it.select("span").distinct().collect()) or [SHINGLE]  # 1 to 5 at most
    d = docs.select(col(key).alias("k"), F.xxhash64(col(text)).alias("h"), words_of(col(text)).alias("w"))
    d = d.select("k", "h", F.size("w").alias("n"), F.array(*[F.struct(F.lit(n).alias("span"), shingle_hashes("w", n).alias("sh")) for n in spans]).alias("by_span"))

    # Shared shingles: where they stand in the document, and their first and last place in the item.
    anchors = it.select("item", "m", "span", F.posexplode("ish").alias("q", "sh")).groupBy("item", "m", "span", "sh").agg(F.min("q").alias("q0"), F.max("q").alias("q1"))
    anchors = broadcast_if_small(stored(anchors, "leak-anchors"), SMALL_ITEMS)
    # The outer forms: for the others Spark infers a filter on the array and moves it below, where words would be split anew for every shingle.
    hits = d.select("k", "h", "n", F.explode_outer("by_span").alias("s")).select("k", "h", "n", F.posexplode_outer("s.sh").alias("p", "sh")).join(anchors, "sh")
    hits = stored(hits.select("k", "h", "n", "item", "m", "span", "p", "q0", "q1").distinct(), "leak-hits")
    most = F.col("m") - F.col("span") + 1
    small = F.least(F.col("m"), F.col("n"))
    # Overlap that the similarity needs: percent / 100 of the union of the item's and the window's shingles.
    need = F.ceil(F.lit(percent / (100 + percent)) * (most + F.greatest(small - F.col("span") + 1, F.lit(1))) - 1e-9)
    enough = hits.groupBy("k", "h", "n", "item", "m", "span").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= need)
    enough = enough.select(F.col("k").alias("ek"), F.col("h").alias("eh"), F.col("item").alias("ei"))
    held = hits.join(broadcast_if_small(stored(enough, "leak-enough"), SMALL_DOCUMENTS), F.col("k").eqNullSafe(F.col("ek")) & (F.col("h") == F.col("eh")) & F.col("item").eqNullSafe(F.col("ei")), "left_semi")
    lined = [F.greatest(F.lit(0), F.least(F.col("p") - F.col(q), F.col("n") - F.col("m"))) for q in ("q0", "q1")]
    starts = held.select("k", "h", "item", "m", "span", F.explode(F.array_distinct(F.array(*lined))).alias("start")).distinct()
    after = F.lead("start").over(Window.partitionBy("k", "h", "item").orderBy("start"))
    starts = starts.withColumn("after", after).withColumn("last", F.when(F.col("after") - F.col("start") <= 2 * F.col("m"), F.col("after") - 1).otherwise(F.col("start")))
    starts = starts.select("k", "h", "m", "span", F.explode(F.sequence("start", "last")).alias("start")).distinct()
    # One array of starts per document and stretch of STRETCH words.
    wanted = starts.groupBy("k", "h", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("m", "span", "start")).alias("at"))
    wanted = broadcast_if_small(stored(wanted.select(F.col("k").alias("wk"), F.col("h").alias("wh"), "at"), "leak-starts"), SMALL_DOCUMENTS)
    cut = d.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & (F.col("h") == F.col("wh"))).select("k", "h", "by_span", F.explode("at").alias("a"))
    window = F.expr("array_sort(slice(filter(by_span, s -> s.span = a.span)[0].sh, a.start + 1, a.m - a.span + 1))")
    cut = stored(cut.select("k", "h", "a.m", "a.start", window.alias("window")).distinct(), "leak-windows")

    # Equal windows are fingerprinted and verified once.
    w = stored(cut.select("m", "window").distinct().withColumn("wbag", bag("window")).withColumn("wfp", simhash("wbag")), "leak-fingerprints")
    left = w.select("m", "window", "wfp", blocks("wfp", radius).alias("b")).select("m", "window", "wfp", "b.block", "b.bits")
    right = it.select("m", "item", "ifp", blocks("ifp", radius).alias("b")).select("m", "item", "ifp", "b.block", "b.bits")
    near = (left.join(right, ["m", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))))
            .filter(F.col("hamming") <= radius).select("m", "window", "item", "hamming").distinct())
    both = near.join(w.select("m", "window", "wbag"), ["m", "window"]).join(it.select(F.col("item").alias("bi"), F.col("m").alias("bm"), "ibag").distinct(), F.col("item").eqNullSafe(F.col("bi")) & (F.col("m") == F.col("bm")))
    both = both.withColumn("common", F.size(F.array_intersect("wbag", "ibag")))
    both = both.withColumn("total", F.size("wbag") + F.size("ibag") - F.col("common")).filter(F.col("common") * 100 >= F.col("total") * percent)
    leaks = cut.join(both.select("m", "window", "item", "hamming", (F.col("common") / F.col("total")).alias("similarity")), ["m", "window"])
    best = leaks.groupBy("k", "h", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming", "m")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("h").alias("text_hash"), F.col("item").alias(item_key), (-F.col("b.back")).cast("int").alias("position"),
                       F.col("b.m").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows and columns of `docs` that hold no item.  Null and empty texts hold none, rows with a null key are judged like others, repeated
    rows alike; empty tables are fine."""
    bad = stored(find(docs, items, key=key, text=text, **params).select(F.col(key).alias("__leak_key"), F.col("text_hash").alias("__leak_hash")).distinct(), "leak-rows")
    bad = broadcast_if_small(bad, SMALL_DOCUMENTS)
    return docs.join(bad, col(key).eqNullSafe(F.col("__leak_key")) & (F.xxhash64(col(text)) == F.col("__leak_hash")), "left_anti")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_BAG = "list_transform(range(1, greatest(len(ws) - {n} + 2, 1)), lambda i: array_to_string(ws[i:i+{n}-1], ' '))"
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS MATERIALIZED (SELECT item_id, len(ws) AS m, least(len(ws), 5) AS span, ws FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
ib AS MATERIALIZED (SELECT item_id, m, span, s, count(*) AS c FROM (SELECT item_id, m, span, unnest({_BAG.format(n="span")}) AS s FROM i) GROUP BY ALL),
ds AS (SELECT doc_id, span, unnest({_BAG.format(n="span")}) AS s FROM d, (SELECT DISTINCT span FROM i)),
pr AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, m, span FROM ds JOIN ib USING (span, s)),
wn AS (SELECT doc_id, item_id, m, span, st, ws[st+1:st+m] AS ws FROM (SELECT pr.*, d.ws, unnest(range(greatest(1, len(d.ws) - m + 1))) AS st FROM pr JOIN d USING (doc_id))),
wb AS (SELECT doc_id, item_id, m, st, len, s, count(*) AS c FROM (SELECT doc_id, item_id, m, st, greatest(len(ws) - 4, 1) AS len, unnest({_BAG.format(n="least(len(ws), 5)")}) AS s FROM wn) GROUP BY ALL),
sc AS (SELECT doc_id, item_id, wb.m, st, len + greatest(wb.m - 4, 1) AS both_, sum(least(wb.c, ib.c))::bigint AS common FROM wb JOIN ib USING (item_id, s) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, m, st, common::double / (both_ - common) AS similarity FROM sc WHERE common * 100 >= (both_ - common) * 80)
SELECT doc_id, item_id, m::int AS n_words, max(similarity) AS similarity FROM ok GROUP BY ALL
"""
