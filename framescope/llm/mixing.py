"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of all words.  A source cannot give more than `max_epochs` times what it has, so
shares stop there and the rest is dealt out again by weight.  With the sources ordered by capacity over weight, the
clamped ones are a prefix, and the final level is the first one that the next source can bear: one pass over one row
per source.  A source is then taken whole floor(target / size) times; the fraction left is filled with documents in
the order of a seeded hash until the target is met, the last one only if it brings the sum closer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.storage import broadcast_if_small, col, free_name, stored

WORD = r"[^\x20\x09-\x0D]+"
SMALL_PLAN = 100_000  # sources whose plan is broadcast; beyond it the rows are joined by shuffle


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(col(key).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))


def _bucket(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, 3), 16, 10).cast("int")


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """`sources` has src and source_size; adds target, whole and budget (words wanted beyond the whole passes).
    Weights repeat over the sources in code point order, null last."""
    whole_table = Window.partitionBy(F.lit(0))
    by_name = whole_table.orderBy(F.col("src").asc_nulls_last())
    by_level = whole_table.orderBy("ratio", F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_epochs))})
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumns({
        "given": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "asking": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole_table).cast("double"),
    }).withColumn("level", (F.col("total") - F.col("given")) / F.col("asking"))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole_table)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("src", "source_size", "weight", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of `docs` plus one struct column `mix` (renamed with underscores if there is one already):
    size, source_size, target, copies, taken (copies * size).

    A null text counts 0 words; a null source is a source of its own, last in order; a null key hashes as the empty string.
    Rows without words get the whole passes only.  Equal rows are drawn each on its own.  An empty table gives no rows.
    Two scans: counts per source and hash bucket, then the rows.  Only the one bucket in which a source's fraction ends
    is ordered, so a source that holds most of the rows is spread like any other.
    """
    m, src, out = free_name(docs, "__mix_row"), free_name(docs, "__mix_plan"), free_name(docs, "mix")
    draw = seeded_hash(key, seed)
    sums = (docs.select(col(source).alias("src"), _bucket(draw).alias("bucket"), word_count(text).alias("size"))
            .groupBy("src", "bucket").agg(F.sum("size").alias("size")))
    plan = water_fill(sums.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    running = sums.withColumn("before", F.coalesce(F.sum("size").over(
        Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = plan.withColumnRenamed("src", "psrc")
    cut = (running.join(b, F.col("src").eqNullSafe(F.col("psrc")))
           .groupBy("psrc", "source_size", "target", "whole", "budget")
           .agg(F.max(F.when(F.col("before") <= F.col("budget"), F.struct("bucket", "before"))).alias("cut"))
           .select("psrc", F.struct("source_size", "target", "whole", "budget", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before")).alias(src)))
    kept = free_name(docs, "psrc")
    cut = broadcast_if_small(stored(cut.withColumnRenamed("psrc", kept), "mix-plan"), SMALL_PLAN)
    rows = docs.withColumn(m, draw).join(cut, col(source).eqNullSafe(F.col(kept))).drop(kept)
    bucket = _bucket(F.col(m))
    at = F.col(f"{src}.cut")

    def finish(df: DataFrame, extra: Column) -> DataFrame:
        size = F.col(f"{m}_size")
        copies = F.col(f"{src}.whole") + F.when(extra & (size > 0), 1).otherwise(0)
        return df.withColumn(out, F.struct(size.alias("size"), F.col(f"{src}.source_size").alias("source_size"), F.col(f"{src}.target").alias("target"),
                                           copies.alias("copies"), (copies * size).alias("taken"))).drop(m, f"{m}_size", f"{m}_before", src)

    clear = rows.filter(bucket != at).withColumn(f"{m}_size", word_count(text))
    edge = rows.filter(bucket == at).withColumn(f"{m}_size", word_count(text))
    order = Window.partitionBy(col(source)).orderBy(F.col(m), col(key), F.xxhash64(col(text))).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn(f"{m}_before", F.col(f"{src}.before") + F.coalesce(F.sum(f"{m}_size").over(order), F.lit(0)))
    return finish(clear, bucket < at).unionByName(finish(edge, F.col(f"{m}_before") + F.col(f"{m}_size") / F.lit(2.0) <= F.col(f"{src}.budget")))


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mixed table itself: every row of `docs` as often as the mix takes it."""
    mixed = mix(docs, **params)
    out = mixed.columns[-1]
    again = free_name(docs, "__mix_again")
    return (mixed.filter(F.col(f"{out}.copies") > 0)
            .withColumn(again, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies").cast("int")))).select(*[col(c) for c in docs.columns]))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint AS size, md5(concat_ws('|', doc_id::varchar, '17')) AS draw FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS weight, source_size * 3e0 AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
   ((sum(source_size) OVER ())::double - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT *, least(cap, (SELECT arg_min(lev, ratio) FROM l WHERE ratio >= lev) * weight) AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2e0 <= budget AND size > 0 THEN 1 ELSE 0 END))::bigint AS taken FROM r
"""
