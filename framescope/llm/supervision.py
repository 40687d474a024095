"""Labelled rows for fitting: which rows may be learnt from, and a bounded, repeatable sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model sees: crc32 of the key's text divisible by 5 (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """text, label (0 or 1) and `extra` columns of at most `max_rows` labelled documents that are not held out, chosen by a
    hash of the key.  Null keys and labels are left out; a key labelled more than once counts with its larger label, and of
    rows that share a key the one with the least hash of its text is taken.
    Only the sample's keys and labels, at most `max_rows` of them, are broadcast."""
    chosen = (labels.select(col(key).alias("__key"), col(label).cast("int").alias("__label")).filter("__key IS NOT NULL AND __label IS NOT NULL")
              .groupBy("__key").agg(F.max("__label").alias("__label")).filter(~held_out("__key"))
              .orderBy(F.xxhash64("__key"), "__key").limit(max_rows))
    found = docs.select(col(key).alias("__key"), F.coalesce(col(text), F.lit("")).alias("text"), *[col(c) for c in extra]).join(F.broadcast(chosen), "__key")
    values = ["text", "__label", *[f"`{c.replace('`', '``')}`" for c in extra]]
    one = found.groupBy("__key").agg(F.min_by(F.struct(*values), F.struct(F.xxhash64("text"), *values)).alias("__row"))
    return one.select("__row.*").withColumnRenamed("__label", "label")
