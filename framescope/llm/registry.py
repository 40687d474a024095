"""Queries of this folder over the given tables, one per operator, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm import chat, decontamination, imatch, jaccard, mixing, packing, phrases, pii, quality, sharding, tokencount, toxicity, whitening
from framescope.llm.supervision import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_ring_shards")
def op1(spark, d):
    return (sharding.shard(table(spark, d, "documents"), n_shards=40)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


@query("op9_water_filling_mix", mixing.SQL)
def op9(spark, d):
    return mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op8_best_fit_packing")
def op8(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, context=2048)


@query("op10_rule_ensemble_quality")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, d, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_transducer_token_counts")
def op5(spark, d):
    counted = tokencount.count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op4_convolution_toxicity")
def op4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    scored = toxicity.classify(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


@query("op3_imatch_fingerprints")
def op3(spark, d):
    return imatch.edit_report(table(spark, d, "documents"))


@query("op6_simhash_decontamination", decontamination.SQL)
def op6(spark, d):
    found = decontamination.find(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "similarity")


@query("op7_divide_skip_join", jaccard.SQL)
def op7(spark, d):
    return jaccard.near_groups(table(spark, d, "documents"))


@query("op2_weak_supervision_pii")
def op2(spark, d):
    return pii.find_spans(table(spark, d, "documents"))[0]


@query("op11_prefix_free_collocations", phrases.SQL)
def op11(spark, d):
    return phrases.collocations(table(spark, d, "documents").select("text", "lang"))


@query("op12_template_chat", chat.SQL)
def op12(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema))
    return chat.read_back(chat.format_conversations(turns, chat.TEMPLATE, chat.CONTROLS, chat.KNOWN)).withColumnRenamed("conv", "conv_id")


@query("op13_incremental_whitening")
def op13(spark, d):
    return whitening.by_component(whitening.whiten(table(spark, d, "embeddings"), components=8))
