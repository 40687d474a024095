"""Each stage against a plain version of it, on the smallest tables."""

import public_tokenizers
import tiktoken
from test_decontamination import best_windows
from test_jaccard import all_pairs
from test_mixing import fill_in_rounds

import corpus_pipeline
from framescope.llm import packing, quality
from framescope.llm.storage import stored


def test_stages(spark, sf, monkeypatch):
    columns, kept = spark.read.parquet(f"{sf}/documents.parquet").columns, []

    def keep(df, label):
        kept.append(stored(df, label))
        return kept[-1]

    monkeypatch.setattr(corpus_pipeline, "stored", keep)
    packed = corpus_pipeline.run(spark, sf)
    assert all(df.columns == columns for df in kept) and len(kept) == len(corpus_pipeline.STAGES) - 1
    tables = [df.toPandas() for df in kept]
    source = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(source, spark.read.parquet(f"{sf}/labels.parquet"))
    good, single, clean, mixed = tables
    assert set(good.doc_id) == {r["doc_id"] for r in quality.score(source, model).collect() if r["score"] >= 0.3}
    assert set(single.doc_id) == {c for _, c in all_pairs(list(zip(good.doc_id, good.text, strict=True))).values()} and len(single) == len(set(single.doc_id))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean.doc_id) == set(single.doc_id) - {d for d, _ in best_windows(list(zip(single.doc_id, single.text, strict=True)), items)}
    sizes = clean.assign(n=clean.text.str.split().str.len()).groupby("source").n.sum().to_dict()
    want, got = fill_in_rounds(sizes, (5, 2, 1), 3), mixed.assign(n=mixed.text.str.split().str.len()).groupby("source").n.sum().to_dict()
    longest = clean.text.str.split().str.len().max()
    assert all(abs(got.get(s, 0) - want[s]) <= longest for s in sizes) and mixed.doc_id.value_counts().max() <= 3
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert packed.agg({"n_tokens": "sum"}).first()[0] == sum(len(enc.encode_ordinary(t)) + 1 for t in mixed.text)
