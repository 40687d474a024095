import zlib

import numpy as np
import pytest

from framescope.llm import toxicity
from framescope.llm.registry import QUERIES
from framescope.llm.supervision import held_out, labelled


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark, frame, prose):
    docs = frame([(i, prose(5, i)) for i in range(200)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None), (8, 1), (8, 0)], "doc_id long, toxic int")
    assert labelled(docs, labels, "toxic", 50).count() == 50
    everything = labelled(docs.withColumn("id", docs.doc_id), labels, "toxic", 10_000, extra=("id",)).collect()
    assert {r["id"] for r in everything} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert [r["label"] for r in everything if r["id"] == 8] in ([], [1])
    out = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))


def test_one_row_of_a_repeated_key_is_sampled(spark, frame, prose):
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, prose(5, i)) for i in range(40)] + [(kept[0], prose(5, 100 + n), f"l{n}") for n in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = [labelled(frame(some), labels, "toxic", 20, extra=("lang",)).collect() for some in (rows, rows[::-1])]
    assert len(got[0]) == 20 and sorted(got[0]) == sorted(got[1])
    assert got[0][0].__fields__ == ["text", "label", "lang"]


def test_maxima_equal_a_loop():
    rng = np.random.default_rng(0)
    model = toxicity.TextConvolution(rng.normal(0, 1, (toxicity.PAD + 1, toxicity.DIM)).astype(np.float32), [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                                     [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(0, 1, toxicity.FILTERS * 3).astype(np.float32), 0.1)
    model.table[toxicity.PAD] = 0
    texts = [b"one two three four", b"", b"seven", "café au lait".encode()]
    for text, got in zip(texts, model.score(texts), strict=True):
        rows, _ = toxicity.word_rows([text])
        n, x = max(len(rows) - 3, 1), np.concatenate([model.table[rows].sum(1), np.zeros((2, toxicity.DIM))])
        pooled = [max(sum(x[i + j] @ f[j][:, k] for j in range(len(f))) + b[k] for i in range(n)) for f, b in zip(model.filters, model.biases, strict=True) for k in range(toxicity.FILTERS)]
        assert got == pytest.approx(1 / (1 + np.exp(-(np.maximum(pooled, 0) @ model.head + 0.1))), abs=1e-4)


def test_score_does_not_depend_on_neighbours(prose):
    texts = [prose(n, n).encode() for n in (3, 1, 40, 7)] + [b"", b"x"]
    rng = np.random.default_rng(1)
    model = toxicity.train(texts * 5, (rng.random(30) < 0.5).astype(float), ["a"] * 30)
    assert model.score(texts) == pytest.approx([model.score([t])[0] for t in texts], abs=1e-6)


def test_learns_words_and_word_beginnings(prose):
    bad = ["frobnix", "frobnag", "zulkar"]
    texts = [prose(30, i) + (" " + bad[i % 3] + " " + prose(5, i) if i % 4 == 0 else "") for i in range(800)]
    y = np.array([i % 4 == 0 for i in range(800)], float)
    model = toxicity.train([t.encode() for t in texts[:600]], y[:600], ["a", "b"] * 300)
    s = model.score([t.encode() for t in texts[600:]])
    assert ((s >= 0.5) == y[600:]).mean() > 0.97
    assert set(model.thresholds) <= {"a", "b"}


def test_one_class_and_no_rows(frame, odd_rows):
    constant = toxicity.train([b"a b"] * 3, np.zeros(3), [None] * 3)
    assert constant.score([b"", b"a b"]) == pytest.approx([0.125, 0.125])
    assert toxicity.train([], np.array([]), []).score([b"x"]) == pytest.approx([0.5])
    got = toxicity.classify(frame(odd_rows), constant).collect()
    assert len(got) == len(odd_rows) and all(r["threshold"] == 0.5 and not r["flagged"] for r in got)
    assert toxicity.classify(frame([]), constant).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    r = QUERIES["op4_convolution_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (r.predicted == r.toxic).mean() > 0.98
