"""Odd numbers and shapes: missing frames, lengths that differ, values that are no numbers, filter banks, where code runs."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.functions import arrays as A
from framescope.functions import spectral
from framescope.operators import layout


def test_missing_frames_have_the_length_of_their_row(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], None), (2, None, None), (3, [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0])], "i int, a array<double>, b array<double>").coalesce(1)
    for batch in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["i"]: (r["amag"], r["bmag"]) for r in spectral.spectra(df, {"a": "a", "b": "b"}, window="none").collect()}
        assert got[2] == (None, None) and got[1][1] == [0.0, 0.0, 0.0]
        assert np.allclose(got[1][0], np.abs(np.fft.rfft([1, 2, 3, 4])))
    with pytest.raises(Exception, match="different lengths"):
        spectral.spectra(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 4)], "i int, a array<double>").coalesce(1), {"a": "a"}).collect()


def test_slots_keep_the_order_of_all_doubles(spark):
    values = [-math.inf, -1e300, -3.0, -1e-9, 0.0, 2e-9, 1.0, 48000.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("s", layout.slot_of(layout.F.col("v")))
    slots = [r["s"] for r in df.orderBy("i").collect()]
    assert slots == sorted(slots) and len(set(slots)) == len(values)


@pytest.mark.parametrize("scale", ["bark", "erb"])
def test_filter_bank_rows_are_hats(scale):
    bank = np.array(A.filter_bank(8, 256, 16000, scale))
    assert bank.shape == (8, 129) and np.allclose(bank.sum(0), 1) and (bank >= 0).all()
    assert bank[0, 0] == 1 and bank[-1, -1] == 1
    assert all((np.diff(np.sign(np.diff(row[row > 0]))) <= 0).all() for row in bank)


def test_kernels_run_from_any_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "from framescope.functions import spectral\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print(spectral.spectra(s.createDataFrame([(1, [1.0, 2.0])], 'i int, a array<double>'), {'a': 'a'}, window='none').first()['amag'])\n") % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "[3.0, 1.0]" in out.stdout, out.stderr[-800:]


def test_quantiles_of_close_and_odd_values(spark):
    from framescope.operators import quantiles
    rng = np.random.default_rng(3)
    rows = [(1, float(x)) for x in 48000 + rng.random(3000)] + [(2, x) for x in (math.nan, 1.0, math.inf, -math.inf, None, 2.0)] + [(3, 5.0)] * 7
    got = {r["stream_id"]: r for r in quantiles.quantiles(spark.createDataFrame(rows, "stream_id int, v double"), "v", {"a": 0.1, "b": 0.5, "c": 1.0}, ["stream_id"]).collect()}
    close = sorted(v for k, v in rows if k == 1)
    assert [got[1][n] for n in "abc"] == pytest.approx(list(np.quantile(close, [0.1, 0.5, 1.0])), abs=1e-9)
    assert got[2]["b"] == 2.0 and math.isnan(got[2]["c"]) and [got[3][n] for n in "abc"] == [5.0] * 3


def test_stored_rows_after_a_failed_job(spark, tmp_path):
    from framescope.operators import ranking
    folder, work = str(tmp_path / "rows"), spark.createDataFrame([(1,), (2,)], "k int")
    (tmp_path / "rows").mkdir()
    assert ranking.with_stored(spark, folder, work, ["k"], lambda w: w).count() == 2
    assert ranking.with_stored(spark, folder, work, ["k"], lambda w: w).count() == 2


def test_stage_results_under_retries(spark, tmp_path):
    """A failed append leaves nothing that is read; a second run at the same time repeats no row; a third one computes nothing."""
    from framescope.operators import ranking
    folder = str(tmp_path / "rows")
    work = spark.range(6).select(F.col("id").alias("k"))

    def rows_of(asked, run):
        return asked.withColumn("run", F.lit(run))

    def fails(asked):
        return asked.withColumn("run", F.when(F.col("k") < 5, F.lit(0)).otherwise(F.raise_error(F.lit("lost")).cast("int")))

    with pytest.raises(Exception, match="lost"):
        ranking.with_stored(spark, folder, work, ["k"], fails)
    store = ranking.StageStore(spark, folder, ["k"])
    assert store.rows() is None
    rows_of(work, 9).write.parquet(f"{folder}/part-{0:020d}-abc")  # finished, but never committed

    def late(asked):
        store.append(rows_of(work.where("k < 4"), 1))  # another run commits while this one computes
        return rows_of(asked, 2)

    got = ranking.with_stored(spark, folder, work, ["k"], late)
    assert sorted((r["k"], r["run"]) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
    asked = []
    again = ranking.with_stored(spark, folder, work, ["k"], lambda w: (asked.append(w.count()), rows_of(w, 3))[1])
    assert asked == [0] and again.count() == 6 and len(store.committed()) == 3
