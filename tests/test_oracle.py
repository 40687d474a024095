"""Queries against their SQL in DuckDB on the smallest tables.  ALL_ORACLES=1 runs every one."""

import os

import duckdb
import pytest

import check
from framescope.operators import corpus
from framescope.plans import load

SOME = ["p02_frame_difficulty", "p18_packet_header", "p22_rate_split", "f03_voicing_gate", "a01_rate_statistics", "a02_segment_summary",
        "t01_extreme_segments", "w03_stream_thresholds", "a35_packet_census", "w16_silence_gate", "w17_hysteresis_class", "w18_leaky_bucket",
        "w30_recovery_source", "k12_assembled_features", "w01_spectral_flux", "w02_complex_onset", "h05_current_plan", "h05_early_plan",
        "a13_masked_deltas", "a16_quality_index", "a20_index16", "u01_promotion", "a24_difference_table", "a28_raw_pitch_accuracy",
        "j08_offset_sweep", "t03_listing", "w31_run_ranks", "k01_balanced_choice", "k03_context_windows", "k10_masked_features",
        "k13_surround_rates", "s01_read_pcm", "s07_read_packet_log", "x07_cepstrum", "w20_pitch_smoothing", "w26_stereo_width", "st01_tumbling_segments"]
NAMES = sorted(load.ORACLES) if os.environ.get("ALL_ORACLES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, con, name):
    df = load.QUERIES[name](spark, sf)
    cur = con.execute(load.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(cols, cur.fetchall())


def test_registry_is_complete():
    assert set(load.ORACLES) <= set(load.QUERIES)
    assert len(load.QUERIES) > 200


@pytest.fixture(scope="module")
def silent(tmp_path_factory):
    """Tables whose events hold frames of value 0, whose level is -inf."""
    folder = tmp_path_factory.mktemp("silent")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i*60) AS ts, i%3 AS user_id, ['view','click','error'][i%3+1] AS event_type,
                   CASE WHEN i//3%11 IN (2,3,7) THEN 0e0 ELSE i%97+0.5e0 END AS "value", '' AS props FROM range(300) t(i)) TO '{folder}/events.parquet'""")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["p09_decibels", "w25_loudness_trackers", "w36_delta_cepstrum"])
def test_silent_frames(short_segments, silent, name):
    folder, con = silent
    df = load.QUERIES[name](short_segments, folder)
    cur = con.execute(load.ORACLES[name])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert check.rows_of(df.columns, df.collect()) == want


def test_surround_rates_need_no_join(spark, sf):
    plan = load.QUERIES["k13_surround_rates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    streams = spark.createDataFrame([(1, "mono"), (1, "mono"), (1, "lfe"), (2, "coupled"), (3, "lfe")], "group_id long, kind string")
    got = sorted(tuple(r) for r in corpus.surround_rates(streams, 128000).collect())
    each = {tuple(r) for r in corpus.surround_kind_rates(streams, 128000).collect()}
    assert [r[:2] for r in got] == [(1, "lfe"), (1, "mono"), (1, "mono"), (2, "coupled")] and set(got) == each
