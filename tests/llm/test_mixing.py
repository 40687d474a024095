from collections import defaultdict

import duckdb
import pytest

import check
from framescope.llm import mixing
from framescope.llm.registry import ORACLES, QUERIES


def fill_in_rounds(sizes, weights, most):
    """Clamp, deal the excess out again by weight, until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in clamped]
        level = (left - sum(clamped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return clamped | {s: level * weight[s] for s in free}
        clamped |= {s: most * sizes[s] for s in over}


def test_rows(frame, prose):
    rows = [(i, prose(1 + i % 90, i), "en", s) for i, s in enumerate(["a"] * 500 + ["b"] * 20 + ["C"] * 60 + ["é"] * 5 + [None] * 40 + ["z"] * 300)]
    rows += [(2000, None, "en", "a"), (2001, "", None, "empty"), (None, "one two", "en", "b"), (5, prose(6, 5), "en", "a"), (5, prose(6, 5), "en", "a")]
    mixed = mixing.mix(frame(rows))
    assert mixed.columns[-1] == "_mix" and mixed.columns[:-1] == frame(rows).columns
    got, taken, sizes = mixed.collect(), defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = fill_in_rounds(sizes, (5, 2, 1), 3)
    for r in got:
        m = r["_mix"]
        assert m["size"] == len((r["text"] or "").split()) and m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(want[r["source"]])
        assert m["taken"] == m["copies"] * m["size"] <= 3 * m["size"]
        taken[r["source"]] += m["taken"]
    longest = max(len((r[1] or "").split()) for r in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    again = mixing.mix(frame(rows).repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    again = mixing.repeated(frame(rows))
    assert again.columns == frame(rows).columns
    assert again.count() == sum(r["_mix"]["copies"] for r in got)


def test_no_words_and_no_rows(frame):
    got = mixing.mix(frame([(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [(r["_mix"]["target"], r["_mix"]["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(frame([])).count() == 0
    one = mixing.mix(frame([(1, "a b c", "en", "s")])).first()["_mix"]
    assert (one["target"], one["taken"]) == (3.0, 3)


def test_same_rows_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op9_water_filling_mix"](spark, sf)
    cur = con.execute(ORACLES["op9_water_filling_mix"])
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([d[0] for d in cur.description], cur.fetchall())
