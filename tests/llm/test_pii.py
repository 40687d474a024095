import hashlib
import random
import re

import numpy as np
import pytest

from framescope.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["1122450 .-+()@a.b9é_%\n", "0123456789 -", "a@.b", "12.+ "])
def test_base_spans_are_those_of_the_plain_patterns(alphabet):
    rnd = random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(t) == plain(t)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 100_000 + "+1" + "(" * 200_000) == []


def test_pattern_codes_round_trip():
    rnd = random.Random(1)
    for _ in range(200):
        v, f = [rnd.choice((-1, 0, 1)) for _ in range(pii.LABELERS)], [rnd.randint(0, 1) for _ in range(pii.SHAPES)]
        assert pii.read_code(pii.pattern_code(v, f)) == (v, f)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.6, 0.9, 0.75]
    v = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    q, table, prior = pii.reliabilities(patterns, n.astype(float))
    assert abs(prior - 0.7) < 0.03
    assert all(abs(table[1, i, 2] - a) < 0.04 for i, a in enumerate(accuracy))


def test_rows(frame, odd_rows):
    texts = ["mail me: jo.doe@site.example.com now", "call +1 (212) 555-0188 or 212-555-0199", "key password=abcd1234efgh5678 ok", "card 4111 1111 1111 1111 at 8.8.8.8", "ssn 123-45-6789"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts * 4)]
    df, model = pii.find_spans(frame(rows))
    got = df.collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows if r[0] and r[0] >= 100}
    for r in got:
        if r["doc_id"] in by_id:
            t, spans = by_id[r["doc_id"]], plain(by_id[r["doc_id"]])
            shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
            assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
            assert r["spans"].startswith(shown)
            assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == i for x in spans) for i in range(4)]
    assert any("credential" in r["spans"] for r in got)
    assert {r["base_sha256"] for r in got if r["doc_id"] in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_spans(frame([]))[0].count() == 0
