import hashlib
import math
import re
from collections import Counter

import numpy as np

from framescope.llm import imatch


def test_frequencies_and_band(frame, prose):
    rows = [(i, prose(30, i % 40)) for i in range(60)] + [(90, None), (91, "")]
    df = Counter()
    for r in rows:
        df.update(set(re.findall(r"[a-z0-9\u0080-￿]+", (r[1] or "").lower())))
    got = {r["term"]: r["df"] for r in imatch.document_frequencies(frame(rows)).collect()}
    assert sorted(got.values()) == sorted(df.values())
    words = imatch.lexicon(frame(rows), rare=1 / 20, common=1 / 5)
    assert len(words) == sum(len(rows) / 20 <= n <= len(rows) / 5 for n in df.values())
    idf = [math.log(len(rows) / n) for n in df.values() if len(rows) / 20 <= n <= len(rows) / 5]
    assert min(idf) >= math.log(5) - 1e-9 and max(idf) <= math.log(20) + 1e-9


def test_every_text_against_its_edit(spark, frame, odd_rows, prose):
    rows = odd_rows + [(50 + i, prose(40 + i, i)) for i in range(30)]
    keyed = {}
    for r in rows:
        keyed.setdefault(r[0], []).append(r[1] or "")
    got = imatch.edit_report(frame(rows), block_rows=4).collect()
    assert len(got) == len(rows)
    single = sorted((k for k, v in keyed.items() if k is not None and len(v) == 1), reverse=True)
    order = sorted((k for k in keyed if k is not None), reverse=True)
    by = {r["doc_id"]: r for r in got}
    for k in single:
        nxt = order[(order.index(k) + 1) % len(order)] if order.index(k) + 1 < len(order) else None
        own, following = keyed[k][0], keyed[None][0] if nxt is None else keyed[nxt][0]
        if nxt is not None and len(keyed[nxt]) > 1:
            continue
        half = len(own) // 2
        changed = own[:len(own) - half] + following[:half]
        assert by[k]["n_chars"] == len(own)
        assert by[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest(), k
    marks = {}
    for r in got:
        if r["doc_id"] in single:
            marks.setdefault(keyed[r["doc_id"]][0], set()).add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert len(set.union(*marks.values())) == len(marks)
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    whole = imatch.edit_report(frame(rows), block_rows=10_000).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, got))


def test_one_row_and_none(frame):
    r = imatch.edit_report(frame([(1, "abcdef")])).collect()
    assert r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert r[0]["near_next"] == 1.0
    assert imatch.edit_report(frame([])).count() == 0


def test_subsets_by_hand():
    texts = [b"alpha beta gamma", b"gamma beta alpha alpha", b"alpha beta delta"]
    lex = np.unique(imatch.terms_of(texts)[1])
    h, c = imatch.fingerprints(texts, lex)
    assert (h[0] == h[1]).all() and (c[0] == c[1]).all() and c[0][0] == 3
    assert 0 < imatch.likeness(h[:1], c[:1], h[2:], c[2:])[0] < 1 or (c[0] == 0)[1:].all()
    for p in range(imatch.PARTS):
        members = [t for t in imatch.terms_of(texts[:1])[1].tolist() if t * int(imatch.FACTORS[p]) % 2 ** 64 <= int(imatch.SHARES[p])]
        assert c[0][p] == len(members)
