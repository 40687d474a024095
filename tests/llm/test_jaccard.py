import random
from collections import Counter

import numpy as np

from framescope.llm import jaccard, shingles
from framescope.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def smallest_reachable(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def all_pairs(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in smallest_reachable(keys, links).items()}


def copies(prose, families=6, members=25):
    rnd = random.Random(12)
    rows, passage = [], prose(60, 999)
    for f in range(families):
        base = prose(rnd.choice((8, 30, 120, 300)), 100 + f).split()
        for _ in range(members):
            words = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 5))):
                at = rnd.randrange(len(words))
                words[at:at + rnd.choice((0, 1, 1, 4))] = [rnd.choice(("new", "other", "More"))] * rnd.choice((0, 1, 2))
            rows.append(" ".join(words))
    rows += [prose(rnd.randint(1, 40), 500 + i) + " " + passage for i in range(40)]
    rows += ["", None, "one", "one", "One", "two three", "a b c d", "a b c d e", "A  B\tC\nD", *rows[:5]]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(10 + o, t) for o, t in zip(order, rows, strict=True)]


def test_all_pairs(frame, prose):
    rows = copies(prose)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame(rows).repartition(7)).collect()}
    assert got == all_pairs(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 50
    kept = jaccard.one_per_group(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_small_ranges_and_batches_change_nothing(spark, frame, prose):
    rows = copies(prose, 3, 12)
    seen = []
    for size, batch in ((300_000, 8 << 20), (50, 2000)):
        found = shingles.shared_sets(frame(rows), sum(len(shingle_set(t)) for _, t in rows), 80, "doc_id", "text", size, batch)
        seen.append({r["set_key"]: (r["n_shingles"], frozenset(r["shared"])) for r in found.collect()})
    for key, (n, shared) in seen[1].items():
        assert n * 80 <= len(shared) * 100
        if key in seen[0]:
            assert seen[0][key][0] == n and seen[0][key][1] <= shared
    assert set(seen[0]) <= set(seen[1])


def test_divide_skip_equals_counting():
    rnd = random.Random(3)
    for _ in range(200):
        universe = rnd.randint(5, 60)
        query = rnd.sample(range(universe), rnd.randint(1, universe))
        sets = []
        for _ in range(rnd.randint(1, 20)):
            s = [x for x in query if rnd.random() < 0.9] + rnd.sample(range(100, 160), rnd.randint(0, 6))
            sets.append((len(s) + rnd.randint(0, 2), np.array(sorted(s), np.int64)))
        size = len(query) + rnd.randint(0, 3)
        want = [i for i, (n, s) in enumerate(sets) if len(set(query) & set(s.tolist())) >= jaccard.required_overlap(size, n, 80)]
        assert sorted(jaccard.InvertedLists(sets).divide_skip(np.array(query), size, 80)) == want


def test_required_overlap_is_the_similarity():
    for n in range(1, 60):
        for m in range(1, 60):
            t = jaccard.required_overlap(n, m, 80)
            assert 100 * t >= 80 * (n + m - t) and 100 * (t - 1) < 80 * (n + m - t + 1)


def test_packed_ranges():
    rnd = np.random.default_rng(1)
    for high in (1 << 20, 1 << 48):
        x = np.unique(rnd.integers(0, high, 5000).astype(np.uint64))
        assert (shingles.unpacked(shingles.packed(x)) == x).all()
        assert (shingles.unpacked(shingles.packed(x[:1])) == x[:1]).all()


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == smallest_reachable({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(frame, odd_rows):
    got = jaccard.near_groups(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got}
    assert {(1, 56, 1), (5, 56, 1), (2, 0, 2), (3, 0, 3), (8, 0, 8), (6, 1, 6), (7, 1, 6), (None, 36, None)} <= found
    assert Counter(r["doc_id"] for r in jaccard.one_per_group(frame(odd_rows)).collect()) == Counter([1, 2, 3, 4, None, 6, 6, 8, 9])
    assert jaccard.near_groups(frame([])).count() == 0
    assert jaccard.one_per_group(frame([])).count() == 0


def test_rows_without_words_all_stay(frame, prose):
    rows = [(None, None, "de", "a"), (None, None, "en", "b"), (None, "", "fr", "b"), (1, " \t", "en", "a"), (1, " \t", "en", "c"), (2, prose(9, 1), "en", "a"), (2, prose(9, 1), "en", "b")]
    kept = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in jaccard.one_per_group(frame(rows)).collect()]
    assert Counter(k for k in kept if k[0] != 2) == Counter(rows[:5]) and len([k for k in kept if k[0] == 2]) == 1


def test_sets_that_share_their_first_hash(frame, prose, monkeypatch):
    from framescope.llm import shingles
    real = shingles.set_keys

    def same_key(owner, sh, n_texts):
        n, key, check = real(owner, sh, n_texts)
        return n, np.where(key != 0, 7, key), check
    monkeypatch.setattr(shingles, "set_keys", same_key)
    rows = [(1, prose(80, 1)), (2, prose(80, 1)), (3, prose(80, 1) + " end"), (4, prose(60, 2)), (5, ""), (6, prose(60, 2) + " x y")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(frame(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
