import random
from collections import Counter

from pyspark.sql import functions as F

from framescope.llm import decontamination as D


def bag(words):
    return Counter([tuple(words)]) if 0 < len(words) <= 5 else Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(sum(a.values()) + sum(b.values()) - common, 1)


def best_windows(rows, items):
    """Every window of every document against every item that it shares a shingle with."""
    out, targets = {}, [(i, len(own), bag(own)) for i, own in ((i, (t or "").lower().split()) for i, t in items) if own]
    for doc, text in rows:
        words = (text or "").lower().split()
        grams = {n: {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} for n in range(1, 6)}
        for item, size, own in targets:
            if words and not grams[min(size, 5)].isdisjoint(own):
                best = max((similarity(bag(words[s:s + size]), own), -s) for s in range(max(1, len(words) - size + 1)))
                if best[0] >= 0.8:
                    out[doc, item] = (round(best[0], 9), -best[1])
    return out


def cases(prose):
    rnd = random.Random(8)
    items = [(i, prose(n, 900 + i)) for i, n in enumerate((3, 5, 9, 15, 30, 60, 80, 80))] + [(20, None), (21, ""), (22, "la la la la la la la la la la"), (23, prose(30, 904))]
    rows = []
    for d in range(90):
        words = prose(rnd.randint(0, 120), d).split()
        if d % 3:
            own = rnd.choice(items[:8])[1].split()
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                at = rnd.randrange(len(own))
                own[at:at + rnd.choice((0, 1))] = rnd.choice(([], ["new"], ["two", "new"]))
            at = rnd.randint(0, len(words))
            words[at:at] = own * rnd.choice((1, 1, 2))
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else " \n".join(words)))
    return rows + [(200, None), (201, ""), (202, "la " * 40), (203, " ".join(items[5][1].split()[4:]))], items


def test_all_windows(spark, frame, prose):
    rows, items = cases(prose)
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("key", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["position"]) for r in D.find(frame(rows), table).collect()}
    want = best_windows(rows, items)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len(want) > 30
    kept = {r["doc_id"] for r in D.without_leaks(frame(rows), table).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_odd_rows(spark, frame, odd_rows, prose):
    items = spark.createDataFrame([(1, prose(60, 1)), (2, prose(40, 2))], "item_id int, text string")
    got = D.find(frame(odd_rows), items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("1", 1), ("5", 1), ("None", 2)]
    left = D.without_leaks(frame(odd_rows), items)
    assert left.columns == frame(odd_rows).columns
    assert left.count() == len(odd_rows) - 4
    assert D.find(frame([]), items).count() == 0
    assert D.find(frame(odd_rows), items.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius(spark):
    rnd = random.Random(6)
    for radius in (3, 24):
        pairs = []
        for i in range(300):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), radius):
                b ^= 1 << bit
            pairs.append((i, *[x - (1 << 64) if x >> 63 else x for x in (a, b)]))
        df = spark.createDataFrame(pairs, "i int, a long, b long")
        left, right = df.select("i", D.blocks("a", radius).alias("k")), df.select("i", D.blocks("b", radius).alias("k"))
        assert left.join(right, ["i", "k"]).select("i").distinct().count() == len(pairs)


def test_copies_that_differ_in_a_run_of_one_word(spark, frame):
    """Nearly all shingles are the same, one of them many times: no such copy may lie beyond the radius."""
    rows, items, least = [], [], 1.0
    for size, run in ((200, 17), (400, 30), (200, 13)):
        for i in range(40):
            rnd = random.Random(size * 1000 + run * 100 + i)
            words = [f"w{rnd.getrandbits(40)}" for _ in range(size)]
            a, b = list(words), list(words)
            a[50:50 + run], b[50:50 + run] = ["alpha"] * run, ["omega"] * run
            number = len(items)
            items.append((number, " ".join(a)))
            rows.append((number, " ".join([f"x{rnd.getrandbits(40)}" for _ in range(30)] + b + ["end"])))
            least = min(least, similarity(bag(a), bag(b)))
    assert 0.8 <= least < 0.82
    got = {(r["doc_id"], r["item_id"]): r["position"] for r in D.find(frame(rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {(i, i): 30 for i in range(len(items))}
