import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken

from framescope.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_best_fit(lengths, capacity):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fit = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fit:
            best = min(fit, key=lambda r: room[r])
            rows[best].append(i)
            room[best] -= lengths[i]
        else:
            rows.append([i])
            room.append(capacity - lengths[i])
    return sorted(sum(lengths[i] for i in r) for r in rows)


def test_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.choice((7, 16, 100))
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 120))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= capacity for r in rows)
        # Which of several equally full rows is taken doesn't change how full rows end up.
        assert sorted(sum(lengths[i] for i in r) for r in rows) == plain_best_fit(lengths, capacity)


def test_room_tree():
    rnd, tree, rooms = random.Random(2), packing.RoomTree(50), []
    for _ in range(2000):
        if rooms and rnd.random() < 0.4:
            r = rooms.pop(rnd.randrange(len(rooms)))
            tree.add(r, -1)
        else:
            rooms.append(rnd.randint(1, 50))
            tree.add(rooms[-1], 1)
        need = rnd.randint(1, 50)
        assert tree.best_fit(need) == min((r for r in rooms if r >= need), default=-1)


def test_round_trip(frame, odd_rows, tmp_path):
    packed = packing.pack(frame(odd_rows), RANKS, public_tokenizers.PATTERN, context=64, group_tokens=3000)
    packing.write_packed(packed, str(tmp_path / "out"))
    got, parts = packed.sparkSession.read.parquet(str(tmp_path / "out")).collect(), defaultdict(list)
    for r in got:
        ids, pos, cu = np.frombuffer(r["input_ids"], "<i4"), np.frombuffer(r["position_ids"], "<i4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64
        assert (ids[cu[-1]:] == 0).all() and len(cu) == len(r["doc_ids"]) + 1
        for d, p, a, z in zip(r["doc_ids"], r["pieces"], cu, cu[1:], strict=False):
            assert pos[a:z].tolist() == list(range(z - a))
            parts[d].append((p, ids[a:z].tolist()))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.read_ranks(RANKS), special_tokens={})
    want = defaultdict(list)
    for r in odd_rows:
        want[r[0]].append([*enc.encode_ordinary(r[1] or ""), 50256])
    for d, texts in want.items():
        if len(texts) == 1:
            assert [t for _, ids in sorted(parts[d]) for t in ids] == texts[0]
        else:
            assert sum(len(ids) for _, ids in parts[d]) == sum(map(len, texts))
    assert packing.pack(frame([]), RANKS, public_tokenizers.PATTERN).count() == 0
