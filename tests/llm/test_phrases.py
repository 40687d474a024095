import re
from collections import Counter

import numpy as np
import pytest

from framescope.llm import phrases
from framescope.llm.phrases import chunks_of, collocations


def plain(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    frequent = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        longer = (c for (g, q), c in frequent.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
        if any(c >= a for c in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
            for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.fixture(scope="module")
def rows(prose):
    """Copied passages, runs of one word, odd separators, all of them across chunk ends."""
    few = "the of and to in a b c d e F G H".split()
    r = np.random.default_rng(3)
    some = [(" ".join(r.choice(few, 300)), ("en", "de", None)[i % 3]) for i in range(40)]
    some += [(prose(30, 7) + ". " + prose(80, i), "en") for i in range(30)]
    some += [("x " * 20_000, "fr"), ("Ab,ab\tcd\n ef  gh;.ij\x0bkl", "en"), (None, "en"), ("", None), (" \t", ""), ("é É ß z é É", "fr"), ("w" * 100_000 + " a b", "fr")]
    return some + some[:10]


@pytest.mark.parametrize(("least", "top"), [(4, 2000), (20, 5), (2, 50)])
def test_equals_plain_counts(frame, rows, least, top):
    docs = frame([(i, t, lang) for i, (t, lang) in enumerate(rows)])
    got = collocations(docs, least, top).collect()
    assert {tuple(r) for r in got} == plain(rows, least, top)
    assert len(got) == len({(r.lang, r.rank) for r in got})


def test_small_batches_filters_and_parts(frame, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 2000)
    monkeypatch.setattr(phrases, "OWN_WORDS", 7)
    monkeypatch.setattr(phrases, "TOP_ROWS", 10)
    docs = frame([(i, t, lang) for i, (t, lang) in enumerate(rows)])
    assert {tuple(r) for r in collocations(docs, 3, 20, filter_bits=256).collect()} == plain(rows, 3, 20)


def test_every_word_is_owned_once(prose):
    texts = [prose(5000, 1).encode(), b"", b"one", prose(3000, 1).encode() + b". " + b"a " * 9000]
    owner, own, chunk = chunks_of(texts)
    for i, t in enumerate(texts):
        words = re.findall(rb"[^ \t.]+", t)
        got = [w for o, n, c in zip(owner, own, chunk, strict=True) if o == i for w in re.split(rb"[ \t\n]", c)[:n]]
        assert got == words
    again = chunks_of([b"word " + texts[0]])[2]
    assert len(set(chunk) & set(again)) > 0.9 * len(again)


def test_empty_and_odd_tables(frame, odd_rows):
    assert collocations(frame([]), 1).count() == 0
    assert collocations(frame([(1, None), (2, ""), (3, " ")]), 1).count() == 0
    rows = [(r[1], r[2] if len(r) > 2 else "en") for r in odd_rows if len(r[1] or "") < 1000]
    got = collocations(frame([r for r in odd_rows if len(r[1] or "") < 1000]), 2).collect()
    assert {tuple(r) for r in got} == plain(rows, 2, 2000)
