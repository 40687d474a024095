import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framescope.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return tokencount.CompiledTokenizer(*tokencount.read_byte_bpe(PATH)), Tokenizer.from_file(PATH)


def same(both, texts):
    ours, theirs = both
    assert ours.count([t.encode() for t in texts]).tolist() == [len(x) for x in theirs.encode_batch(texts, add_special_tokens=False)]


def test_prose(both, prose):
    same(both, [prose(n, n) for n in (1, 5, 50, 500)] + ["Hello, world! It's 2024; they've paid $3.50 (don't ask)."])


@pytest.mark.parametrize("alphabet", [" \t\n  ''''’srtvleLMD12½.,!?éÉ中🙂　\u0085abc_-", "'sStTrReEvVlLmMdD ", "ab ", "\x1c\x1d \n\r\xa0x1"])
def test_any_text(both, alphabet):
    rnd = random.Random(5)
    same(both, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)])


def test_special_strings_and_ends(both):
    same(both, ["<|endoftext|>", "a<|endoftext|> b", "x <|endoftext|><|endoftext|>", "'", "''", "'r", "'re", "'rex", " 're", "  ", "a  ", "\n\n b", "", " ", "don't'll"])


def test_long_pieces(both):
    same(both, ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "!?" * 3_000, "é" * 4_000, "0123456789" * 900])


def test_table_that_fills_up(both, prose, monkeypatch):
    monkeypatch.setattr(tokencount.Merger, "STATES", 50)
    ours = tokencount.CompiledTokenizer(*tokencount.read_byte_bpe(PATH))
    monkeypatch.setattr(tokencount.CompiledTokenizer, "GROUP", 200)
    same((ours, both[1]), [prose(40, n) for n in range(40)])


@pytest.mark.parametrize("slots", [1 << 10, 1 << 13])
def test_table_that_fills_up_inside_one_call(both, monkeypatch, slots):
    monkeypatch.setattr(tokencount.Merger, "SLOTS", slots)
    ours = tokencount.CompiledTokenizer(*tokencount.read_byte_bpe(PATH))
    rnd = random.Random(6)

    def word(n):
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    same((ours, both[1]), [" ".join(word(rnd.randint(1, 40)) for _ in range(1500)), *[word(rnd.randint(60, 400)) for _ in range(20)]])


def test_chunk_maps_agree_with_one_walk(monkeypatch, prose):
    import numpy as np
    data = np.frombuffer("\xff".join([prose(80, 1), "it's  we'll \n x", "", "  "]).encode("latin-1", "replace").replace(b"?", b"e") + b"\xff", np.uint8)
    whole = tokencount.Splitter()
    monkeypatch.setattr(tokencount.Splitter, "CHUNK", 10 ** 6)
    one = whole.starts(data)
    for c in (1, 2, 7, 64):
        monkeypatch.setattr(tokencount.Splitter, "CHUNK", c)
        assert (whole.starts(data) == one).all()


def test_rows(frame, odd_rows, both):
    got = tokencount.count_tokens(frame(odd_rows), PATH).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(both[1].encode(r[1] or "", add_special_tokens=False))) for r in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert tokencount.count_tokens(frame([]), PATH).count() == 0
