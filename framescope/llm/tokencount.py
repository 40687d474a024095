"""Token counts from a compiled finite-state tokenizer.

Two deterministic transducers stand for a byte-level BPE tokenizer with the usual splitting pattern:

1. The splitter reads character classes and marks where pieces begin (delayed by one character where the pattern looks
   ahead).  It has 12 states, so what a chunk of text does to the state is a vector of 12 states.  The maps of all chunks
   are computed side by side, composed by a parallel prefix scan, and the chunks then run once more from their true states.
2. The merger reads the bytes of a piece; every transition carries the change of the number of tokens.  A state is the set
   of positions at which a token could still begin: their places in the vocabulary's trie, the token that ends there in
   the encoding of the prefix, and how far the count there is behind.  That is enough: the last token of a prefix is the one
   candidate compatible with the token before it, and two tokens are compatible if merging their bytes gives them
   back.  States are compiled when first reached and all pieces of a batch step together; the table starts anew
   when it is full, which costs time but changes no count.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col

# Character classes of the pattern, its contractions, and Unicode's white space.
SEP, SPACE, WHITE, QUOTE, LETTER, NUMBER, OTHER, SHORT, R, V, L, E = range(12)
CONTRACTION_LETTERS = {"s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R, "v": V, "l": L, "e": E}
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Splitter states.
BREAK, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, ONE_SPACE, ONE_WHITE, MANY_SPACE, MANY_WHITE = range(12)
BEGINS, BEGAN_BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by 12 * state + class."""
    letters = {LETTER, SHORT, R, V, L, E}
    fresh = {SEP: BREAK, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: QUOTED, NUMBER: NUMBERS, OTHER: OTHERS} | dict.fromkeys(letters, LETTERS)
    joined = {QUOTE: OTHERS, NUMBER: NUMBERS, OTHER: OTHERS} | dict.fromkeys(letters, LETTERS)
    goes_on = {LETTERS: letters, NUMBERS: {NUMBER}, OTHERS: {OTHER, QUOTE}}
    pending = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    nxt, mark = np.zeros(144, np.uint8), np.zeros(144, np.uint8)

    def rule(state, c):
        if state in goes_on and c in goes_on[state]:
            return state, 0
        if state == QUOTED:
            if c == SHORT:
                return BREAK, 0
            if c in (R, V, L):
                return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            if c in (OTHER, QUOTE):
                return OTHERS, 0
        if state in pending:
            if c == pending[state]:
                return BREAK, 0
            to, m = rule(LETTERS, c)
            return to, m | BEGAN_BEFORE
        if state in (ONE_SPACE, ONE_WHITE, MANY_SPACE, MANY_WHITE) and c != SEP:
            if c in (SPACE, WHITE):
                return (MANY_SPACE if c == SPACE else MANY_WHITE), 0
            before = BEGAN_BEFORE if state in (MANY_SPACE, MANY_WHITE) else 0
            if state in (ONE_SPACE, MANY_SPACE):
                return joined[c], before
            return fresh[c], before | BEGINS
        return fresh[c], BEGINS

    for s in range(12):
        for c in range(12):
            nxt[12 * s + c], mark[12 * s + c] = rule(s, c)
    return nxt, mark


def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            kinds[cp] = LETTER
        elif k == "N":
            kinds[cp] = NUMBER
    kinds[WHITE_SPACE], kinds[32], kinds[39] = WHITE, SPACE, QUOTE
    for c, k in CONTRACTION_LETTERS.items():
        kinds[ord(c)] = k
    return kinds


class Splitter:
    CHUNK = 128

    def __init__(self):
        self.next, self.mark = splitter()
        self.kinds = character_classes()
        self.of_byte = np.append(self.kinds[:128], np.zeros(128, np.uint8))  # 0xFF, between texts, is SEP

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces begin, and every 0xFF, in UTF-8 texts that are kept apart by 0xFF."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kind = self.of_byte[lead]
        wide = np.flatnonzero((lead >= 0xC0) & (lead < 0xFF))
        if len(wide):
            b, p = lead[wide].astype(np.int32), at[wide]
            padded = np.append(data, np.zeros(3, np.uint8))
            x, y, z = ((padded[p + i] & 0x3F).astype(np.int32) for i in (1, 2, 3))
            cp = np.where(b < 0xE0, (b & 31) << 6 | x, np.where(b < 0xF0, (b & 15) << 12 | x << 6 | y, (b & 7) << 18 | x << 12 | y << 6 | z))
            kind[wide] = self.kinds[cp]
        n, c = len(kind), self.CHUNK
        lanes = -(-n // c)
        chunk = np.zeros(lanes * c, np.uint8)
        chunk[:n] = kind
        chunk = np.ascontiguousarray(chunk.reshape(lanes, c).T)
        maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], lanes, 1)
        for row in chunk:
            maps = self.next[maps * 12 + row]
        # Inclusive scan: after it, maps[:, i] is what all chunks up to i do together.
        span, lane = 1, np.arange(lanes)
        while span < lanes:
            maps[:, span:] = maps[:, span:][maps[:, :-span], lane[None, span:] - span]
            span *= 2
        state = np.append(np.uint8(BREAK), maps[BREAK, :-1])
        marks = np.empty_like(chunk)
        for i, row in enumerate(chunk):
            k = state * 12 + row
            marks[i], state = self.mark[k], self.next[k]
        marks = marks.T.reshape(-1)
        begins = (marks[:n] & BEGINS).astype(bool)
        begins |= np.append(marks[1:n] & BEGAN_BEFORE, 0).astype(bool)
        return at[begins]


class Merger:
    """Counts tokens of pieces with transitions compiled on demand."""

    SLOTS, STATES, LONG = 1 << 21, 300_000, 48

    def __init__(self, tokens: list[tuple[bytes, int]], merges: list[tuple[bytes, bytes]]):
        self.bytes_of = {i: b for b, i in tokens}
        self.id_of = dict(tokens)
        self.rank = {(self.id_of[a], self.id_of[b]): (r, self.id_of[a + b]) for r, (a, b) in enumerate(merges)}
        self.child, self.token, self.compatible = {}, [-1], {}
        for b, i in tokens:
            at = 0
            for c in b:
                k = at << 8 | c
                if k not in self.child:
                    self.child[k] = len(self.token)
                    self.token.append(-1)
                at = self.child[k]
            self.token[at] = i
        self.restart()

    def restart(self):
        self.state_of, self.states, self.moves = {(0, -1, 0): 0}, [(0, -1, 0)], {}
        self.slot_key, self.slot_move = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int64)
        if len(self.compatible) > 1_000_000:
            self.compatible = {}

    def merge(self, piece: bytes) -> list[int]:
        parts = [self.id_of[bytes([c])] for c in piece]
        while len(parts) > 1:
            ranked = [(self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i:i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            known = self.compatible[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def compile(self, key: int) -> int:
        """The move for state << 8 | byte: next state << 8 | change of the count + 128."""
        state, byte, alive, last, change = self.states[key >> 8], key & 255, [], -1, 0
        for i in range(0, len(state), 3):
            node = self.child.get(state[i] << 8 | byte)
            if node is None:
                continue
            before, behind = state[i + 1], state[i + 2]
            t = self.token[node]
            if last < 0 and t >= 0 and (before < 0 or self.follows(before, t)):
                last, change = t, behind + 1
            alive.append((node, before, behind))
        name = tuple(x for node, before, behind in alive for x in (node, before, behind - change)) + (0, last, 0)
        to = self.state_of.get(name)
        if to is None:
            to = self.state_of[name] = len(self.states)
            self.states.append(name)
        move = self.moves[key] = to << 8 | (change + 128)
        slot = self.slot(key)
        while self.slot_key[slot] >= 0:
            slot = (slot + 1) & (self.SLOTS - 1)
        self.slot_key[slot], self.slot_move[slot] = key, move
        return move

    def slot(self, key):
        return ((key * 0x9E3779B1) >> 13) & (self.SLOTS - 1)

    def moves_for(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slot(keys)
        found, out = self.slot_key[slots], self.slot_move[slots]
        rest = np.flatnonzero(found != keys)
        while len(rest):
            absent = found[rest] < 0
            if absent.any():
                missing = rest[absent]
                fresh, back = np.unique(keys[missing], return_inverse=True)
                out[missing] = np.array([self.moves.get(k) or self.compile(k) for k in fresh.tolist()])[back]
                rest = rest[~absent]
            slots[rest] = (slots[rest] + 1) & (self.SLOTS - 1)
            found[rest], out[rest] = self.slot_key[slots[rest]], self.slot_move[slots[rest]]
            rest = rest[found[rest] != keys[rest]]
        return out

    def full(self) -> bool:
        return len(self.states) > self.STATES or len(self.moves) > self.SLOTS // 2

    def restart_from(self, used: np.ndarray) -> np.ndarray:
        """Empties the table but for the states in `used`; their new numbers."""
        numbers, back = np.unique(used, return_inverse=True)
        names = [self.states[s] for s in numbers.tolist()]
        self.restart()
        for name in names:
            if name not in self.state_of:
                self.state_of[name] = len(self.states)
                self.states.append(name)
        return np.array([self.state_of[name] for name in names], np.int64)[back]

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each piece.  Pieces step together, at most SLOTS / 4 of them, so that one step's moves fit a half-full table."""
        order = np.argsort(-np.minimum(length, self.LONG + 1).astype(np.int8), kind="stable")
        out, most = np.zeros(len(order), np.int64), self.SLOTS // 4
        for at in range(0, len(order), most):
            some = order[at:at + most]
            out[some] = self._counts(data, start[some], length[some])
        return out

    def _counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same for pieces in falling order of their lengths up to LONG + 1."""
        if self.full():
            self.restart()
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        longer = np.searchsorted(-size.clip(max=self.LONG + 1), -np.arange(1, self.LONG + 1), side="right")
        for k in range(self.LONG):
            n = longer[k]
            if not n:
                break
            if self.full():  # the shorter pieces are done; start anew from the states of the others
                state[:n] = self.restart_from(state[:n])
            move = self.moves_for(state[:n] << 8 | data[begin[:n] + k])
            state[:n] = move >> 8
            total[:n] += (move & 255) - 128
        long = np.flatnonzero(size > self.LONG)
        for j, i in enumerate(long.tolist()):
            s, t = int(state[i]), int(total[i])
            for byte in data[begin[i] + self.LONG:begin[i] + size[i]].tobytes():
                key = s << 8 | byte
                move = self.moves.get(key) or self.compile(key)
                s, t = move >> 8, t + (move & 255) - 128
                if len(self.moves) > self.SLOTS * 3 // 4:  # start anew from this state and those of the pieces to come
                    fresh = self.restart_from(np.append(state[long[j + 1:]], s))
                    state[long[j + 1:]], s = fresh[:-1], int(fresh[-1])
            total[i] = t
        return total


class CompiledTokenizer:
    GROUP = 4 << 20

    def __init__(self, tokens, merges, specials: list[bytes]):
        import regex
        self.split, self.merger = Splitter(), Merger(tokens, merges)
        self.special = regex.compile(b"|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def count(self, texts: list[bytes]) -> np.ndarray:
        out, group, size = np.zeros(len(texts), np.int64), [], 0
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            out[i] += len(parts) - 1
            for p in parts:
                group.append((i, p))
                size += len(p)
            if size > self.GROUP:
                self._add(group, out)
                group, size = [], 0
        self._add(group, out)
        return out

    def _add(self, group, out):
        if not any(p for _, p in group):
            return
        data = np.frombuffer(b"\xff".join([p for _, p in group] + [b""]), np.uint8)
        start = self.split.starts(data)
        end = np.append(start[1:], len(data))
        ends = np.cumsum([len(p) + 1 for _, p in group])
        piece = data[start] != 0xFF
        start, end = start[piece], end[piece]
        owner = np.array([i for i, _ in group])[np.searchsorted(ends, start, side="right")]
        np.add.at(out, owner, self.merger.counts(data, start, end - start))


def read_byte_bpe(path: str) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, bytes]], list[bytes]]:
    """Tokens, merges and added tokens of a byte-level BPE file of the `tokenizers` library, as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if (model["type"], pre["type"], pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"], model.get("ignore_merges", False)) != ("BPE", "ByteLevel", False, True, None, False):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that look at their surroundings")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    raw = lambda s: bytes(shown[c] for c in s)
    added = {t["content"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return ([(raw(t), i) for t, i in model["vocab"].items() if t not in added], [(raw(a), raw(b)) for a, b in merges], sorted(t.encode() for t in added))


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of every whole text; `tokenizer` is a file on the driver, executors get its contents.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted alike, an empty table gives no rows, other
    columns are ignored.  A text's length is bounded only by what Spark can hold in one value.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_byte_bpe(tokenizer))
    base = docs.select(col(key).alias("k"), F.coalesce(col(text), F.lit("")).cast("binary").alias("t"))
    schema = f"k {base.schema['k'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batches):
        # Tasks that follow each other in one worker process share what has been compiled.
        held = sys.modules.setdefault("framescope_compiled_tokenizers", types.ModuleType("framescope_compiled_tokenizers")).__dict__
        if tokenizer not in held:
            held[tokenizer] = CompiledTokenizer(*spec.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(held[tokenizer].count(texts))], ["k", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, schema).withColumnRenamed("k", key)
