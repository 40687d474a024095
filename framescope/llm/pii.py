"""Personal data by weak supervision.

Patterns propose spans: the four base kinds, which always stay, and looser kinds that need a decision.  Seven labelers (format
rules, gazetteers for and against, context words for and against, neighbours, variety) vote for, against or not at all.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is per kind, without any
label; its posteriors train a logistic span classifier on votes and shape features, which decides what is added.

The corpus is read once.  What reaches the driver are counts per (kind, votes, shape), whose number is bounded by the
number of patterns: kinds * 3^7 * 2^5.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import col, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "ssn", "iban", "credential", "access_key")
KINDS = BASE + ADDED
LABELERS, SHAPES = 7, 5

# Base patterns.  Runs are taken whole, which finds what the plain patterns find, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key")
CREDENTIAL = re.compile(r"(?:" + "|".join(SECRET_WORDS) + r")\x20?[=:]\x20?(\"[^\"\s]{8,}\"|[^\"\s]{8,})", re.I)
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb-", "AIza")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(KEY_PREFIXES) + r")[A-Za-z0-9_-]{16,}(?![A-Za-z0-9])")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai de fr es it uk us ca ch at be nl se no dk fi pl pt br mx jp cn in ru eu au nz".split())
COUNTRY_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
NOT_PERSONAL = ("0.", "127.", "255.255", "10.", "192.168.", "169.254.", "noreply@", "no-reply@", "postmaster@", "000-", "666-")
CUES = {"email": ("mail", "contact", "write to"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobil"),
        "local_phone": ("phone", "tel", "call", "fax", "mobil"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank", "konto"), "credential": ("login", "user", "auth"),
        "access_key": ("key", "aws", "auth")}
OTHER_NUMBERS = ("version", "ver.", "v.", "isbn", "issn", "doi", "section", "figure", "table", "page", "chapter", "license")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def small_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 3 or (len(p) == 3 and p <= "255")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out, end = [], 0
    if "@" in t:
        for m in DOMAIN.finditer(t):
            begin, at = m.start(), m.start()
            while begin > end and (t[begin - 1].isascii() and (t[begin - 1].isalnum() or t[begin - 1] in "._%+-")):
                begin -= 1
            if begin < at:
                out.append((0, begin, m.end()))
                end = m.end()
    if not DIGIT.search(t):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(map(small_part, m.group().split(".")))]
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in t:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def loose_spans(t: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the other kinds that touch no base span; of two that overlap the earlier kind stays."""
    found = []
    if DIGIT.search(t):
        found += [(4, m.start(), m.end()) for m in NATIONAL.finditer(t)] + [(5, m.start(), m.end()) for m in SSN.finditer(t)] + [(6, m.start(), m.end()) for m in IBAN.finditer(t)]
    low = t.lower()
    if any(w in low for w in SECRET_WORDS):
        found += [(7, m.start(1), m.end(1)) for m in CREDENTIAL.finditer(t)]
    if any(p in t for p in KEY_PREFIXES):
        found += [(8, m.start(), m.end()) for m in ACCESS_KEY.finditer(t)]
    if not found:
        return found
    marks = sorted((s, e) for _, s, e in taken)
    out = []
    for kind, s, e in found:
        if not any(a < e and s < z for a, z in marks if z > s):
            out.append((kind, s, e))
            marks.append((s, e))
    return out


def votes(t: str, kind: int, s: int, e: int) -> tuple[list[int], list[int]]:
    """(-1, 0 or 1 per labeler; 0 or 1 per shape feature)."""
    span, name = t[s:e], KINDS[kind]
    d = digits_of(span)
    before = t[max(0, s - 40):s].lower()
    left, right = t[s - 1:s], t[e:e + 1]
    if name == "email":
        local, _, host = span.partition("@")
        shape_ok, known = len(local) <= 64 and not host.startswith("-") and ".." not in local, host.rpartition(".")[2].lower() in TOP_DOMAINS
    elif name == "ip":
        shape_ok, known = all(len(p) < 4 and (p == "0" or p[0] != "0") for p in span.split(".")), None
    elif name == "card":
        shape_ok, known = len(d) in (13, 14, 15, 16, 19), d[0] in "3456"
    elif name == "phone":
        shape_ok, known = len(d) >= 10, d.startswith(COUNTRY_CODES)
    elif name == "local_phone":
        shape_ok, known = d[0] not in "01", None
    elif name == "ssn":
        shape_ok, known = d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000", None
    elif name == "iban":
        number = "".join(str(int(c, 36)) for c in span[4:] + span[:4])
        shape_ok, known = int(number) % 97 == 1, span[:2] in IBAN_COUNTRIES
    elif name == "credential":
        shape_ok, known = bool(d) and any(c.isalpha() for c in span), t[max(0, s - 12):s].lower().strip(" =:\"").endswith(SECRET_WORDS)
    else:
        shape_ok, known = bool(d) and any(c.isalpha() for c in span[4:]), span.startswith(KEY_PREFIXES)
    against = span.startswith(NOT_PERSONAL)
    cue = any(w in before for w in CUES[name])
    other = any(w in before[-20:] for w in OTHER_NUMBERS)
    apart = not (left.isalnum() or right.isalnum())
    variety = len(set(d)) if d else len(set(span))
    v = [1 if shape_ok else -1, 0 if known is None else (1 if known else -1), -1 if against else 0, 1 if cue else 0, -1 if other else 0, 1 if apart else -1, 1 if variety >= 4 else -1]
    f = [int(e - s > 12), int(e - s > 24), int(len(d) * 2 > e - s), int(left in ("", "\n")), int(any(c in span for c in " -()"))]
    return v, f


def pattern_code(v: list[int], f: list[int]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    for x in f:
        code = code * 2 + x
    return code


def read_code(code: int) -> tuple[list[int], list[int]]:
    f = [code >> i & 1 for i in reversed(range(SHAPES))]
    code >>= SHAPES
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x - 1)
    return v[::-1], f


# ---------------------------------------------------------------- reliabilities and classifier, over pattern counts
def reliabilities(v: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior per pattern, P(vote | truth) as (2, labelers, 3), prior) for one kind.  Starts from the sign of the vote sum."""
    q = np.clip(0.5 + v.sum(1) / (2 * LABELERS), 0.05, 0.95)
    table, prior = np.full((2, v.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = ((q * weight).sum() + 1) / (weight.sum() + 2)
        for y, share in ((1, q), (0, 1 - q)):
            for value in (-1, 0, 1):
                table[y, :, value + 1] = ((v == value) * (share * weight)[:, None]).sum(0)
            # One round's worth of faith that labelers are better than chance keeps the two classes from changing places.
            faith = np.array([0.2, 0.4, 0.4]) if y else np.array([0.4, 0.4, 0.2])
            table[y] = (table[y] + 10 * faith) / (table[y].sum(1, keepdims=True) + 10)
        log = [np.log(table[y])[np.arange(v.shape[1]), v + 1].sum(1) for y in (0, 1)]
        q = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -50, 50)))
    return q, table, float(prior)


def design(kinds: np.ndarray, v: np.ndarray, f: np.ndarray) -> np.ndarray:
    one_hot = (kinds[:, None] == np.arange(len(KINDS))).astype(float)
    return np.concatenate([one_hot, v == 1, v == -1, f], 1).astype(float)


@dataclass
class SpanModel:
    weights: np.ndarray
    accuracy: dict[str, list[float]]  # per kind and labeler: share of its votes that the posterior confirms

    def accepts(self, kind: int, code: int) -> bool:
        v, f = read_code(code)
        return bool((design(np.array([kind]), np.array([v]), np.array([f])) @ self.weights)[0] >= 0)


def fit_spans(counts: list[tuple[int, int, int]], rounds: int = 400) -> SpanModel:
    """`counts`: (kind, pattern, number of spans)."""
    counts = sorted(counts)
    kinds = np.array([c[0] for c in counts], int)
    read = [read_code(c[1]) for c in counts]
    v, f = np.array([r[0] for r in read]).reshape(-1, LABELERS), np.array([r[1] for r in read]).reshape(-1, SHAPES)
    weight, target, accuracy = np.array([c[2] for c in counts], float), np.zeros(len(counts)), {}
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own], table, prior = reliabilities(v[own], weight[own])
        right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
        cast = right + prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
        accuracy[KINDS[kind]] = (right / cast).tolist()
    x = design(kinds, v, f)
    w, share = np.zeros(x.shape[1]), weight / max(weight.sum(), 1)
    for _ in range(rounds if len(counts) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (p - target)) + 1e-4 * w)
    return SpanModel(w, accuracy)


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def propose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, base_sha256, kinds, starts, ends, codes: all candidates of every row, base kinds first."""
    base = docs.select(col(key).alias("k"), F.coalesce(col(text), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            digests, lists = [], ([], [], [], [])
            for t in b.column(1).to_pylist():
                fixed = base_spans(t)
                digests.append(hashlib.sha256(shown(fixed).encode()).hexdigest())
                spans = fixed + loose_spans(t, fixed)
                for column, values in zip(lists, (*zip(*spans, strict=True), [pattern_code(*votes(t, *s)) for s in spans]) if spans else ((),) * 4, strict=True):
                    column.append(list(values))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], ["k", "base_sha256", "kinds", "starts", "ends", "codes"])

    kind = base.schema["k"].dataType.simpleString()
    return base.mapInArrow(run, f"k {kind}, base_sha256 string, kinds array<int>, starts array<int>, ends array<int>, codes array<int>")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, SpanModel]:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added per row; the fitted model).

    Counts and digest are over base spans; spans has `kind:start:end` in code points, base kinds first, comma-joined.  Null and
    empty texts have no spans; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
    A credential's span is its value."""
    found = stored(propose(docs, key, text), "pii-candidates")
    counts = (found.select(F.explode(F.arrays_zip("kinds", "codes")).alias("c")).groupBy("c.kinds", "c.codes").agg(F.count(F.lit(1)).alias("n")).collect())
    model = fit_spans([(r["kinds"], r["codes"], r["n"]) for r in counts])
    accepted = {(r["kinds"], r["codes"]) for r in counts if r["kinds"] >= len(BASE) and model.accepts(r["kinds"], r["codes"])}

    def decide(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for ks, ss, es, cs in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                kept = sorted((k, s, e) for k, s, e, c in zip(ks, ss, es, cs, strict=True) if k < len(BASE) or (k, c) in accepted)
                for column, v in zip(out, (*[ks.count(k) for k in range(len(BASE))], shown(kept), sum(k >= len(BASE) for k, _, _ in kept)), strict=True):
                    column.append(v)
            longs = [pa.array(x, pa.int64()) for x in out[:4]]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, b.column(1), pa.array(out[4], pa.string()), pa.array(out[5], pa.int64())], ["k", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = found.schema["k"].dataType.simpleString()
    return found.mapInArrow(decide, f"k {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("k", key), model
