"""Chat formatting with a small template compiler.

A template is read into a syntax tree, constants are folded (values known beforehand, operators on them, conditions that they
decide, neighbouring text), and what is left becomes nested Python closures.  The language is a sandbox: names, fields
of dictionaries, literals, `~`, comparisons, `and`/`or`/`not`, a few filters, `if`, `set`, `generation`, and one loop over the messages.  There are no
calls, no attributes of Python objects and no other loops, so rendering reads nothing but the messages and always ends.

Text inside `{% generation %}` is under the loss mask.  The filter `guard` takes control strings of a template out of a text by
an escape character after their first one; `unguard` undoes that exactly.

A conversation may hold a third of all rows: it is cut into segments of turns, each formatted in a task of its own as one or more parts of
bounded length, and read back part by part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.storage import col

PART_CHARS = 1 << 22
SEGMENT_TURNS = 4096
ESCAPE = "\\"


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- control strings
def guarding(controls: tuple[str, ...]) -> Callable[[str], str]:
    """Texts without any of the control strings (two characters or more each, none with the escape character)."""
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
    find = re.compile(f"{re.escape(ESCAPE)}|{heads}" if heads else re.escape(ESCAPE))
    return lambda text: find.sub(lambda m: m.group() + ESCAPE, text)


_ESCAPED = re.compile(r"\\(\\?)")


def unguard(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# ---------------------------------------------------------------- syntax tree
# Expressions: ("const", v) ("name", n) ("field", e, f) ("join", a, b) ("test", op, a, b) ("and"|"or", a, b) ("not", a) ("pick", cond, a, b) ("filter", e, name)
# Statements: ("text", s) ("out", e) ("if", [(cond, body)], other) ("for", name, body) ("set", name, e) ("generation", body)
_PIECES = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>~%|.()\[\]=]))""")
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Tokens:
    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, kind: str, value: str | None = None) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != kind or value not in (None, self.items[self.at][1]):
            raise TemplateError(f"expected {value or kind} at {self.items[self.at:]}")
        self.at += 1
        return self.items[self.at - 1][1]

    def end(self):
        if self.at < len(self.items):
            raise TemplateError(f"too much: {self.items[self.at:]}")

    # Loosest first: choice, or, and, not, comparison, ~, filters and fields.
    def expression(self):
        value = self.either()
        if self.take("if"):
            cond = self.either()
            return ("pick", cond, value, self.expression() if self.take("else") else ("const", ""))
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = ("or", value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = ("and", value, self.negated())
        return value

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        for op in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self.take(op):
                return ("test", op, value, self.joined())
        return value

    def joined(self):
        value = self.remainder()
        while self.take("~"):
            value = ("join", value, self.remainder())
        return value

    def remainder(self):
        value = self.applied()
        while self.take("%"):
            value = ("test", "%", value, self.applied())
        return value

    def applied(self):
        value = self.atom()
        while True:
            if self.take("|"):
                value = ("filter", value, self.need("name"))
            elif self.take("."):
                value = ("field", value, self.need("name"))
            elif self.take("["):
                value = ("field", value, _string(self.need("str")))
                self.need("op", "]")
            else:
                return value

    def atom(self):
        if self.take("("):
            value = self.expression()
            self.need("op", ")")
            return value
        kind, text = self.items[self.at] if self.at < len(self.items) else ("end", "")
        self.at += 1
        if kind == "str":
            return ("const", _string(text))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text.lower()]) if text.lower() in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"a value is missing before {text!r}")


def _string(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)


def parse(source: str) -> list:
    pieces = _PIECES.split(source)
    for i in range(1, len(pieces), 2):  # {%- and -%} take white space away
        if pieces[i][2:3] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3:-2] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    items = [(i % 2, p) for i, p in enumerate(pieces) if p and not p.startswith("{#")]
    items.reverse()
    tree, closed = _block(items, ())
    assert closed is None
    return tree


def _block(items: list, until: tuple[str, ...]) -> tuple[list, Tokens | None]:
    body = []
    while items:
        special, piece = items.pop()
        if not special:
            body.append(("text", piece))
            continue
        t = Tokens(piece[2:-2].strip("-"))
        if piece.startswith("{{"):
            body.append(("out", t.expression()))
            t.end()
            continue
        if t.peek(*until):
            return body, t
        if t.take("if"):
            branches, other, cond = [], [], t.expression()
            while True:
                t.end()
                inner, t = _block(items, ("elif", "else", "endif"))
                if cond is None:
                    other = inner
                else:
                    branches.append((cond, inner))
                if t.take("endif"):
                    break
                cond = t.expression() if t.take("elif") else t.take("else") and None
            body.append(("if", branches, other))
        elif t.take("for"):
            name = t.need("name")
            t.need("name", "in")
            t.need("name", "messages")
            t.end()
            inner, t = _block(items, ("endfor",))
            t.take("endfor")
            body.append(("for", name, inner))
        elif t.take("generation"):
            t.end()
            inner, t = _block(items, ("endgeneration",))
            t.take("endgeneration")
            body.append(("generation", inner))
        elif t.take("set"):
            name = t.need("name")
            t.need("op", "=")
            body.append(("set", name, t.expression()))
        else:
            raise TemplateError(f"unknown statement {piece}")
        t.end()
    if until:
        raise TemplateError(f"no {until[-1]}")
    return body, None


# ---------------------------------------------------------------- values
def _shown(v) -> str:
    return "" if v is None else str(v)


def _number(v) -> int:
    return v if isinstance(v, int) else 0


_TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _shown(a) in _shown(b), "%": lambda a, b: _number(a) % (_number(b) or 1),
          "<": lambda a, b: _number(a) < _number(b), ">": lambda a, b: _number(a) > _number(b),
          "<=": lambda a, b: _number(a) <= _number(b), ">=": lambda a, b: _number(a) >= _number(b)}
_FILTERS = {"trim": lambda v: _shown(v).strip(), "upper": lambda v: _shown(v).upper(), "lower": lambda v: _shown(v).lower(), "title": lambda v: _shown(v).title(),
            "length": lambda v: len(_shown(v)), "tojson": lambda v: json.dumps(v, ensure_ascii=False)}


def fold(e, known: dict, filters: dict):
    """The expression with everything computed that `known` decides."""
    kind = e[0]
    if kind == "name":
        return ("const", known[e[1]]) if e[1] in known else e
    if kind == "const":
        return e
    if kind == "filter":
        if e[2] not in filters:
            raise TemplateError(f"unknown filter {e[2]}")
        inner = fold(e[1], known, filters)
        return ("const", filters[e[2]](inner[1])) if inner[0] == "const" else ("filter", inner, e[2])
    if kind == "field":
        inner = fold(e[1], known, filters)
        return ("const", inner[1].get(e[2]) if isinstance(inner[1], dict) else None) if inner[0] == "const" else ("field", inner, e[2])
    parts = [fold(x, known, filters) if isinstance(x, tuple) else x for x in e[1:]]
    values = [x[1] for x in parts if isinstance(x, tuple) and x[0] == "const"]
    if kind in ("and", "or", "pick") and parts[0][0] == "const":
        first = bool(parts[0][1])
        if kind == "pick":
            return parts[1] if first else parts[2]
        return parts[1] if first == (kind == "and") else parts[0]
    if len(values) == sum(isinstance(x, tuple) for x in parts):
        if kind == "test":
            return ("const", _TESTS[parts[0]](*values))
        if kind == "join":
            return ("const", _shown(values[0]) + _shown(values[1]))
        if kind == "not":
            return ("const", not values[0])
    return (kind, *parts)


def fold_body(body: list, known: dict, filters: dict) -> list:
    out = []
    known = dict(known)

    def put(text: str):
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + text)
        elif text:
            out.append(("text", text))

    for s in body:
        if s[0] == "text":
            put(s[1])
        elif s[0] == "out":
            e = fold(s[1], known, filters)
            put(_shown(e[1])) if e[0] == "const" else out.append(("out", e))
        elif s[0] == "if":
            branches, other = [], fold_body(s[2], known, filters)
            for cond, inner in s[1]:
                cond, inner = fold(cond, known, filters), fold_body(inner, known, filters)
                if cond[0] == "const" and not cond[1]:
                    continue
                if cond[0] == "const":
                    other = inner
                    break
                branches.append((cond, inner))
            for inner in [b for _, b in branches] + [other]:
                for name in _assigned(inner):
                    known.pop(name, None)
            if branches:
                out.append(("if", branches, other))
            else:
                for x in other:
                    put(x[1]) if x[0] == "text" else out.append(x)
        elif s[0] == "for":
            inside = {k: v for k, v in known.items() if k not in (s[1], "loop", *_assigned(s[2]))}
            out.append(("for", s[1], fold_body(s[2], inside, filters)))
        elif s[0] == "generation":
            out.append(("generation", fold_body(s[1], known, filters)))
            for name in _assigned(s[1]):
                known.pop(name, None)
        else:
            e = fold(s[2], known, filters)
            known.pop(s[1], None)
            if e[0] == "const":
                known[s[1]] = e[1]
            out.append(("set", s[1], e))
    return out


def _assigned(body: list) -> set[str]:
    names = set()
    for s in body:
        if s[0] == "set":
            names.add(s[1])
        elif s[0] == "if":
            for _, inner in s[1]:
                names |= _assigned(inner)
            names |= _assigned(s[2])
        elif s[0] in ("for", "generation"):
            names |= _assigned(s[-1])
    return names


# ---------------------------------------------------------------- closures
def closure(e, filters: dict) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "field":
        inner, name = closure(e[1], filters), e[2]

        def field(scope):
            v = inner(scope)
            return v.get(name) if isinstance(v, dict) else None
        return field
    if kind == "filter":
        inner, f = closure(e[1], filters), filters[e[2]]
        return lambda scope: f(inner(scope))
    if kind == "test":
        a, b, test = closure(e[2], filters), closure(e[3], filters), _TESTS[e[1]]
        return lambda scope: test(a(scope), b(scope))
    parts = [closure(x, filters) for x in e[1:]]
    if kind == "join":
        return lambda scope: _shown(parts[0](scope)) + _shown(parts[1](scope))
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    if kind == "not":
        return lambda scope: not parts[0](scope)
    return lambda scope: parts[1](scope) if parts[0](scope) else parts[2](scope)


Write = Callable[[str, bool], None]  # text, under the loss mask


def writer(body: list, filters: dict, marked: bool = False) -> Callable[[dict, Write], None]:
    steps = []
    for s in body:
        if s[0] == "text":
            steps.append(lambda scope, write, t=s[1]: write(t, marked))
        elif s[0] == "out":
            steps.append(lambda scope, write, e=closure(s[1], filters): write(_shown(e(scope)), marked))
        elif s[0] == "generation":
            steps.append(writer(s[1], filters, True))
        elif s[0] == "set":
            steps.append(lambda scope, write, n=s[1], e=closure(s[2], filters): scope.__setitem__(n, e(scope)))
        elif s[0] == "if":
            steps.append(partial(_choose, [(closure(c, filters), writer(b, filters, marked)) for c, b in s[1]], writer(s[2], filters, marked)))
        else:
            raise TemplateError("the loop over messages must stand outside of other statements")

    def run(scope, write):
        for step in steps:
            step(scope, write)
    return run


def _choose(branches, other, scope, write):
    for cond, body in branches:
        if cond(scope):
            body(scope, write)
            return
    other(scope, write)


@dataclass
class Compiled:
    before: Callable[[dict, Write], None]
    each: Callable[[dict, Write], None]
    after: Callable[[dict, Write], None]
    name: str  # of a message in the loop


def compile_template(source: str, controls: tuple[str, ...] = (), **known) -> Compiled:
    """`known` are values that folding may use; `guard` is the filter for `controls`.

    The template has one loop over `messages`, outside of other statements.  What is `set` before it is seen in it and after it; what a
    turn sets is gone with the turn.  Inside it there are `loop.index0`, `loop.index`, `loop.first`, `loop.last` and `loop.length`."""
    filters = _FILTERS | {"guard": lambda v, g=guarding(controls): g(_shown(v))}
    tree = fold_body(parse(source), known, filters)
    loops = [i for i, s in enumerate(tree) if s[0] == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over messages, outside of other statements")
    at = loops[0]
    return Compiled(writer(tree[:at], filters), writer(tree[at][2], filters), writer(tree[at + 1:], filters), tree[at][1])


# ---------------------------------------------------------------- over tables
PARTS = "conv {kind}, segment long, part int, text string, loss array<struct<start: long, end: long>>"


def format_conversations(turns: DataFrame, template: str, controls: tuple[str, ...], known: dict | None = None, segment_turns: int = SEGMENT_TURNS,
                         part_chars: int = PART_CHARS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, segment, part, text, loss: the formatted conversations in parts.  A conversation's text is that of its parts in order of
    (segment, part), nothing between; loss has the spans of its part that are under the loss mask, in code points.

    Turns go by number, null last, ties by role and text.  A null key is a conversation of its own, null roles and texts are empty ones.
    Repeated rows are turns each.  An empty table gives no rows; other columns are ignored.  A very long text is a part of its
    own: parts end after a turn that brings them to `part_chars`."""
    compiled = compile_template(template, controls, **(known or {}))
    kind = turns.schema[key].dataType.simpleString()
    t = turns.select(col(key).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(col(text), F.lit("")).alias("text"))
    t = t.withColumn("segment", F.coalesce(F.floor(F.col("turn") / F.lit(float(segment_turns))), F.lit((1 << 62))).cast("long"))
    # Where a segment's turns stand in their conversation, from counts.
    sizes = t.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("conv")
    ahead = w.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(F.col("conv").alias("c"), F.col("segment").alias("s"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("first"), F.sum("size").over(w).alias("length"))
    t = t.join(places, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    t = t.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "turn", "role", "text")

    def run(batches):
        out = {n: [] for n in ("conv", "segment", "part", "text", "loss")}
        kinds = None
        current, part, pieces, spans, at, index = None, 0, [], [], 0, 0

        def write(s: str, marked: bool):
            nonlocal at
            if s:
                if marked and spans and spans[-1]["end"] == at:
                    spans[-1]["end"] += len(s)
                elif marked:
                    spans.append({"start": at, "end": at + len(s)})
                pieces.append(s)
                at += len(s)

        def close():
            nonlocal part, pieces, spans, at
            for name, value in zip(out, (*current, part, "".join(pieces), spans), strict=True):
                out[name].append(value)
            part, pieces, spans, at = part + 1, [], [], 0

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))
            for v in out.values():
                v.clear()
            return b

        for b in batches:
            kinds = (b.schema.field("conv").type, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            done = 0
            for conv, segment, r, body, first, length in zip(*[b.column(n).to_pylist() for n in ("conv", "segment", "role", "text", "first", "length")], strict=True):
                if current != (conv, segment):
                    if pieces:
                        close()
                    current, part, index, outer = (conv, segment), 0, first, {}
                    # Every segment's first task step is the head of the template, for what it sets; only the first segment writes it.
                    compiled.before(outer, write if index == 0 else lambda s, marked: None)
                scope = outer | {compiled.name: {"role": r, "text": body, "content": body},
                                 "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": index == length - 1, "length": length}}
                compiled.each(scope, write)
                index += 1
                if index == length:
                    compiled.after(outer, write)
                if at >= part_chars:
                    done += at
                    close()
                if len(out["conv"]) >= 1000 or done >= part_chars:
                    done = 0
                    yield batch()
        if pieces:
            close()
        if out["conv"]:
            yield batch()

    return t.select("conv", "segment", "role", "text", "first", "length").mapInArrow(run, PARTS.format(kind=kind))


#: Turns between their marks; the loss mask covers what the assistant says and nothing else.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """{%- for m in messages -%}
{{ bos }}
{%- if m.role == 'user' %}{{ '[INST] ' ~ m.text|guard ~ ' [/INST]' }}
{%- elif m.role == 'assistant' %}{% generation %}{{ m.text|guard }}{% endgeneration %}{{ eos }}
{%- else %}{{ '[ROLE]' ~ m.role|guard ~ '[/ROLE]' ~ m.text|guard ~ eos }}
{%- endif %}
{%- endfor -%}
"""
KNOWN = {"bos": "<s>", "eos": "</s>"}


def turns_of(part: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a part that TEMPLATE wrote."""
    for body in part.split("<s>")[1:]:
        if body.startswith("[INST] "):
            yield "user", unguard(body[7:-8])
        elif body.startswith("[ROLE]"):
            role, _, text = body[6:-4].partition("[/ROLE]")
            yield unguard(role), unguard(text)
        else:
            yield "assistant", unguard(body[:-4])


def read_back(parts: DataFrame) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation that TEMPLATE formatted, from its parts.

    The digests run over a conversation in order, so it is one task's; that task holds one part at a time."""
    names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kind = parts.schema["conv"].dataType.simpleString()
    p = parts.repartition("conv").sortWithinPartitions("conv", "segment", "part")

    def run(batches):
        rows, current, state = [], None, None

        def done():
            n, turns, chars, loss, formatted = state
            rows.append((current[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for b in batches:
            kinds = (b.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            for conv, text, spans in zip(b.column("conv").to_pylist(), b.column("text"), b.column("loss"), strict=True):
                if current != (conv,):
                    if current is not None:
                        done()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans.as_py():
                    said = unguard(text[span["start"]:span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
                rows.clear()
        if current is not None:
            done()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return p.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_EXTRA = "+ ".join(f"(length({{t}}) - length(replace({{t}}, '{c}', ''))) // {len(c)} " for c in (ESCAPE, *CONTROLS))
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(text) + {_EXTRA.format(t="text")} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 ELSE 20 + length(role) + {_EXTRA.format(t="role")} END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::bigint AS formatted_chars FROM c GROUP BY 1
"""
