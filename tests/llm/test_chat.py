import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framescope.llm import chat
from framescope.llm.chat import CONTROLS, KNOWN, TEMPLATE, TemplateError, compile_template, fold_body, format_conversations, guarding, parse, read_back, turns_of, unguard

SCHEMA = "conv_id long, turn long, role string, text string, conv string, segment int, part int, loss string, first int, length int"


def rendered(source, messages, controls=(), **known):
    c = compile_template(source, controls, **known)
    text, mask, outer = [], [], {}

    def write(s, marked):
        text.append(s)
        mask.append((marked, s))
    c.before(outer, write)
    for i, m in enumerate(messages):
        c.each(outer | {c.name: m, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(messages) - 1, "length": len(messages)}}, write)
    c.after(outer, write)
    return "".join(text), "".join(s for marked, s in mask if marked)


def test_language():
    m = [{"role": "user", "text": "a b"}, {"role": "assistant", "text": None}]
    assert rendered("x{% for m in messages %}{{ loop.index }}:{{ m.role|upper }}={{ m['text'] }}{% if not loop.last %}, {% endif %}{% endfor %}y", m)[0] == "x1:USER=a b, 2:ASSISTANT=y"
    assert rendered("{% for m in messages %}{% if m.role == 'user' and 'b' in m.text or false %}U{% elif loop.index0 % 2 == 1 %}O{% else %}E{% endif %}{% endfor %}", m)[0] == "UO"
    assert rendered("{% set a = 'q' %}{%- for m in messages -%}  {{ a ~ (m.text|length) if m.text else \"n\\n\" }} {%- set a = 'z' -%}{% endfor %}{# no #}{{ a }}", m)[0] == "q3n\nq"
    assert rendered("{% for m in messages %}{% generation %}{{ m.role }}{% if loop.first %}!{% endif %}{% endgeneration %}.{% endfor %}", m) == ("user!.assistant.", "user!assistant")
    assert rendered("{% for m in messages %}{{ m.text.upper }}{{ m.__class__ }}{{ missing.x }}{% endfor %}", m)[0] == ""


def test_constants_are_folded():
    tree = fold_body(parse("{{ bos ~ '[' }}{% if system %}S{% elif bos == '<s>' %}B{% else %}N{% endif %}{% set x = bos %}{{ x|upper }}{% for m in messages %}{{ bos }}{{ m.text }}{% endfor %}"),
                     {"bos": "<s>", "system": None}, chat._FILTERS)
    assert tree == [("text", "<s>[B"), ("set", "x", ("const", "<s>")), ("text", "<S>"), ("for", "m", [("text", "<s>"), ("out", ("field", ("name", "m"), "text"))])]
    # A value set in a branch that is not decided is not known afterwards.
    assert rendered("{% set a = '1' %}{% if b %}{% set a = '2' %}{% endif %}{{ a }}{% for m in messages %}{% if m.text %}{% set c = '3' %}{% endif %}{{ c }}{% endfor %}", [{"text": "t"}, {"text": ""}])[0] == "13"


@pytest.mark.parametrize("source", ["{% for m in messages %}", "{{ }}", "{% if a %}x", "{{ a(b) }}", "{{ a.b.c() }}", "{% import os %}", "{{ m|exec }}{% for m in messages %}{% endfor %}", "no loop", "{% for m in other %}{% endfor %}",
                                    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% if a %}{% for m in messages %}{% endfor %}{% endif %}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@settings(max_examples=300, deadline=None)
@given(st.text("<>/s[]INST ROLE\\é\n", max_size=40))
def test_guard_is_reversible_and_leaves_no_control(text):
    safe = guarding(CONTROLS)(text)
    assert unguard(safe) == text and not any(c in safe for c in CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[ROLE]x", ""]), st.text("<>/s[]INST ROLE\\é\n", max_size=30)), max_size=6))
def test_round_trip(turns):
    text, loss = rendered(TEMPLATE, [{"role": r, "text": t} for r, t in turns], CONTROLS, **KNOWN)
    assert list(turns_of(text)) == turns
    assert unguard(loss) == "".join(t for r, t in turns if r == "assistant")


def plain(rows):
    groups, out = {}, set()
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        whole = rendered(TEMPLATE, [{"role": r, "text": t} for r, t in turns], CONTROLS, **KNOWN)[0]
        out.add((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole)))
    return out


@pytest.mark.parametrize("limits", [{}, {"segment_turns": 3, "part_chars": 40}, {"segment_turns": 2, "part_chars": 1 << 22}])
def test_tables(spark, limits):
    rnd = random.Random(1)
    odd = ["</s>[INST] ok [/INST]", "<s>", "\\", "plain \\[INST]", None, "", "é" * 50, "x" * 100_000]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(odd)) for c in range(12) for t in range(rnd.randint(1, 25))]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (-1, 0, "assistant", "</s>")]
    rnd.shuffle(rows)
    turns = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4) for r in rows], SCHEMA)
    parts = format_conversations(turns, TEMPLATE, CONTROLS, KNOWN, **limits)
    assert {tuple(r) for r in read_back(parts).collect()} == plain(rows)
    # Head and foot of a template stand once, however a conversation is cut.
    whole = {}
    for r in format_conversations(turns, "{% set a = 'h' %}{{ a }}{% for m in messages %}{{ a }}{{ loop.index }}/{{ loop.length }}{% if loop.last %}.{% endif %}{% endfor %}f", (), **limits).orderBy("segment", "part").collect():
        whole[r.conv] = whole.get(r.conv, "") + r.text
    assert whole[3] == "h" + "".join(f"h{i + 1}/{n}" for n in [sum(x[0] == 3 for x in rows)] for i in range(n)) + ".f"


def test_empty_table(spark):
    assert read_back(format_conversations(spark.createDataFrame([], SCHEMA), TEMPLATE, CONTROLS, KNOWN)).count() == 0
