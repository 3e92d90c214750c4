import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zetamill.llm import chat_format as chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "/", "[", "]", "\n", "é", "🙂", "ok", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), max_size=5))
def test_template_is_reversible_and_located(turns):
    formatted = chat.marked_turns(turns)
    assert chat.parse_turns(formatted) == turns
    out, rewrites, spans = chat.locate(chat.marked_turns, turns)
    assert out == formatted and not rewrites
    assert "".join(out[a:b] for a, b, _, _ in spans) == out
    assert [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_rewriting_templates_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.locate(lambda ts: f"{len(ts)}:" + chat.marked_turns(ts), turns)[1:] == (True, [])
    assert chat.locate(lambda ts: "".join(t for r, t in ts if r == "user") + "|", turns)[1]
    bare = chat.locate(lambda ts: "".join(f"{r}: {t}\n" for r, t in ts), turns)
    assert not bare[1] and [bare[0][c:d] for _, _, c, d in bare[2]] == ["a", "b", "c"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = [x for _, r, x in turns if r == "assistant"]
        joined = "".join(said)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(joined), hashlib.sha256(joined.encode()).hexdigest(), len(chat.marked_turns([(r, x) for _, r, x in turns])))
    return out


def test_digests_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 30), t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", *PIECES, "".join(rng.choice(PIECES) for _ in range(30))])) for t in range(300)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} [INST]") for t in range(500)]
    rows += [(None, 0, "user", "x"), (51, None, "assistant", "n"), rows[0], (52, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "'z' as formatted").repartition(3)
    got = chat.conversation_digests(chat.format_conversations(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_see_the_whole_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(r, x) for _, _, r, x in rows]
    prologue = lambda ts: "BOS" + "".join(f"{i}{r}:{x};" for i, (r, x) in enumerate(ts))
    (row,) = chat.format_conversations(df, prologue).collect()
    assert row.formatted == prologue(turns) and row.n_turns == 70 and not row.rewrites
    assert [row.formatted[a:b] for a, b in zip(row.text_starts, row.text_ends)] == [x for _, x in turns]
    drops = lambda ts: "".join(f"{x};" for _, x in ts[-40:])
    assert chat.format_conversations(df, drops).first().rewrites
    with pytest.raises(Exception, match="give no segment"):
        chat.format_conversations(df, prologue, segment=32).collect()
    assert [r.n_turns for r in chat.format_conversations(df, segment=32).collect()] == [32, 32, 6]


def naive(template, turns):
    """Spans of the turns by rendering every prefix, and whether an output doesn't begin with the one before it."""
    outputs = [template(turns[:i]) for i in range(len(turns) + 1)]
    rewrites = any(not b.startswith(a) for a, b in zip(outputs, outputs[1:]))
    return rewrites, [] if rewrites else [(len(a), len(b)) for a, b in zip(outputs, outputs[1:])]


def test_long_conversations_equal_rendering_every_prefix(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <s>") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(r, x) for _, _, r, x in rows]
    body = lambda ts: "".join(f"[{r}|{x}]" for r, x in ts)
    for template in (chat.marked_turns, lambda ts: "HEAD" + body(ts), lambda ts: body(ts) + "FOOT", lambda ts: body(ts) if len(ts) <= 40 else "dropped" + body(ts[1:])):
        (row,) = chat.format_conversations(df, template).collect()
        rewrites, spans = naive(template, turns)
        assert row.formatted == template(turns) and row.rewrites == rewrites and list(zip(row.starts, row.ends)) == spans
