"""Chat formatting: exact round trips, layouts, loss spans."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import chat

TRICKY = ["", "\\### Assistant: </turn> ok", "####", "<</turn></turn>", "\\", "\\\\/turn>", "a\n### user: b</turn>\n", "#\\#", "</turn", "/turn>", "é\u2028🙂"]


@pytest.mark.parametrize("text", TRICKY)
def test_escaped_texts(text):
    check_segment("assistant", text)
    check_segment(text, text)


@settings(max_examples=300, deadline=None, database=None)
@given(st.text(alphabet="#</turn>\\: a\n"), st.text(alphabet="#</turn>\\: a\n"))
def test_any_text(role, text):
    check_segment(role, text)


def check_segment(role, text):
    out, start, past = chat.segment(role, text, (role,))
    assert chat.parsed(out) == (role, text) and chat.unescape(out[start:past]) == text
    assert "###" not in out[4:-len(chat.CLOSE)] and "</turn>" not in out[:-len(chat.CLOSE)]


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(chat.segment(r, t, ())[0]) for r, t in turns))


def read(records):
    rows = chat.read_back(chat.format_turns(chat.turns(records))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    assert read(chat.turn_records(rows)) == {k: digests(v) for k, v in want.items()}


def test_odd_rows(spark):
    kind = "conv_id long, turn int, role string, text string, record string"
    rows = spark.createDataFrame(
        [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (None, 0, "user", "n", "x"),
         (2, 5, "tool: x", "same", "x"), (2, 5, "tool: x", "same", "x"), (3, 0, "assistant", "long " * 200_000, "x")]
        + [(4, k, "user", t, "x") for k, t in enumerate(TRICKY)], kind)
    want = {1: [("", "first"), ("user", ""), ("assistant", "b")], None: [("user", "n")], 2: [("tool: x", "same")] * 2,
            3: [("assistant", "long " * 200_000)], 4: [("user", t) for t in TRICKY]}
    assert read(chat.turn_records(rows)) == {k: digests(v) for k, v in want.items()}
    assert read(chat.turn_records(rows.limit(0))) == {}


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"id": 3, "system": "s", "messages": [{"role": "user", "content": None}]}, [("system", "s"), ("user", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o", "system": "s"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"completion": "c", "prompt": "p", "id": "z"}, [("user", "p"), ("assistant", "c")]),
        ({"context": "c", "question": "q", "answer": 42}, [("user", "c\n\nq"), ("assistant", "42")]),
        ({"unknown": {"deep": 1}}, None), ([1], None), ({"messages": []}, None), ({}, None)]
    texts = [json.dumps(r) for r, _ in records] + [None, "", "no json", "{"]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn long, record string")
    out = {}
    for r in sorted(chat.turns(rows).collect(), key=lambda r: (r.conv_id, r.part)):
        out.setdefault(r.conv_id, []).append((r.role, r.text) if r.layout else None)
    assert out == {k: [None] if w is None else w for k, (_, w) in enumerate(records)} | {k: [None] for k in range(12, 16)}


def test_fingerprint_ignores_order_and_values():
    a, b = {"a": 1, "b": [{"c": 2}, {"c": None}]}, {"b": [{"c": "x"}], "a": None}
    assert chat.fingerprint(chat.leaves(a)) == chat.fingerprint(chat.leaves(b)) != chat.fingerprint(chat.leaves({"a": 1}))
