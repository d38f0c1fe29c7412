import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import chat_format as C

TEXT = st.text(alphabet=st.sampled_from(list("ab<|\\>im_start end\n")), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", ""]), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    formatted, mask = C.render(turns)
    back, loss = C.read_back(formatted, mask)
    assert back == turns
    assert loss == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages"),
        (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}, "share"),
        (3, {"response": "b", "prompt": "a"}, "prompt"),
        (4, {"instruction": "do", "input": "", "output": "done"}, "instruction with input"),
        (5, {"unknown": 1}, None),
        (6, [1, 2], None),
        (7, {"messages": []}, None),
    ]
    rows = [(i, json.dumps(r), "x") for i, r, _ in records] + [(8, None, "x"), (9, "{broken", "x"), (3, json.dumps(records[2][1]), "x")]
    out = C.format_chats(spark.createDataFrame(rows, "conv_id long, record string, formatted string")).collect()
    layouts = {r.conv_id: r.layout for r in out}
    assert len(out) == len(rows) and layouts == {i: x for i, _, x in records} | {8: None, 9: None}
    shared = next(r for r in out if r.conv_id == 2)
    assert C.read_back(shared.formatted, shared.loss_mask) == ([("user", "hi"), ("assistant", "yes")], ["yes"])
    done = next(r for r in out if r.conv_id == 4)
    assert C.read_back(done.formatted, done.loss_mask)[0] == [("user", "do"), ("assistant", "done")]
    assert C.format_chats(spark.createDataFrame([], "conv_id long, record string")).count() == 0


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "<|im_end|>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {}
    for r in C.format_chats(C.as_records(frame), carry=C.ORDER).orderBy("conv_id", "turn", "role", "number").collect():
        out.setdefault(r.conv_id, []).extend(C.read_back(r.formatted, r.loss_mask)[0])
    assert out == {1: [("", "q"), ("assistant", "")], 2: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 3: [("system", "s"), ("user", "u"), ("assistant", "<|im_end|>")]}


def test_digests_of_long_conversations(spark):
    """One conversation holds most rows and is cut into many records; null ids, ties and repeated rows."""
    rows = [(7, t // 3, ("user", "assistant", None)[t % 3], f"text {t % 5} <|im_end|>") for t in range(400)] * 2
    rows += [(i, t, ("user", "assistant")[t], f"{i} {t}") for i in range(40) for t in range(2) if i != 7] + [(None, 0, "user", "x"), (None, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {}
    for i, t, role, text in sorted(((i, t, r or "", x or "") for i, t, r, x in rows), key=lambda r: (str(r[0]), *r[1:])):
        want.setdefault(i, []).append((role, text))
    for most in (1, 16, 1000):
        out = C.digests(C.format_chats(C.as_records(frame, most), carry=C.ORDER)).collect()
        assert len(out) == len(want)
        for r in out:
            turns = want[r.conv_id]
            loss = "".join(x for role, x in turns if role == "assistant")
            assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert r.formatted_chars == len(C.render(turns)[0])
    assert C.digests(C.format_chats(C.as_records(frame.limit(0)), carry=C.ORDER)).count() == 0


def test_odd_records(spark):
    deep = '{"a":' * 900 + "1" + "}" * 900
    rows = [
        (1, '{"messages[]":{"content":"a","role":"b"}}'),
        (2, '{"prompt":"\\ud800","response":"x"}'),
        (3, deep),
        (4, '{"a":' * 200_000 + "1" + "}" * 200_000),
        (5, '{"prompt":5,"response":"x"}'),
        (6, '{"messages":[{"role":"user","content":[{"text":"hi"}]}]}'),
        (7, '{"messages.role":"a"}'),
        (8, '{"prompt":null,"response":"x"}'),
        (9, "1" * 6000),
    ]
    out = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert {i: r.layout for i, r in out.items()} == dict.fromkeys(range(1, 10)) | {2: "prompt", 8: "prompt"}
    assert C.read_back(out[2].formatted, out[2].loss_mask)[0] == [("user", "�"), ("assistant", "x")]
    assert C.read_back(out[8].formatted, out[8].loss_mask)[0] == [("user", ""), ("assistant", "x")]


NAMES = st.sampled_from(["messages", "messages[]", "role", "content", "prompt", "response", "conversations", "from", "value", "instruction", "input", "output", "a.b", "\ud800", ""])
VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=True) | st.text(alphabet=st.characters(), max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, max_size=3), max_leaves=8)


@given(VALUES | st.dictionaries(NAMES, VALUES, max_size=4))
@settings(max_examples=400, deadline=None)
def test_no_record_raises(value):
    layouts = {C.fingerprint(C.layout_paths(x)): x for x in C.LAYOUTS}
    layout, turns = C.canonical_turns(C.parsed(json.dumps(value)), layouts)
    formatted, mask = C.render(turns)
    formatted.encode()
    assert C.read_back(formatted, mask)[0] == turns and (layout is not None or not turns)
