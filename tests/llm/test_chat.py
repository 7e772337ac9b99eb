from __future__ import annotations

import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import chat as C


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*C.CONTROL, C.JOINER, "<", "[", "|", "a", "é", "\n", "<|role", "|>"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text
    assert not any(c in safe for c in C.CONTROL)
    chunk, lo, hi = C.format_turn(text, text)
    assert C.read_turns(chunk + chunk) == [(text, text)] * 2
    assert C.unescape(chunk[lo:hi]) == text


RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"conv_id": 2, "messages": []}, "messages", []),
    ({"conv_id": 2, "messages": None}, "messages", []),
    ({"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "from_value", [("user", "q"), ("assistant", "r")]),
    ({"id": 4, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"id": 5, "prompt": "p", "response": "r", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"completion": "c", "prompt": {"x": 1}, "id": 6}, None, None),
    ({"id": 7, "instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"id": 8, "instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"meta": {"id": 9}, "dialog": {"turns": [{"speaker": "bot", "utterance": "x</s>"}]}}, "nested_dialog", [("assistant", "x</s>")]),
    ({"conv_id": 10, "turn": 3, "role": "user", "text": "t"}, "turn_rows", [("user", "t")]),
    ({"conv_id": "x", "turn": 3, "role": "user", "text": "t"}, None, None),
    ({"conv_id": 2 ** 70, "turn": 3, "role": "user", "text": "t"}, None, None),
    ({"conv_id": None, "turn": None, "role": None, "text": 5}, "turn_rows", [("", "5")]),
    ({"id": 11, "answer": "?"}, None, None),
]


def test_layouts_by_fingerprint(spark):
    raw = [(json.dumps(r), i) for i, (r, *_) in enumerate(RECORDS)] + [("{broken", 0), (None, 0), ("[1]", 0), ("", 0)]
    df = spark.createDataFrame(raw, "record string, layout long")
    got = C.canonical(df).collect()
    unknown = [r for r in got if r["layout"] is None]
    assert len(unknown) == sum(1 for _, n, _ in RECORDS if n is None) + 4
    assert {r["raw"] for r in unknown if r["fingerprint"]} == {json.dumps(r) for r, n, _ in RECORDS if n is None}
    want = sorted((str(C._at(r, C.MAPPINGS[n]["id"])), role, text, n) for r, n, t in RECORDS if n for role, text in t)
    assert sorted((str(r["conv_id"]), r["role"], r["text"], r["layout"]) for r in got if r["layout"]) == want
    assert C.canonical(df.limit(0)).count() == 0


def test_fingerprint_ignores_order_and_values():
    a = {"x": [{"b": 1, "a": 2}, {"c": None}], "y": {"z": "v"}}
    assert C.paths(a) == {"x[].a", "x[].b", "x[].c", "y.z"}
    assert C.fingerprint(C.paths(a)) == C.fingerprint(C.paths({"y": {"z": 9}, "x": [{"c": 1, "a": "q", "b": []} | {"b": 0}]}))
    assert len(C.by_fingerprint()) == len({f for m in C.MAPPINGS.values() for f in C.variants(m)})


def test_digests_of_formatted_conversations(spark, monkeypatch):
    rnd = random.Random(1)
    rows = []
    for c in [*range(40), None]:
        for t in range(rnd.randint(1, 7)):
            text = rnd.choice([None, "", "plain", "</s>[INST] ok [/INST]", C.END, f"<{C.JOINER}|end|>", "x" * 30_000, "é\n" * 50])
            rows.append((c, t if rnd.random() < 0.9 else 0, rnd.choice(["user", "assistant", "system", None, "<|text|>"]), text))
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "v") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    monkeypatch.setattr(C, "table", lambda *_: df)
    got = {r["conv_id"]: r for r in C.op2_chat(spark, "").collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        said = [text for _, role, text in turns if role == "assistant"]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len("".join(said))
        assert r["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(C.format_turn(a, b)[0]) for _, a, b in turns)
