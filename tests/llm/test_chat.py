"""Chat formatting on hostile and on random conversations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentipanel.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def call(cid, name, args):
    return json.dumps({"content": None, "tool_calls": [{"id": cid, "name": name, "arguments": args}]})


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "-Infinity", "1e999", '"\\ud800"', "[" * 2000 + "]" * 2000, "[" * 300 + "]" * 300, "1" * 5000, "{"])
def test_hostile_json_is_a_message_or_malformed(bad):
    whole = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":%s}}]}' % bad
    assert chat._parse("assistant", whole, None) == [(0, "message", None, "ok", [], chat.canonical({"content": whole, "role": "assistant"}))]
    inside = call("a", "f", '{"x":%s}' % bad)
    assert [p[3] for p in chat._parse("assistant", inside, None)] == ["ok", "malformed"]
    result = '{"tool_call_id":"a","content":%s}' % bad
    assert chat._parse("tool", result, None)[0][1] == "message"


def test_finite_numbers_and_deep_values_stay():
    deep = "[" * 190 + "1.5" + "]" * 190
    parts = chat._parse("assistant", call("a", "f", '{"x":%s,"y":-0.0,"z":1e10}' % deep), None)
    assert parts[1][3] == "ok" and json.loads(parts[1][5])["arguments"]["z"] == 10000000000


def test_random_conversations_keep_their_links(spark):
    """A result is linked exactly if its call exists in its conversation; every part is canonical JSON."""
    rng = random.Random(6)
    rows = []
    for c in range(60):
        ids = []
        for t in range(rng.randint(1, 8)):
            kind = rng.choice(["text", "call", "result", "null"])
            if kind == "call":
                cid = f"k{rng.randrange(6)}-{t}"
                ids.append(cid)
                args = {"v": rng.choice([1, "two", [3], {"$result": rng.choice([*ids, "none"])}])}
                rows.append((c, t, "assistant", call(cid, "f", rng.choice([args, json.dumps(args), "not json"]))))
            elif kind == "result":
                rows.append((c, t, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": "r"})))
            else:
                rows.append((c, t, "user", "hello" if kind == "text" else None))
    out = chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("kind", F.lit("x"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.update({(c, t, p[0]): p for p in chat._parse(role, text or "", None)})
    assert {(r["conv_id"], r["turn"], r["part"]) for r in out} == set(want)
    for r in out:
        p = want[r["conv_id"], r["turn"], r["part"]]
        assert r["kind"] == p[1] and r["json"] == p[5] == chat.canonical(json.loads(p[5]))
