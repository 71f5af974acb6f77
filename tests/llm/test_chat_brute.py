"""Chat linking against a per-conversation brute force, with tools from a table."""

from __future__ import annotations

import json
import random

from stockloom.llm import chat


def brute(rows, tools):
    """(conv, turn, part, kind, call_id) -> (linked, error) and the order constraints call before result before dependent call."""
    firsts, parts = {}, []
    for conv, turn, role, text in rows:
        try:
            body = json.loads(text or "")
        except ValueError:
            body = None
        body = body if isinstance(body, dict) else {}
        if role == "assistant" and body.get("tool_calls"):
            for i, c in enumerate(body["tool_calls"]):
                parts.append((conv, turn, i, "call", c["id"], c))
        elif role == "tool" and isinstance(body.get("tool_call_id"), str):
            parts.append((conv, turn, 0, "result", body["tool_call_id"], None))
    for conv, turn, part, kind, ident, _ in parts:
        key = conv, kind, ident
        firsts[key] = min(firsts.get(key, (turn, part)), (turn, part))
    out = {}
    for conv, turn, part, kind, ident, c in parts:
        own = firsts[conv, kind, ident] == (turn, part)
        other = (conv, "result" if kind == "call" else "call", ident) in firsts
        why = None
        if not own:
            why = "duplicate"
        elif kind == "result" and not other:
            why = "orphan"
        elif kind == "call":
            why = chat.fault(c["arguments"], tools[c["name"]]) if c["name"] in tools else "unknown tool"
        out[conv, turn, part, kind, ident] = (own and other, why)
    return out, firsts, parts


def test_against_brute_force(spark):
    rng = random.Random(6)
    tools = {"find": {"type": "object", "required": ["q"], "properties": {"q": {"type": ["string", "null"]}}, "additionalProperties": False}, "any": {}, "odd": {"type": "nosuch", "required": 5, "items": 3}}
    rows = []
    for conv in range(60):
        made, results = [], []
        for turn in range(rng.randrange(2, 12)):
            if rng.random() < 0.5:
                calls = []
                for _ in range(rng.randrange(1, 4)):
                    ident = f"c{rng.randrange(8)}"
                    args = {"q": rng.choice(["x", None, 5] + [f"${r}" for r in results])} if rng.random() < 0.8 else {"p": 1}
                    calls.append({"id": ident, "name": rng.choice(["find", "any", "odd", "none"]), "arguments": args})
                    made.append(ident)
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif made:
                ident = rng.choice(made + ["zz"])
                results.append(ident)
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": ident, "content": "ok"})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice([None, "", "hi", "{broken", "[1]"])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    given = spark.createDataFrame([(n, json.dumps(x)) for n, x in tools.items()] + [(None, "{}"), ("any", "{}"), ("broken", "no json")], "name string, schema string")
    got = chat.link(table, given).collect()
    want, firsts, parts = brute(rows, tools)
    seen = {(r.conv_id, r.turn, r.part, r.kind, r.call_id): r for r in got if r.kind != "message"}
    assert set(seen) == set(want)
    for key, (linked, why) in want.items():
        assert seen[key].linked == linked and (seen[key].error == why or seen[key].error == "cycle"), key
    assert len([r for r in got if r.kind == "message"]) == len(rows) - len({p[:2] for p in parts})
    place = {k: (r.sort_turn, r.depth, r.turn, r.part) for k, r in seen.items() if r.error not in ("cycle", "duplicate") and r.depth is not None}
    for (conv, turn, part, kind, ident, c) in parts:
        at = place.get((conv, turn, part, kind, ident))
        if at is None:
            continue
        if kind == "result" and (conv, "call", ident) in firsts:
            call = place.get((conv, *firsts[conv, "call", ident], "call", ident))
            assert call is None or call < at
        for ref in chat._references(c["arguments"]) if kind == "call" else ():
            if (conv, "result", ref) in firsts and (conv, "call", ref) in firsts:
                result = place.get((conv, *firsts[conv, "result", ref], "result", ref))
                assert result is None or result < at
    assert {chat.canonical(json.loads(r.json)) for r in got} == {r.json for r in got}
