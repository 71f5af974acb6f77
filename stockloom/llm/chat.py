"""Chat formatting with tool-call linking.

Messages are rows (conv_id, turn, role, text). An assistant's text that is a JSON object with ``tool_calls``
(a list of {id, name, arguments}) holds calls; a tool's text that is a JSON object with ``tool_call_id`` is a result.
Calls and results are hash-joined by (conv_id, identifier); an argument that is the string ``$identifier`` makes a call
depend on that call's result. Dependencies are levelled by repeated joins until nothing changes, which gives every row a
place that no dependency comes after: order by (conv_id, sort_turn, depth, turn, part). Each round of joins settles a level
of all conversations at once, so there are as many rounds as the deepest chain has calls. Arguments are
checked against the tools' JSON schemas (a dictionary, or a table of name and schema), and every row is written as canonical JSON (sorted keys, no spaces).
One row comes out for each message, call and result; a conversation is never gathered, so one of any length is fine.

Edge cases: null text is an empty message (no content field); text that is no such JSON stays a message; a repeated identifier
is won by the earliest turn, the others are not linked (error "duplicate"); a result without a call is "orphan", a call without
a result is not linked; calls in a cycle have error "cycle" and depth null; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import shared

#: Example tools: name -> JSON schema of the arguments.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculator": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "quote": {"type": "object", "required": ["ticker"], "properties": {"ticker": {"type": "string"}, "fields": {"type": "array", "items": {"type": "string"}}}},
}
#: Tools of a table that fit into every task.
MOST_TOOLS = 100_000
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fault(value: object, schema: dict, path: str = "$") -> str | None:
    """The first violation of a schema (type, enum, required, properties, additionalProperties, items), or None; a part of a
    schema that is not of its proper form, and an unknown type, ask for nothing."""
    kinds = schema.get("type")
    known = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and k in _KINDS]
    if known and not any(isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in known):
        return f"{path}: not {' or '.join(known)}"
    if isinstance(schema.get("enum"), list) and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, dict):
        required = schema.get("required")
        for name in required if isinstance(required, list) else ():
            if name not in value:
                return f"{path}: {name} missing"
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        for name in sorted(value):
            if isinstance(known.get(name), dict):
                if why := fault(value[name], known[name], f"{path}.{name}"):
                    return why
            elif name not in known and schema.get("additionalProperties") is False:
                return f"{path}: {name} unknown"
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            if why := fault(x, schema["items"], f"{path}[{i}]"):
                return why
    return None


def _references(value: object) -> list[str]:
    if isinstance(value, str):
        return [value[1:]] if value.startswith("$") and len(value) > 1 else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for x in inner for r in _references(x)]


def _object(text: str | None) -> dict:
    try:
        out = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    return out if isinstance(out, dict) else {}


PARTS = "conv_id long, turn long, part int, kind string, call_id string, name string, refs array<string>, fault string, json string"


def parts(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Messages taken apart into rows of kind message, call and result, each with its canonical JSON."""

    def take_apart(role: str | None, text: str | None) -> Iterator[tuple]:
        found = _object(text) if role in ("assistant", "tool") and text and text.lstrip()[:1] == "{" else {}
        calls = found.get("tool_calls")
        if role == "assistant" and isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            if found.get("content") is not None:
                yield "message", None, None, [], None, canonical({"content": found["content"], "role": role})
            for c in calls:
                name, arguments = c.get("name"), c.get("arguments")
                if isinstance(arguments, str):
                    arguments = _object(arguments) or arguments
                why = fault(arguments, tools[name]) if isinstance(name, str) and name in tools else "unknown tool"
                yield "call", c["id"], name if isinstance(name, str) else None, sorted(set(_references(arguments))), why, canonical({"role": role, "tool_call": {"arguments": arguments, "id": c["id"], "name": name}})
        elif role == "tool" and isinstance(found.get("tool_call_id"), str):
            yield "result", found["tool_call_id"], None, [], None, canonical({"content": found.get("content"), "role": role, "tool_call_id": found["tool_call_id"]})
        else:
            body = {"role": role} if text is None else {"content": text, "role": role}
            yield "message", None, None, [], None, canonical(body)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("refs", pa.list_(pa.string())), ("fault", pa.string()), ("json", pa.string())])
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
            out = [(conv, turn, i, *p) for conv, turn, role, text in zip(*columns, strict=True) for i, p in enumerate(take_apart(role, text))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, PARTS)


def _levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, sort_turn, depth of each call: one level below the deepest call whose result it needs."""
    known = shared.written(calls.select("conv_id", "call_id", "turn", "refs", F.col("turn").alias("sort_turn"), F.when(F.size("refs") == 0, F.lit(0)).alias("depth")))
    needs = shared.written(known.where(F.size("refs") > 0).select("conv_id", "call_id", F.explode("refs").alias("ref")))
    if not needs.head(1):
        return known
    had = results.select("conv_id", F.col("call_id").alias("ref"), F.col("turn").alias("result_turn"))
    real = shared.written(needs.join(had, ["conv_id", "ref"]))  # references to nothing do not bind
    free = known.join(real.select("conv_id", "call_id").distinct().withColumn("bound", F.lit(True)), ["conv_id", "call_id"], "left")
    known = shared.written(free.select("conv_id", "call_id", "turn", "refs", "sort_turn", F.when(F.col("bound").isNull(), F.lit(0)).alias("depth")))
    while True:
        done = known.where("depth is not null").select("conv_id", F.col("call_id").alias("ref"), F.col("sort_turn").alias("ref_turn"), F.col("depth").alias("ref_depth"))
        ready = real.join(done, ["conv_id", "ref"], "left").groupBy("conv_id", "call_id").agg(
            F.max("ref_depth").alias("deep"), F.max(F.greatest("ref_turn", "result_turn")).alias("late"), F.count_if(F.col("ref_depth").isNull()).alias("open"))
        step = known.join(ready, ["conv_id", "call_id"], "left")
        new = F.col("depth").isNull() & (F.col("open") == 0)
        step = shared.written(step.select("conv_id", "call_id", "turn", "refs", F.when(new, F.greatest("sort_turn", "late")).otherwise(F.col("sort_turn")).alias("sort_turn"), F.when(new, F.col("deep") + 2).otherwise(F.col("depth")).alias("depth")))
        before, after = (x.where("depth is null").count() for x in (known, step))
        known = step
        if after == before:
            return known


def tools_of(table: DataFrame, bound: int = MOST_TOOLS) -> dict[str, dict]:
    """The tools of a table (name, schema as JSON text). A schema that is no JSON object allows anything; of a name given twice the
    first schema in order of text counts. At most ``bound`` tools, as every task holds them all."""
    rows = table.where("name is not null").groupBy(F.col("name").cast("string").alias("name")).agg(F.min(F.col("schema").cast("string")).alias("schema")).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} tools")
    return {r["name"]: _object(r["schema"]) for r in rows}


def link(messages: DataFrame, tools: dict[str, dict] | DataFrame = TOOLS) -> DataFrame:
    """conv_id, turn, part, kind, call_id, name, linked, valid, error, sort_turn, depth, json."""
    rows = shared.written(parts(messages, tools_of(tools) if isinstance(tools, DataFrame) else tools))
    spot = F.struct("turn", "part")
    firsts = rows.where("kind <> 'message'").groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", spot)).alias("call_at"), F.min(F.when(F.col("kind") == "result", spot)).alias("result_at"))
    firsts = shared.written(firsts)
    calls = rows.where("kind = 'call'").join(firsts, ["conv_id", "call_id"]).where(F.col("call_at") == spot).dropDuplicates(["conv_id", "call_id"])
    results = firsts.where("result_at is not null").select("conv_id", "call_id", F.col("result_at.turn").alias("turn"))
    levels = _levels(calls, results).select("conv_id", "call_id", "sort_turn", "depth", F.lit(True).alias("levelled"))
    tied = rows.join(firsts, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = F.when(is_call, F.col("call_at") == spot).when(is_result, F.col("result_at") == spot)
    other = F.when(is_call, F.col("result_at").isNotNull()).when(is_result, F.col("call_at").isNotNull())
    cycle = F.col("levelled") & F.col("depth").isNull()
    error = F.when(is_call | is_result, F.when(~own, "duplicate").when(is_result & ~other, "orphan").when(cycle, "cycle").otherwise(F.col("fault")))
    depth = F.when(is_call & own, F.col("depth")).when(is_result & own & other, F.col("depth") + 1).otherwise(0)
    turn = F.when((is_call | is_result) & own & other | is_call & own, F.greatest("turn", F.coalesce("sort_turn", "turn"))).otherwise(F.col("turn"))
    return tied.select("conv_id", "turn", "part", "kind", "call_id", "name", F.when(is_call | is_result, own & other).alias("linked"), F.when(is_call, F.col("fault").isNull()).alias("valid"), error.alias("error"), turn.alias("sort_turn"), depth.alias("depth"), "json")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(shared.read(spark, sf_dir, "conversations"))


ORACLE_SQL = None
