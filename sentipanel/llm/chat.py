"""Chat formatting with linked tool calls, in canonical JSON.

A turn's text is prose, or JSON of one of two forms:

* a message with calls: ``{"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}``
* a result, in a turn of role ``tool``: ``{"tool_call_id": ..., "content": ...}``

An argument ``{"$result": id}`` anywhere in the arguments stands for the result of another call.

Every turn becomes parts: one message, its calls, or a result.  Calls and results are joined by (conversation, identifier),
calls of a turn are ordered topologically by their references in rounds over the remaining references, arguments are
validated against the tools' schemas, and every part is written as canonical JSON (sorted keys, no white space, whole
numbers without a point).  One row per part: no task ever gathers a conversation, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, skew_join, text_of

MOST_NESTED = 200  # levels of lists and objects
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def references(value) -> list[str]:
    """Identifiers of the results that a value stands for."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for x in value.values() for r in references(x)]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema (type, enum, bounds, lengths, items, properties, required); references fit any schema."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kinds = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    is_a = lambda k: number and (k == "number" or value == int(value)) if k in ("number", "integer") else isinstance(value, _TYPES[k])
    if kinds and not any(is_a(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if number:
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: too short"] * (len(value) < schema.get(low, 0)) + [f"{at}: too long"] * (len(value) > schema.get(high, len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in props:
                out += violations(x, props[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def _depth(value) -> int:
    """Levels of lists and objects, found without recursion."""
    most, open_ = 0, [(value, 1)]
    while open_:
        v, level = open_.pop()
        if isinstance(v, (dict, list)):
            most = max(most, level)
            open_ += [(x, level + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def _finite(digits: str) -> float:
    x = float(digits)
    if x in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return x


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def load(text: str):
    """The JSON value of a text.  ValueError if it is not JSON, holds NaN, an infinity, a number out of range or half a surrogate pair, or has more
    than MOST_NESTED levels."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_constant)
    except RecursionError:
        raise ValueError("too many levels") from None
    if _depth(value) > MOST_NESTED:
        raise ValueError("too many levels")
    json.dumps(value, ensure_ascii=False).encode("utf-8")  # a lone surrogate is a UnicodeEncodeError, which is a ValueError
    return value


def _parse(role: str | None, text: str, schemas: dict[str, dict] | None) -> list[tuple]:
    """Parts of a turn: (part, kind, call_id, status, references, json).  A turn whose text :func:`load` refuses is a plain message, a call with such
    arguments is malformed."""
    role = role or ""
    try:
        obj = load(text) if text[:1] == "{" else None
    except ValueError:
        obj = None
    if isinstance(obj, dict) and role == "tool" and isinstance(obj.get("tool_call_id"), str):
        body = {"content": obj.get("content"), "role": "tool", "tool_call_id": obj["tool_call_id"]}
        return [(0, "result", obj["tool_call_id"], "ok", [], canonical(body))]
    calls = obj.get("tool_calls") if isinstance(obj, dict) and role != "tool" else None
    if not isinstance(calls, list):
        return [(0, "message", None, "ok", [], canonical({"content": text, "role": role}))]
    parts = [(0, "message", None, "ok", [], canonical({"content": obj.get("content"), "role": role}))]
    for i, c in enumerate(calls, 1):
        c = c if isinstance(c, dict) else {}
        cid, name, args = c.get("id"), c.get("name"), c.get("arguments", {})
        if isinstance(args, str):
            try:
                args = load(args)
            except ValueError:
                args = None
        if not isinstance(cid, str) or not isinstance(name, str) or not isinstance(args, dict):
            status = "malformed"
        elif schemas is not None and name not in schemas:
            status = "unknown tool"
        else:
            status = "; ".join(violations(args, (schemas or {}).get(name, {}))) or "ok"
        parts.append((i, "call", cid if isinstance(cid, str) else None, status, sorted(set(references(args))), canonical({"arguments": args, "id": cid, "name": name})))
    return parts


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Parts of all turns, linked, ordered and in canonical JSON.

    Returns conv_id, turn, part, kind (message, call or result), level (calls of a turn in the order level, part are
    in topological order; null for calls on or behind a cycle), call_id, status, linked_turn, json.  ``status`` is ok or the
    first fault: malformed, unknown tool, the schema violations, duplicate id (an earlier call or result has
    it), cycle, unresolved reference (to a call of a later turn or none), no result, orphan result.  ``linked_turn`` is
    the turn of a call's result or of a result's call.  Null text is an empty message, a null role an empty role; rows that repeat
    a turn have equal results; null conversations are one conversation without links; an empty
    table gives an empty result; other input columns are dropped.
    """
    d = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("text"))
    kind = lambda c: d.schema[c].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "kind", "call_id", "status", "refs", "json"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for b in it:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                take, rows = [], []
                for i, (role, text) in enumerate(zip(s.column("role").to_pylist(), s.column("text").to_pylist())):
                    for p in _parse(role, text, schemas):
                        take.append(i)
                        rows.append(p)
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([s.column("conv_id").take(take), s.column("turn").take(take), *cols], ["conv_id", "turn", *names])
    parts = cut_lineage(d.mapInArrow(run, f"conv_id {kind('conv_id')}, turn {kind('turn')}, part int, kind string, call_id string, status string, refs array<string>, json string"))

    key = ["conv_id", "call_id"]
    at = F.struct("turn", "part")
    firsts = lambda k: (parts.where(F.col("kind") == k).where("conv_id is not null and call_id is not null").groupBy(*key)
                             .agg(F.min(at).alias(f"{k}_at")))
    ids = cut_lineage(firsts("call").join(firsts("result"), key, "full_outer"))

    # calls of one turn that refer to each other: rounds over what is left, as many as the longest chain in a turn
    refs = (parts.where("kind = 'call' and conv_id is not null").select("conv_id", "turn", "part", F.explode("refs").alias("call_id"))
                 .join(ids.select(*key, "call_at"), key, "left"))
    refs = cut_lineage(refs.select("conv_id", "turn", "part", F.col("call_at.turn").alias("on_turn"), F.col("call_at.part").alias("on_part")))
    lost = refs.where("on_turn is null or on_turn > turn").select("conv_id", "turn", "part", F.lit(True).alias("lost")).distinct()
    edges = refs.where("on_turn = turn").drop("on_turn").distinct()
    calls = parts.where("kind = 'call' and conv_id is not null").select("conv_id", "turn", "part").distinct()
    waiting = cut_lineage(edges)
    levels, level = None, 0
    place = ["conv_id", "turn", "part"]
    n = waiting.count()
    while n:
        held = waiting.select(*place).distinct()
        placed = (calls if levels is None else calls.join(levels, place, "left_anti")).join(held, place, "left_anti")
        levels = cut_lineage((levels.unionByName(placed.withColumn("level", F.lit(level))) if levels is not None else placed.withColumn("level", F.lit(level))))
        done = levels.select("conv_id", "turn", F.col("part").alias("on_part"))
        waiting = cut_lineage(waiting.join(done, ["conv_id", "turn", "on_part"], "left_anti").select(*edges.columns))
        left = waiting.count()
        level += 1
        if left == n:  # only cycles, and what waits for them, remain
            break
        n = left
    if not n:
        rest = calls.join(levels, place, "left_anti") if levels is not None else calls
        rest = rest.withColumn("level", F.lit(level))
        levels = levels.unionByName(rest) if levels is not None else rest
    levels = cut_lineage(levels.select(*place, "level"))

    linked = skew_join(parts, ids, key, "left").join(levels, place, "left").join(lost, place, "left")
    mine = F.struct("turn", "part")
    status = (F.when(F.col("status") != "ok", F.col("status"))
              .when((F.col("kind") == "call") & (F.col("call_at") != mine), "duplicate id")
              .when((F.col("kind") == "result") & F.col("call_at").isNull(), "orphan result")
              .when((F.col("kind") == "result") & (F.col("result_at") != mine), "duplicate id")
              .when((F.col("kind") == "call") & F.col("conv_id").isNotNull() & F.col("level").isNull(), "cycle")
              .when((F.col("kind") == "call") & F.coalesce("lost", F.lit(False)), "unresolved reference")
              .when((F.col("kind") == "call") & F.col("result_at").isNull(), "no result").otherwise("ok"))
    other = F.when(F.col("kind") == "call", F.col("result_at.turn")).when(F.col("kind") == "result", F.col("call_at.turn"))
    return linked.select("conv_id", "turn", "part", "kind", F.when(F.col("kind") == "call", F.col("level")).otherwise(0).alias("level"), "call_id",
                         status.alias("status"), other.alias("linked_turn"), "json")
