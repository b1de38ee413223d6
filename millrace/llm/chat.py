"""Chat formatting with tool-call linking.

Calls are JSON objects {"id", "name", "arguments"} under "tool_calls" in an assistant's text, results the texts of role
``tool`` with {"tool_call_id", "content"}.  Calls and results are hash-joined by (conversation, identifier).  Messages are
then ordered topologically: turn by turn, a result after its call, a call after the results that its arguments name
(strings "$id" or "${id}"); among messages that are free to go, the lowest turn goes first.  Arguments are validated
against the JSON schemas given (type, required, properties, enum, items, additionalProperties, minimum, maximum, pattern),
and a conversation is serialised as canonical JSON: sorted keys, no white space, no escapes but the necessary ones.

JSON that has no canonical form is malformed here: NaN, infinities and numbers beyond a double, and nesting deeper than
``DEPTH``.  Lone surrogates, which UTF-8 can't carry, become U+FFFD.  Everything is linear in a conversation's messages but
for sorting; one conversation is one row of the result, so it must fit a task.
"""

from __future__ import annotations

import heapq
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_text

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"


#: Most levels of arrays and objects in a message's JSON.
DEPTH = 100
SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    return SURROGATE.sub("\ufffd", json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a JSON schema (the supported keywords)."""
    wrong = []
    kinds = schema.get("type")
    if kinds:
        ok = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in ([kinds] if isinstance(kinds, str) else kinds))
        if not ok:
            return [f"{at}: not of type {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        wrong.append(f"{at}: not one of the values allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            wrong.append(f"{at}: out of range")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        wrong.append(f"{at}: doesn't match the pattern")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        wrong += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                wrong += problems(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                wrong.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            wrong += problems(v, schema["items"], f"{at}[{k}]")
    return wrong


def _refuse(text: str):
    raise ValueError(f"{text} is no JSON number")


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def _json(text: str | None):
    """The value of a JSON text; None if it is malformed, not finite or too deep."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    level, depth = [value], 0
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEPTH:
            return None
    return value


def _named(value) -> set[str]:
    """Identifiers that arguments name as "$id" or "${id}"."""
    if isinstance(value, str):
        return set(re.findall(r"\$\{?([A-Za-z0-9_-]+)\}?", value))
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(_named, inner)) if inner else set()


def assemble(messages: list[dict], linked: dict[str, bool], schemas: dict[str, dict]) -> tuple[str, dict[str, int]]:
    """Canonical JSON of a conversation and its counts. messages: turn, role, text; linked: identifier -> has its partner."""
    messages = sorted(messages, key=lambda m: (m["turn"] is None, m["turn"] or 0, m["role"] or "", m["text"] or ""))
    n = {"n_messages": len(messages), "n_calls": 0, "n_results": 0, "n_linked": 0, "n_orphans": 0, "n_invalid": 0}
    nodes, call_at, result_at = [], {}, {}
    for m in messages:
        node, needs = {"role": m["role"], "content": m["text"] or ""}, set()
        body = _json(m["text"]) if m["role"] in ("assistant", "tool") else None
        if m["role"] == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
            calls = []
            for c in body["tool_calls"]:
                if not isinstance(c, dict) or not isinstance(c.get("id"), str):
                    continue
                args = c.get("arguments")
                args = _json(args) if isinstance(args, str) else args
                wrong = problems(args, schemas[c.get("name")]) if c.get("name") in schemas else [] if isinstance(args, dict) or not schemas else ["$: unknown tool"]
                if not isinstance(args, dict):
                    wrong = wrong or ["$: arguments are no object"]
                n["n_calls"] += 1
                n["n_invalid"] += bool(wrong)
                has = bool(linked.get(c["id"]))
                n["n_linked"] += has
                n["n_orphans"] += not has
                calls.append({"id": c["id"], "name": c.get("name"), "arguments": args, "valid": not wrong, "linked": has})
                call_at.setdefault(c["id"], len(nodes))
                needs |= _named(args)
            node = {"role": "assistant", "content": body.get("content") or "", "tool_calls": calls}
        elif m["role"] == "tool" and isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
            n["n_results"] += 1
            has = bool(linked.get(body["tool_call_id"]))
            n["n_orphans"] += not has
            node = {"role": "tool", "content": body.get("content"), "tool_call_id": body["tool_call_id"], "linked": has}
            result_at.setdefault(body["tool_call_id"], len(nodes))
        nodes.append((node, needs))
    return canonical({"messages": [nodes[k][0] for k in _order(nodes, call_at, result_at)]}), n


def _order(nodes, call_at, result_at) -> list[int]:
    """Kahn's order, the lowest number first; of messages that wait for each other, the lowest goes first."""
    waits, followers = [0] * len(nodes), [[] for _ in nodes]
    for k, (node, needs) in enumerate(nodes):
        before = {result_at[i] for i in needs if i in result_at}
        if node["role"] == "tool" and node.get("tool_call_id") in call_at:
            before.add(call_at[node["tool_call_id"]])
        before.discard(k)
        waits[k] = len(before)
        for j in before:
            followers[j].append(k)
    ready, order, done, lowest = [k for k, n in enumerate(waits) if not n], [], [False] * len(nodes), 0
    while len(order) < len(nodes):
        if ready:
            k = heapq.heappop(ready)
        else:
            while done[lowest]:
                lowest += 1
            k = lowest
        if done[k]:
            continue
        order.append(k)
        done[k] = True
        for j in followers[k]:
            waits[j] -= 1
            if not waits[j] and not done[j]:
                heapq.heappush(ready, j)
    return order


SCHEMA = "conv_id long, n_messages long, n_calls long, n_results long, n_linked long, n_orphans long, n_invalid long, json string"


def format_conversations(conversations: DataFrame, schemas: dict[str, dict] | None = None, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: conv_id, counts of messages, calls, results, linked and orphaned, invalid arguments, json.

    Rows of a null conversation id form one conversation with a null id.  A null text is an empty message; null turns go
    last; ties are ordered by role, then text; repeated rows are repeated messages.  A call or result without its partner
    is kept and marked.  Malformed JSON (see above) is ordinary text, and as a call's arguments invalid.  Without schemas every object is valid; with schemas a tool
    that has none is invalid.  An empty table gives no row; other columns are not read.
    """
    m = conversations.select(F.col(f"`{id_column}`").cast("long").alias("conv_id"), F.col(f"`{turn_column}`").cast("long").alias("turn"), as_text(role_column).alias("role"), as_text(text_column).alias("text"))
    calls = (
        m.filter((F.col("role") == "assistant") & F.col("text").contains("tool_calls"))
        .select("conv_id", F.explode(F.from_json("text", CALLS)["tool_calls"]["id"]).alias("id"))
        .filter("id is not null")
        .distinct()
    )
    results = m.filter((F.col("role") == "tool") & F.col("text").contains("tool_call_id")).select(F.col("conv_id").alias("c"), F.get_json_object("text", "$.tool_call_id").alias("i")).filter("i is not null").distinct()
    both = calls.join(results.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")))
    linked = both.groupBy("conv_id").agg(F.collect_set("id").alias("ids")).select(F.col("conv_id").alias("c"), "ids")
    grouped = m.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("messages"))
    rows = grouped.join(linked, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "messages", "ids")
    schemas = schemas or {}
    counts = ("n_messages", "n_calls", "n_results", "n_linked", "n_orphans", "n_invalid")

    def run(batches):
        for batch in batches:
            out = [assemble(a.as_py(), dict.fromkeys(b.as_py() or [], True), schemas) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([n[k] for _, n in out], pa.int64()) for k in counts), pa.array([j for j, _ in out], pa.string())], ["conv_id", *counts, "json"])

    return rows.mapInArrow(run, SCHEMA)


#: The tool of ``measured``: arguments of more characters than that are invalid.
MOST_CHARS = 1200
SCHEMAS = {"measure": {"type": "object", "required": ["chars"], "additionalProperties": False, "properties": {"chars": {"type": "integer", "minimum": 1, "maximum": MOST_CHARS}}}}


def measured(conversations: DataFrame) -> DataFrame:
    """The conversations with a tool call in every assistant message and its result logged before it.

    The call's identifier is made of the turn, its arguments hold the message's length; the result stands one step too early,
    and there is none for messages without text.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    call = F.struct(F.concat(F.lit("call_"), turn.cast("string")).alias("id"), F.lit("measure").alias("name"), F.struct(F.length(text).alias("chars")).alias("arguments"))
    body = F.when(F.col("role") == "assistant", F.to_json(F.struct(text.alias("content"), F.array(call).alias("tool_calls")))).otherwise(F.col("text"))
    spoken = conversations.select("conv_id", (turn * 2 + F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("turn"), "role", body.alias("text"))
    result = F.to_json(F.struct(F.length(text).cast("string").alias("content"), F.concat(F.lit("call_"), turn.cast("string")).alias("tool_call_id")))
    results = conversations.filter((F.col("role") == "assistant") & (text != "")).select("conv_id", (turn * 2).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return spoken.unionByName(results)


def oracle() -> str:
    """For ``measured`` conversations: every result goes after its call, so the order is by turn, the call first."""
    return f"""
with own as (select conv_id, turn, role, coalesce(text, '') as content, length(coalesce(text, '')) as chars, role = 'assistant' as called from conversations),
spoken as (select conv_id, turn, 0 as step, role, content, chars, called, false as result, called and (chars < 1 or chars > {MOST_CHARS}) as invalid, called and chars > 0 as linked,
  case when called then '{{"content":' || cast(to_json(content) as varchar) || ',"role":"assistant","tool_calls":[{{"arguments":{{"chars":' || chars || '}},"id":"call_' || turn || '","linked":' || (chars > 0)::varchar || ',"name":"measure","valid":' || (chars between 1 and {MOST_CHARS})::varchar || '}}]}}'
       else '{{"content":' || cast(to_json(content) as varchar) || ',"role":' || cast(to_json(role) as varchar) || '}}' end as json from own),
results as (select conv_id, turn, 1 as step, 'tool' as role, content, chars, false as called, true as result, false as invalid, false as linked,
  '{{"content":"' || chars || '","linked":true,"role":"tool","tool_call_id":"call_' || turn || '"}}' as json from own where called and chars > 0),
messages as (select * from spoken union all select * from results)
select conv_id, count(*) as n_messages, cast(count(*) filter (called) as bigint) as n_calls, cast(count(*) filter (result) as bigint) as n_results, cast(count(*) filter (linked) as bigint) as n_linked,
  cast(count(*) filter (called and not linked) as bigint) as n_orphans, cast(count(*) filter (invalid) as bigint) as n_invalid,
  '{{"messages":[' || string_agg(json, ',' order by turn, step, role, content) || ']}}' as json
from messages group by conv_id
"""
