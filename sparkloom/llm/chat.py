"""Chat formatting with linked tool calls.

Calls and results are two tables.  They are joined on (conversation, call id) by a hash
join; each conversation's calls are ordered topologically by their dependencies, their
arguments validated against the tool's schema, and the whole conversation is
serialised as canonical JSON (keys sorted by code point, no spaces, shortest numbers).
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, table

#: Tool schemas of op3.
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": "boolean"}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def _escaped(text: str) -> str:
    """``text`` with surrogates that lack their other half, which no UTF-8 text can hold, as escapes; they occur in strings only."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, integers for whole doubles, no escapes but the necessary ones; values nested to any depth."""

    def clean(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    try:
        return _escaped(json.dumps(clean(value), sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    except RecursionError:
        return _escaped(_deep(value))


def _deep(value) -> str:
    """The same without recursion."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (written already, value), last first
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            todo.append((True, "}"))
            keys = sorted(v)
            for i in range(len(keys) - 1, -1, -1):
                todo += [(False, v[keys[i]]), (True, ("," if i else "") + json.dumps(keys[i], ensure_ascii=False) + ":")]
        elif isinstance(v, (list, tuple)):
            out.append("[")
            todo.append((True, "]"))
            for i in range(len(v) - 1, -1, -1):
                todo += [(False, v[i]), (True, "," if i else "")]
        elif isinstance(v, str):
            out.append(json.dumps(v, ensure_ascii=False))
        elif isinstance(v, float):
            out.append("null" if not math.isfinite(v) else str(int(v)) if v == int(v) and abs(v) < 2**53 else repr(v))
        else:
            out.append(json.dumps(v))
    return "".join(out)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and math.isfinite(v) and v == int(v)),
}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks the schema (type, enum, const, properties, required, additionalProperties, items, lengths, bounds, pattern, anyOf)."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: matches none of anyOf")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in props:
                out += violations(value[k], props[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{at}: wrong number of items")
        if isinstance(schema.get("items"), dict):
            for i, x in enumerate(value):
                out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern not matched")
    if _TYPES["number"](value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: out of bounds")
    return out


def order(ids: list[str], positions: list[int], needs: list[list[str]]) -> tuple[list[int], set[int]]:
    """Indexes in topological order, least (position, id) first among the free ones, and those on or behind a cycle, which come last in that same order.

    A dependency on an id that is not there, or on itself, is ignored.
    """
    at = {}
    for i, x in enumerate(ids):
        at.setdefault(x, i)
    waits, after = [set() for _ in ids], [[] for _ in ids]
    for i, deps in enumerate(needs):
        for d in deps or ():
            j = at.get(d)
            if j is not None and j != i and j not in waits[i]:
                waits[i].add(j)
                after[j].append(i)
    rank = lambda i: (positions[i], ids[i], i)
    ready = [rank(i) for i in range(len(ids)) if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[2]
        out.append(i)
        for j in after[i]:
            waits[j].discard(i)
            if not waits[j]:
                heapq.heappush(ready, rank(j))
    rest = sorted(set(range(len(ids))) - set(out), key=rank)
    return out + rest, set(rest)


def _refuse(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    return x if math.isfinite(x := float(text)) else _refuse(text)


def arguments(text: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """Parsed arguments and what is wrong with them; what does not parse stays text.

    NaN, infinities, numbers beyond a double and nesting beyond the parser's depth do
    not parse.
    """
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite) if text is not None else None
    except (ValueError, RecursionError):
        return text, ["$: not JSON"]
    if schema is None:
        return value, ["$: unknown tool"]
    return value, violations(value, schema)


def in_order(messages: list[tuple], calls: list[tuple]) -> list:
    """Values of messages (position, value) and calls (position, rank, value) as one list.

    Messages stand at their position, before calls of the same one; a run of calls with
    no message between them stands where its first is, by rank.  No position comes last.
    """
    at = lambda p: (p is None, p or 0)
    rows = [(*at(p), 0, 0, v) for p, v in messages] + [(*at(p), 1, k, v) for p, k, v in calls]
    out = []
    for is_call, run in itertools.groupby(sorted(rows, key=lambda r: r[:4]), key=lambda r: r[2]):
        out.extend(r[4] for r in (sorted(run, key=lambda r: r[3]) if is_call else run))
    return out


def conversation(rows: list, schemas: dict) -> tuple[str, str, int, int, int, int]:
    """(JSON by kind, JSON in order, calls, calls without result, invalid calls, calls on a cycle) of one conversation's linked items.

    Items are (kind, position, role, text, call id, tool, arguments, needs, result
    position, result).  The first JSON has all calls in topological order and all
    messages by position; the second is one list of both, see in_order.
    """
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0], r[4] or "", r[3] or "", r[6] or "", r[8] if r[8] is not None else -1, r[9] or ""))
    messages, calls = [r for r in rows if r[0] == "message"], [r for r in rows if r[0] == "call"]
    seen, again = set(), set()
    for i, r in enumerate(calls):  # of a repeated call id the first call has the result
        if r[4] is not None and r[4] in seen:
            again.add(i)
        seen.add(r[4])
    seq, cyclic = order([r[4] or "" for r in calls], [r[1] if r[1] is not None else 2**63 for r in calls], [r[7] for r in calls])
    said = [(r[1], {"role": r[2], "content": r[3]} | ({} if r[4] is None else {"tool_call_id": r[4]})) for r in messages]
    open_, invalid, done = 0, 0, []
    for k, i in enumerate(seq):
        r = calls[i]
        value, wrong = arguments(r[6], schemas.get(r[5]))
        call = {"arguments": value, "id": r[4], "name": r[5], "valid": not wrong}
        if wrong:
            call["errors"] = wrong
            invalid += 1
        if i in again:
            call["repeated"] = True
        linked = r[8] is not None and i not in again
        if linked:
            call["result"] = r[9]
        else:
            open_ += 1
        if i in cyclic:
            call["cyclic"] = True
        result_at = {"result_at": None if r[8] == _NOWHERE else r[8]} if linked else {}
        done.append((r[1], k, call, {"at": r[1]} | result_at | call))
    items = in_order([(p, {"at": p} | m) for p, m in said], [(p, k, x) for p, k, _, x in done])
    return canonical({"calls": [c for _, _, c, _ in done], "messages": [m for _, m in said]}), canonical(items), len(calls), open_, invalid, len(cyclic)


#: Position of a result that has none.
_NOWHERE = -(2**63)
_TEXT = ("kind", "role", "text", "call_id", "tool", "args", "result")
_ITEM = T.StructType(
    [
        T.StructField(n, T.ArrayType(T.StringType()) if n == "needs" else T.StringType() if n in _TEXT else T.LongType())
        for n in ("kind", "pos", "role", "text", "call_id", "tool", "args", "needs", "result_pos", "result")
    ]
)


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``(conv_id, chat, n_calls, n_open, n_invalid, n_cyclic, items)``, one row a conversation.

    ``items`` is the conversation as one ordered JSON list: messages at their position,
    each run of calls at the place of its first, in topological order within the run.
    Each has its position as ``at``, a call that of its result as ``result_at``.  ``chat``
    has the same objects apart and without positions, as ``{"calls": [...], "messages": [...]}``.

    ``messages`` has (conv_id, pos, role, text), ``calls`` (conv_id, pos, call_id, tool,
    args, needs), ``results`` (conv_id, pos, call_id, text).  Every row of the three is in
    the output once.  Of several results of a call the first counts (least position, then
    text); the others, and results without a call, are messages of the role ``tool``
    with their ``tool_call_id``.  A call without a result is open; of several calls with one
    id the first has the result, the others are open and marked ``repeated``.  A null
    call id never links.  Null texts are JSON nulls; empty and very long ones stay as
    they are; null conversation ids make one conversation, and ids of any type pass
    through as they are.  Arguments that are no JSON, or of an unknown tool, count as
    invalid.  Other columns are not read.  No rows give no rows.
    """
    w = Window.partitionBy("conv_id", "call_id").orderBy("pos", "text")
    first = F.when(F.row_number().over(w) == 1, F.col("call_id"))
    found = results.select("conv_id", "pos", "call_id", "text").select(F.col("conv_id").alias("rc"), F.col("pos").alias("rp"), F.col("call_id").alias("ri"), F.col("text").alias("rt"), first.alias("rid"))
    call = calls.select("conv_id", "pos", "call_id", "tool", "args", "needs", F.lit(True).alias("is_call"))
    linked = call.hint("shuffle_hash").join(found.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rid")), "full")

    def item(*c) -> object:
        return F.struct(*[x.cast(f.dataType).alias(f.name) for x, f in zip(c, _ITEM.fields)]).alias("item")

    null = F.lit(None)
    lone = item(F.lit("message"), F.col("rp"), F.lit("tool"), F.col("rt"), F.col("ri"), null, null, null, null, null)
    of_call = item(F.lit("call"), F.col("pos"), null, null, F.col("call_id"), F.col("tool"), F.col("args"), F.col("needs"), F.when(F.col("rid").isNotNull(), F.coalesce("rp", F.lit(_NOWHERE))), F.col("rt"))
    rows = messages.select("conv_id", item(F.lit("message"), F.col("pos"), F.col("role"), F.col("text"), null, null, null, null, null, null)).unionByName(
        linked.select(F.when(F.col("is_call"), F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"), F.when(F.col("is_call"), of_call).otherwise(lone).alias("item"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _ITEM.names
        for batch in batches:
            out = [conversation([tuple(x[n] for n in names) for x in items.as_py()], schemas) for items in batch.column("items")]
            chat, items, *counts = map(list, zip(*out)) if out else [[]] * 6
            made = [pa.array(chat, pa.string()), *[pa.array(c, pa.int32()) for c in counts], pa.array(items, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], ["conv_id", "chat", "n_calls", "n_open", "n_invalid", "n_cyclic", "items"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    whole = rows.groupBy("conv_id").agg(F.collect_list("item").alias("items"))
    return whole.mapInArrow(write, f"conv_id {kind}, chat string, n_calls int, n_open int, n_invalid int, n_cyclic int, items string")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of a table of plain turns (conv_id, turn, role, text).

    Where a table holds no tool calls (see from_messages for those that do), each user turn is read as a call of the tool
    ``reply`` with the identifier ``conversation-turn``; the call needs the one of the
    user turn before it, and the next assistant turn is its result.  A turn's
    identifier is computed from its own neighbours, so both sides are made apart and
    joined by identifier.  Assistant turns that are no call's result (before any user
    turn, or behind the first one after it) are messages, as are system turns and
    turns of any other role.
    """
    t = turns.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("pos"), col("role").cast("string").alias("role"), col("text").cast("string").alias("text"))
    w = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    name = lambda p: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), p.cast("string"))
    asked = F.last(F.when(F.col("role") == "user", F.col("pos")), ignorenulls=True).over(before)
    t = t.withColumn("prev", asked).withColumn("sys", F.coalesce(F.max(F.when(F.col("role") == "system", True)).over(before), F.lit(False)))
    args = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("pos").alias("turn"), F.col("sys").alias("system")))
    needs = F.when(F.col("prev").isNotNull(), F.array(name(F.col("prev")))).otherwise(F.array().cast("array<string>"))
    calls = t.where("role = 'user'").select("conv_id", "pos", name(F.col("pos")).alias("call_id"), F.lit("reply").alias("tool"), args.alias("args"), needs.alias("needs"))
    # the order is that in which format_chats takes the first of several results
    nth = F.row_number().over(Window.partitionBy("conv_id", "prev", F.col("role") == "assistant").orderBy("pos", "text"))
    t = t.withColumn("is_result", F.coalesce((F.col("role") == "assistant") & F.col("prev").isNotNull() & (nth == 1), F.lit(False)))
    results = t.where("is_result").select("conv_id", "pos", name(F.col("prev")).alias("call_id"), "text")
    messages = t.where("NOT is_result AND (role IS NULL OR role <> 'user')").select("conv_id", "pos", "role", "text")
    return messages, calls, results


_CALLS = "tool_calls array<struct<id: string, name: string, arguments: string, needs: array<string>>>, content string, tool_call_id string"


def from_messages(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of a table of turns (conv_id, turn, role, text) whose tool traffic is JSON.

    An assistant's text ``{"content": ..., "tool_calls": [{"id", "name", "arguments", "needs"}]}``
    holds calls, a tool's text ``{"tool_call_id": ..., "content": ...}`` is a result.  Any
    other text, JSON or not, is a message as it stands.
    """
    t = turns.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("pos"), col("role").cast("string").alias("role"), col("text").cast("string").alias("text"))
    t = t.withColumn("j", F.from_json("text", _CALLS))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    each = t.where(is_call).select("conv_id", "pos", F.explode("j.tool_calls").alias("c"))
    calls = each.select("conv_id", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("args"), F.col("c.needs").alias("needs"))
    results = t.where(is_result).select("conv_id", "pos", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("text"))
    text = F.when(is_call, F.col("j.content")).otherwise(F.col("text"))
    messages = t.where(~is_result & ~(is_call & F.col("j.content").isNull())).select("conv_id", "pos", "role", text.alias("text"))
    return messages, calls, results


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted."""
    return format_chats(*from_turns(table(spark, sf_dir, "conversations")), SCHEMAS)


QUERIES = {"op3_chat_formatting": op3_chat_formatting}
ORACLE: dict[str, str] = {}
