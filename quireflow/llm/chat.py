"""Chat formatting: tool-call linking, topological order, argument checks, canonical JSON.

A message is a row (conv_id, turn, role, text). An assistant message whose text
is a JSON object with ``tool_calls`` (id, name, arguments, optional
``depends_on`` ids) makes calls; a tool message whose text is a JSON object with
``tool_call_id`` is a result. Calls and results meet in a hash join on
(conv_id, id). Results must follow their calls and calls the results they
depend on: messages keep their turns, and one that stands too early is moved
behind what it needs, by relaxation over the dependency links alone. Only the
linked messages of a cycle or of a chain longer than ``max_depth`` are gathered,
without their texts; rows carry their place as a sort key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import discard, shuffle_partitions, store, whole_groups
from quireflow.llm.graph import components

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string>"

#: The type names of JSON Schema and what they admit, fixed values.
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, all characters as they are; a ValueError for lone surrogates and NaN, which are not JSON."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    out.encode()
    return out


def violations(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """Where a value breaks a JSON Schema of the keywords type, enum, const, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds

        def is_a(name: str) -> bool:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if name in ("number", "integer"):
                return number and (name == "number" or float(value).is_integer())
            return isinstance(value, _TYPES[name]) if name in _TYPES else False

        if not any(map(is_a, names)):
            return [f"{at}: not {' or '.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                out += violations(value[k], fields[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unexpected")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {word}" for word, bad in (("under minimum", value < schema.get("minimum", value)), ("over maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{at}: {word}" for word, bad in (("too short", len(value) < schema.get("minLength", 0)), ("too long", len(value) > schema.get("maxLength", len(value)))) if bad]
    return out


def message_json(role: str | None, text: str | None, schemas: Mapping[str, Any]) -> tuple[str, list[str]]:
    """Canonical JSON of a message and what is wrong with its calls' arguments."""
    bad: list[str] = []
    body: dict[str, Any] = {"role": role, "content": text}
    if role in ("assistant", "tool") and text and text.lstrip()[:1] == "{":
        try:
            said = json.loads(text)
        except (ValueError, RecursionError):
            said = None
        if role == "tool" and isinstance(said, dict) and isinstance(said.get("tool_call_id"), str):
            body = {"role": role, "tool_call_id": said["tool_call_id"], "content": said.get("content")}
        if role == "assistant" and isinstance(said, dict) and isinstance(said.get("tool_calls"), list):
            calls = []
            for call in said["tool_calls"]:
                if not isinstance(call, dict):
                    bad.append("call: not an object")
                    continue
                name, args = call.get("name"), call.get("arguments")
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except (ValueError, RecursionError):
                        bad.append(f"{call.get('id')}: arguments are not JSON")
                if name in schemas:
                    bad += [f"{call.get('id')}: {x}" for x in violations(args, schemas[name])]
                elif schemas:
                    bad.append(f"{call.get('id')}: unknown tool")
                calls.append({"id": call.get("id"), "type": "function", "function": {"name": name, "arguments": args}})
            body = {"role": role, "content": said.get("content"), "tool_calls": calls}
    bad = [x.encode("utf-8", "replace").decode() for x in bad]
    try:
        return canonical(body), bad
    except (ValueError, RecursionError) as e:  # what JSON has no form for: the text as it stands
        why = "not Unicode" if isinstance(e, UnicodeError) else "not finite" if isinstance(e, ValueError) else "too deep"
        return canonical({"role": role, "content": text}), [*bad, f"message: {why}"]


def chat_format(messages: DataFrame, schemas: Mapping[str, Any] | None = None, max_depth: int = 64) -> DataFrame:
    """conv_id, turn, order_turn, order_depth, role, message, n_calls, linked, problems of every message.

    (order_turn, order_depth, turn) sorts a conversation topologically.
    ``message`` is canonical JSON; ``linked``: every call of the message has a
    result, or the result has its call (null for other messages). ``problems``
    lists in order: duplicate_call, no_result, orphan_result,
    duplicate_result, cycle and the breaks of ``schemas`` (by tool name; none:
    arguments are not checked). Of several calls or results of one id the
    first by turn counts; messages that wait for each other keep their turn and
    are all marked cycle. A message that JSON has no form for (a lone surrogate,
    an infinite number) has its text as content and a problem says so. Links that still move messages after ``max_depth``
    rounds are placed a component at a time, in linear time. Nulls: a null
    turn sorts first, a null text is null content, a null conv_id or id links
    with nothing. Rows equal in all four columns are one message for linking and
    come out each. An empty table gives an empty result.
    """
    schemas = dict(schemas or {})
    mine = messages.select("conv_id", "turn", "role", "text").withColumn("msg", F.xxhash64("conv_id", "turn", "role", "text"))
    may = F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")
    tools = store(mine.where(may).select("conv_id", "turn", "role", "msg", F.from_json("text", _CALLS).alias("j")).distinct())
    calls = tools.where("role = 'assistant'").select("conv_id", "turn", "msg", F.posexplode("j.tool_calls").alias("nth", "c"))
    calls = calls.select("conv_id", "turn", "msg", F.col("c.id").alias("call_id"), "nth", F.col("c.depends_on").alias("needs"))
    results = tools.where("role = 'tool'").select("conv_id", "turn", "msg", F.col("j.tool_call_id").alias("call_id")).where("call_id is not null")
    # the first of an id by an aggregate, so that null or repeated ids never gather in one task
    of_id = ["conv_id", "call_id"]
    first_call = calls.where("conv_id is not null and call_id is not null").groupBy(*of_id).agg(F.min(F.struct("turn", "msg", "nth")).alias("first"))
    first_result = results.where("conv_id is not null").groupBy(*of_id).agg(F.min(F.struct("turn", "msg")).alias("first"))
    first_calls = first_call.select(*of_id, F.col("first").alias("first_call"), F.col("first.msg").alias("call_msg"))
    first_results = first_result.select(*of_id, F.col("first").alias("first_result"), F.col("first.msg").alias("result_msg"))
    call_state = calls.join(first_results, of_id, "left").join(first_calls, of_id, "left").withColumn("again", ~F.col("first_call").eqNullSafe(F.struct("turn", "msg", "nth")) & F.col("first_call").isNotNull())
    call_marks = call_state.groupBy("msg").agg(F.count("*").alias("n_calls"), F.min((F.col("result_msg").isNotNull() & ~F.col("again")).cast("int")).alias("all_linked"), F.max(F.col("again").cast("int")).alias("repeated"))
    linked_results = results.join(first_calls, of_id, "left").join(first_results, of_id, "left")
    result_marks = linked_results.select("msg", F.col("call_msg").isNotNull().alias("has_call"), (~F.col("first_result").eqNullSafe(F.struct("turn", "msg")) & F.col("first_result").isNotNull()).alias("again"))

    after_call = linked_results.where("call_msg is not null").select(F.col("call_msg").alias("before"), F.col("msg").alias("after"))
    needs = calls.select("conv_id", F.col("msg").alias("after"), F.explode("needs").alias("call_id")).join(first_results, ["conv_id", "call_id"]).select(F.col("result_msg").alias("before"), "after")
    links = store(after_call.union(needs).where("before <> after").distinct())
    places = _places(tools.select("msg", "turn").distinct(), links, max_depth)

    out = mine.join(call_marks, "msg", "left").join(result_marks, "msg", "left").join(places, "msg", "left")
    named = F.array_compact(F.array(F.when(F.col("repeated") == 1, "duplicate_call"), F.when(F.col("n_calls").isNotNull() & (F.col("all_linked") == 0), "no_result"), F.when(~F.col("has_call"), "orphan_result"), F.when(F.col("again"), "duplicate_result"), F.when(F.col("cycle"), "cycle")))
    linked = F.when(F.col("n_calls").isNotNull(), F.col("all_linked") == 1).otherwise(F.col("has_call"))
    out = out.select("conv_id", "turn", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0)).alias("order_depth"), "role", "text", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), linked.alias("linked"), named.alias("problems"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            said = [message_json(r, t, schemas) for r, t in zip(columns["role"].to_pylist(), columns["text"].to_pylist())]
            problems = [[*a, *b] for a, (_, b) in zip(columns["problems"].to_pylist(), said)]
            made = columns | {"message": pa.array([m for m, _ in said], pa.string()), "problems": pa.array(problems, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    kinds = dict(out.dtypes)
    names = ["conv_id", "turn", "order_turn", "order_depth", "role", "message", "n_calls", "linked", "problems"]
    return out.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def _places(messages: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """(msg, order_turn, order_depth, cycle): every message behind those it needs, relaxed link by link."""
    at = store(messages.select("msg", F.struct(F.col("turn").alias("t"), F.lit(0).alias("d")).alias("p")))
    for depth in range(max_depth + 1):
        before = at.select(F.col("msg").alias("before"), F.struct(F.col("p.t").alias("t"), (F.col("p.d") + 1).alias("d")).alias("least"))
        wanted = links.join(before, "before").groupBy(F.col("after").alias("msg")).agg(F.max("least").alias("least"))
        late = at.join(wanted, "msg").where(F.col("p") < F.col("least"))
        moved = store(late.select("msg", "least"))
        if moved.isEmpty():
            discard(moved)
            return at.select("msg", F.col("p.t").alias("order_turn"), F.col("p.d").alias("order_depth"), F.lit(False).alias("cycle"))
        if depth == max_depth:
            break
        new = store(at.join(moved, "msg", "left").select("msg", F.coalesce("least", "p").alias("p")))
        discard(at)
        at = new
    # what still moves waits for itself or in a long chain; its components are placed whole
    of = components(links.select(F.col("before").alias("a"), F.col("after").alias("b")))
    open_ = store(of.join(of.join(moved, F.col("node") == F.col("msg")).select("component").distinct(), "component"))
    turns = messages.select(F.col("msg").alias("node"), "turn")
    ends = links.join(open_.join(turns, "node").select(F.col("node").alias("after"), "component", F.col("turn").alias("after_turn")), "after")
    ends = ends.join(turns.select(F.col("node").alias("before"), F.col("turn").alias("before_turn")), "before")
    rows = ends.repartition(shuffle_partitions(links.sparkSession), "component").sortWithinPartitions("component", "before", "after").select("component", "before", "before_turn", "after", "after_turn")
    kind = messages.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, ["component"]):
            columns = [part.column(k).to_pylist() for k in ("before", "before_turn", "after", "after_turn")]
            placed = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), part.num_rows]):
                before, before_turn, after, after_turn = (c[a:z] for c in columns)
                placed += placed_exactly(dict(zip(before, before_turn)) | dict(zip(after, after_turn)), list(zip(before, after)))
            kinds = [pa.int64(), part.schema.field("after_turn").type, pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*placed), kinds)], names=["msg", "order_turn", "order_depth", "cycle"])

    whole = store(rows.mapInArrow(run, f"msg long, order_turn {kind}, order_depth int, cycle boolean"))
    rest = at.join(whole.select("msg"), "msg", "left_anti").select("msg", F.col("p.t").alias("order_turn"), F.col("p.d").alias("order_depth"), F.lit(False).alias("cycle"))
    return rest.unionByName(whole)


def placed_exactly(turns: dict[int, Any], links: list[tuple[int, int]]) -> list[tuple[int, Any, int, bool]]:
    """(message, order_turn, order_depth, cycle) of linked messages, in time linear in the links.

    Members of a cycle are the strongly connected components of two or more, by
    Tarjan's method without recursion; they keep their turn. It closes a
    component after all that follow it, so that its reverse is an order.
    """
    later: dict[int, list[int]] = {m: [] for m in turns}
    for before, after in links:
        later[before].append(after)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    inside: set[int] = set()
    cycle: set[int] = set()
    closed: list[int] = []
    for root in turns:
        if root in index:
            continue
        work = [(root, iter(later[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        inside.add(root)
        while work:
            m, rest = work[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = len(index)
                    held.append(x)
                    inside.add(x)
                    work.append((x, iter(later[x])))
                    break
                if x in inside:
                    low[m] = min(low[m], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[m])
                if low[m] == index[m]:
                    members = [held.pop()]
                    while members[-1] != m:
                        members.append(held.pop())
                    inside.difference_update(members)
                    closed += members
                    if len(members) > 1:
                        cycle.update(members)

    # a null turn sorts first
    place = {m: (t is not None, t, 0) for m, t in turns.items()}
    for m in reversed(closed):
        known, t, depth = place[m]
        for x in later[m]:
            if x not in cycle:
                place[x] = max(place[x], (known, t, depth + 1), key=lambda p: (p[0], p[1] if p[0] else 0, p[2]))
    return [(m, *place[m][1:], m in cycle) for m in turns]
