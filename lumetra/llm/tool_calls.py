"""Chat formatting: tool calls linked with their results.

Calls and results are taken from messages, joined by (conversation, call
identifier), put into a topological order of their dependencies, validated
against JSON schemas, and written as canonical JSON (sorted keys, no spaces,
characters unescaped).

Order: where every dependency points to an earlier message, the order of
messages is topological already. The other conversations are ordered by
(level, turn, index), a call's level being the length of the longest chain of
dependencies below it; calls on or behind a cycle keep status ``cycle`` and
come last. Levels of a conversation with up to ``GATHERED`` dependencies are
counted in one task from identifiers alone; a larger one is peeled by joins, one
round a level. Positions come from global prefix sums, so one conversation may
hold any share of the rows.

Defined cases: rows with a null conv_id, turn or role, or with another role,
are neither calls nor results; a null text is a null argument, which fails
validation where a string is asked for; of several calls with one identifier
the earliest is the call, the others are ``duplicate``; of several results
the earliest is linked, or with ``every_result`` (as the query has it) each
is, a row each by result_turn; results without a call are ``orphan``; dependencies
on identifiers that do not exist are dropped; calls that messages tell of and
those that plain turns stand for may share identifiers, and never meet; arguments that are not JSON, that
JSON has no number for, that hold half a surrogate pair or are nested too
deeply are a violation, and null in the message; an assistant message is one of
calls if its parsed text has a list ``tool_calls``, and plain otherwise; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed
from .sharding import byte_positions

CALLS = "conv_id long, plain boolean, turn long, idx int, call_id string, name string, arguments string, depends_on array<string>"

#: What names a call: identifiers of messages that tell of calls, and those of plain turns, are two name spaces.
KEY = ["conv_id", "plain", "call_id"]

#: Dependencies of a conversation whose levels are counted in one task.
GATHERED = 200_000

#: Arguments of the tool that plain user turns stand for.
RESPOND = {
    "respond": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def is_type(value, name: str) -> bool:
    if name == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if name == "number":
        return not isinstance(value, bool) and isinstance(value, (int, float))
    return isinstance(value, TYPES[name])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: types, enumerations, bounds, lengths, patterns, items, properties."""
    wanted = schema.get("type")
    if wanted is not None and not any(is_type(value, t) for t in ([wanted] if isinstance(wanted, str) else wanted)):
        return [f"{at}: not of type {wanted if isinstance(wanted, str) else '/'.join(wanted)}"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if is_type(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: longer than {schema['maxLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: does not match {schema['pattern']}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {k} is not allowed")
    return out


def told_calls():
    """The calls that a message's text lists; null for any other text."""
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
    return F.when(F.col("text").contains("tool_calls"), F.from_json("text", kind).getField("tool_calls"))


def protocol_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of assistant messages ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}`` and results of
    tool messages ``{"tool_call_id", "content"}``."""
    told = messages.filter("conv_id is not null and turn is not null and role = 'assistant'").select("conv_id", "turn", F.posexplode(told_calls()).alias("idx", "call"))
    calls = told.select("conv_id", F.lit(False).alias("plain"), "turn", "idx", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), F.coalesce("call.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    answer = F.from_json("text", "struct<tool_call_id:string,content:string>")
    results = messages.filter("conv_id is not null and turn is not null and role = 'tool'").withColumn("_a", answer).select("conv_id", F.lit(False).alias("plain"), F.col("turn").alias("result_turn"), F.col("_a.tool_call_id").alias("call_id"), F.col("_a.content").alias("content"))
    return calls, results


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chat seen as calls: a user turn calls ``respond``, after the user turn two before; the next assistant turn is its result."""
    held = messages.filter("conv_id is not null and turn is not null")
    calls = held.filter("role = 'user'").select(
        "conv_id", F.lit(True).alias("plain"), "turn", F.lit(0).alias("idx"), F.col("turn").cast("string").alias("call_id"), F.lit("respond").alias("name"),
        F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.array(F.try_subtract("turn", F.lit(2)).cast("string")).alias("depends_on"),
    )
    results = held.filter((F.col("role") == "assistant") & told_calls().isNull()).select(
        "conv_id", F.lit(True).alias("plain"), F.col("turn").alias("result_turn"), F.try_subtract("turn", F.lit(1)).cast("string").alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """(uid, level) of calls whose conversation has a dependency that does not point back; null level: on or behind a cycle.

    ``calls``: uid, conv_id, plain, call_id, turn, idx, depends_on, one row a key.
    """
    wanted = calls.select("uid", "conv_id", "plain", "turn", "idx", F.explode(F.array_distinct("depends_on")).alias("needs"))
    place = calls.select(F.col("uid").alias("need_uid"), "conv_id", "plain", F.col("call_id").alias("needs"), F.col("turn").alias("need_turn"), F.col("idx").alias("need_idx"))
    edges = checkpointed(wanted.join(place, ["conv_id", "plain", "needs"]).select("conv_id", "uid", "need_uid", (F.struct("need_turn", "need_idx") >= F.struct("turn", "idx")).alias("forward")))
    size = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("forward").alias("forward"))
    unruly = checkpointed(size.filter("forward").select("conv_id", (F.col("n") <= GATHERED).alias("gathered")))
    if unruly.isEmpty():
        return unruly.select(F.lit(0).cast("long").alias("uid"), F.lit(0).alias("level")).limit(0)
    held = calls.select("conv_id", "uid", F.lit(None).cast("long").alias("need_uid")).unionByName(edges.select("conv_id", "uid", "need_uid"))
    counted = held.join(unruly.filter("gathered"), "conv_id", "left_semi").groupBy("conv_id").applyInArrow(levels_of, "uid long, level int")
    large = unruly.filter("not gathered")
    return counted if large.isEmpty() else counted.unionByName(peeled(calls.join(large, "conv_id", "left_semi").select("uid"), edges.join(large, "conv_id", "left_semi").select("uid", "need_uid")))


def levels_of(group: pa.Table) -> pa.Table:
    """Levels of one conversation's calls, from rows (uid, need_uid), null need_uid for the calls themselves."""
    uid, need = group["uid"].to_numpy(), group["need_uid"]
    calls = np.sort(uid[need.is_null().to_numpy()])
    has = need.is_valid().to_numpy()
    user, needed = np.searchsorted(calls, uid[has]), np.searchsorted(calls, need.drop_null().to_numpy())
    users: list[list[int]] = [[] for _ in calls]
    waits = np.bincount(user, minlength=len(calls)).tolist()
    for a, b in zip(user.tolist(), needed.tolist(), strict=True):
        users[b].append(a)
    level, ready = [0] * len(calls), [i for i, n in enumerate(waits) if not n]
    for i in ready:
        for j in users[i]:
            level[j] = max(level[j], level[i] + 1)
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return pa.Table.from_arrays([pa.array(calls), pa.array([None if n else v for n, v in zip(waits, level, strict=True)], pa.int32())], ["uid", "level"])


def peeled(left: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, level) by rounds of joins: each takes away the calls that need nothing which is left."""
    left, edges = checkpointed(left), checkpointed(edges)
    done = left.sparkSession.createDataFrame([], "uid long, level int")
    level = 0
    while True:
        # calls that need nothing which is left
        held = edges.join(left.select(F.col("uid").alias("need_uid")), "need_uid", "left_semi").select("uid").distinct()
        free = checkpointed(left.join(held, "uid", "left_anti"))
        if free.isEmpty():
            break
        done = checkpointed(done.unionByName(free.withColumn("level", F.lit(level))))
        left = checkpointed(left.join(free, "uid", "left_anti"))
        level += 1
    return done.unionByName(left.withColumn("level", F.lit(None).cast("int")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every_result: bool = False) -> DataFrame:
    """One row per call (or per result of it, with ``every_result``), and per result without one, in the order ``position`` of their conversation."""
    calls = checkpointed(calls.withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct("turn", "idx", "uid")
    firsts = calls.filter("call_id is not null").groupBy(*KEY).agg(F.min(place).alias("_p")).select(F.col("_p.uid").alias("uid"))
    chosen = checkpointed(calls.join(firsts, "uid", "left_semi"))
    others = calls.join(firsts, "uid", "left_anti")
    level = levels(chosen)
    answers = results if every_result else results.groupBy(*KEY).agg(F.min(F.struct("result_turn", "content")).alias("_r")).select(*KEY, "_r.*")
    answers = answers.select(*KEY, "result_turn", "content", F.lit(True).alias("_hit"))
    ranked = chosen.join(level.withColumn("_unruly", F.lit(True)), "uid", "left")
    cyclic = F.coalesce("_unruly", F.lit(False)) & F.col("level").isNull()
    linked = ranked.join(answers, KEY, "left").select(
        *KEY, "turn", "idx", F.when(cyclic, F.lit(2**31 - 1)).otherwise(F.coalesce("level", F.lit(0))).alias("level"), "name", "arguments", "result_turn", "content",
        F.when(cyclic, "cycle").when(F.col("_hit"), "linked").otherwise("unanswered").alias("status"),
    )
    none = {"level": F.lit(0), "result_turn": F.lit(None).cast("long"), "content": F.lit(None).cast("string"), "status": F.lit("duplicate")}
    extra = others.withColumns(none)
    keys = chosen.select(*KEY)
    orphans = results.join(keys, KEY, "left_anti").select(
        *KEY, F.col("result_turn").alias("turn"), F.lit(0).alias("idx"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"), "result_turn", "content", F.lit("orphan").alias("status"),
    )
    names = linked.columns
    everything = linked.unionByName(extra.select(names)).unionByName(orphans)
    # contents only break ties, by their hash: range bounds hold sort keys
    keyed = everything.withColumn("one", F.lit(1)).withColumn("_hash", F.xxhash64("content"))
    placed = byte_positions(keyed, ["conv_id", "level", "turn", "idx", "status", "call_id", "plain", "result_turn", "_hash"], "one").drop("bytes_before", "bytes_total", "one", "_hash")
    first = placed.groupBy("conv_id").agg(F.min("row_no").alias("_first"))
    placed = placed.join(first, "conv_id").withColumn("position", F.col("row_no") - F.col("_first"))

    def write(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                errors: list[str] = []
                value = None
                if r["status"] != "orphan":
                    try:
                        value = json.loads(r["arguments"]) if r["arguments"] is not None else None
                        text = canonical(value)
                        text.encode("utf-8")
                        errors = violations(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no such tool"]
                    except UnicodeEncodeError:
                        value, text, errors = None, None, ["$: half a surrogate pair"]
                    except RecursionError:
                        value, text, errors = None, None, ["$: nested too deeply"]
                    except ValueError:
                        value, text, errors = None, None, ["$: not JSON"]
                else:
                    text, errors = None, ["$: no call"]
                message = {"arguments": value, "conversation": r["conv_id"], "id": r["call_id"], "name": r["name"], "result": r["content"], "status": r["status"]}
                rows.append((r["conv_id"], r["position"], r["call_id"], r["turn"], r["name"], text, not errors, "; ".join(errors), r["status"], r["result_turn"], canonical(message)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LINKED.split(", ")])

    return placed.select("conv_id", "position", "call_id", "turn", "name", "arguments", "status", "result_turn", "content").mapInArrow(write, LINKED)


LINKED = "conv_id long, position long, call_id string, turn long, name string, arguments string, valid boolean, errors string, status string, result_turn long, message string"


def format_conversations(messages: DataFrame, schemas: dict[str, dict] | None = None, every_result: bool = False) -> DataFrame:
    """Calls of both kinds out of (conv_id, turn, role, text), linked."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    told, answered = protocol_calls(rows)
    plain, replies = turn_calls(rows)
    return link(told.unionByName(plain), answered.unionByName(replies), {**RESPOND, **(schemas or {})}, every_result)
