"""Chat formatting: tool calls linked to their results, ordered, validated, canonical.

A message's text may be a JSON object that carries tool data:

* ``{"tools": [{"name": ..., "parameters": <JSON schema>}]}`` (any role) declares tools,
* ``{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}], "content": ...}`` calls
  them (``function: {name, arguments}`` and arguments as a JSON string are accepted),
* ``{"tool_call_id": ..., "content": ...}`` is a result.

Calls and results meet in a hash join on (conversation, call id). A result depends on
the first message that makes its call, so dependencies are chains: a result's place is
the greatest (turn, steps behind it) over itself and all messages that it depends on,
found by pointer jumping, a join a round, with rounds in the logarithm of the longest
chain. ``order by at_turn, step, turn`` is then a topological order that moves a message
only if it must, and no conversation is gathered in one task. A call is validated by the
last declaration of its tool at or before its turn, found by a range-partitioned scan.
Every message is one row with its canonical JSON (sorted keys, no spaces, unescaped
Unicode; half of a surrogate pair stays an escape).

Defined cases: null role or text count as empty; text that is no such JSON object (or
holds NaN, an infinite number, or nesting that cannot be written again) is plain content;
a repeated call id is answered by every result with that id, and a result stands behind
the first call with it (by turn, then row); messages that wait for each other in a circle,
and those behind them, keep their own turn; calls without a declaration of their tool up
to their turn are valid, calls without an id are checked but answered by nothing; of
declarations in one turn the later row, and in one message the later entry, counts; rows
with null ids are serialised but linked with nothing; rows with equal turns keep an equal
place; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from urllib.parse import unquote

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import chunks, prepare, written

# The types of JSON schema and the Python types that a parsed value has.
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


_HALF = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """The text with each half of a surrogate pair, which UTF-8 cannot hold, as its JSON escape."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _refused(constant: str):
    raise ValueError(constant)


def _finite(number: str) -> float:
    return value if math.isfinite(value := float(number)) else _refused(number)


def _loaded(text: str):
    """The JSON value of a text; ValueError or RecursionError if it is none that can be written again."""
    value = json.loads(text, parse_constant=_refused, parse_float=_finite)
    json.dumps([[[[value]]]])  # a message holds it this deep
    return value


def _object(text: str | None) -> dict | None:
    if not text or "tool" not in text or not text.lstrip().startswith("{"):
        return None
    try:
        value = _loaded(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _name(value) -> str:
    """An identifier as text: null is empty, what is no text is its JSON."""
    return "" if value is None else escaped(value) if isinstance(value, str) else canonical(value)


def _listed(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def parse(text: str | None) -> tuple[list[dict], str | None, list[dict], object]:
    """(calls, id of the call that this answers, declared tools, content) of a message."""
    value = _object(text)
    if value is None:
        return [], None, [], text or ""
    calls = []
    for call in _listed(value.get("tool_calls")):
        inner = call["function"] if isinstance(call.get("function"), dict) else call
        arguments = inner.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = _loaded(arguments)
            except (ValueError, RecursionError):
                pass
        calls.append({"id": _name(call.get("id")), "name": _name(inner.get("name")), "arguments": arguments})
    answers = _name(value.get("tool_call_id"))
    tools = [t["function"] if isinstance(t.get("function"), dict) else t for t in _listed(value.get("tools"))]
    tools = [{"name": _name(t.get("name")), "schema": canonical({} if t.get("parameters") is None else t["parameters"])} for t in tools]
    if not (calls or answers or tools):
        return [], None, [], text or ""
    content = value.get("content")
    return calls, answers or None, tools, "" if content is None else content


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1, 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _is(value, kind) -> bool:
    """Whether a value is of a type: true is no number, 1.0 is an integer; an unknown type restricts nothing."""
    if kind in ("integer", "number") and isinstance(value, bool):
        return False
    return isinstance(value, TYPES.get(kind, (object,))) or kind == "integer" and isinstance(value, float) and value.is_integer()


#: Standard keywords that restrict a value and aren't checked here; a schema with one is reported.
UNSUPPORTED = frozenset("$dynamicRef $recursiveRef unevaluatedProperties unevaluatedItems".split())
# Keyword -> (Python types it applies to, whether a value keeps it, what is said otherwise).
LIMITS = {
    "minimum": ((int, float), lambda v, x: v >= x, "below minimum"), "maximum": ((int, float), lambda v, x: v <= x, "above maximum"),
    "exclusiveMinimum": ((int, float), lambda v, x: v > x, "not above exclusiveMinimum"), "exclusiveMaximum": ((int, float), lambda v, x: v < x, "not below exclusiveMaximum"),
    "multipleOf": ((int, float), lambda v, x: Decimal(repr(v)) % Decimal(repr(x)) == 0, "not multipleOf"),
    "minLength": ((str,), lambda v, x: len(v) >= x, "shorter than minLength"), "maxLength": ((str,), lambda v, x: len(v) <= x, "longer than maxLength"),
    "pattern": ((str,), lambda v, x: regex.search(x, v) is not None, "not of pattern"),
    "minItems": ((list,), lambda v, x: len(v) >= x, "fewer than minItems"), "maxItems": ((list,), lambda v, x: len(v) <= x, "more than maxItems"),
    "uniqueItems": ((list,), lambda v, x: not x or not any(_same(a, b) for k, a in enumerate(v) for b in v[:k]), "items not unique"),
    "minProperties": ((dict,), lambda v, x: len(v) >= x, "fewer than minProperties"), "maxProperties": ((dict,), lambda v, x: len(v) <= x, "more than maxProperties"),
}


def violations(value, schema, where: str = "$", root=None, refs: frozenset = frozenset()) -> list[str]:
    """What in ``value`` breaks the schema, by the standard keywords of JSON schema.

    Keywords of UNSUPPORTED, references outside the schema or in a circle, and keywords with
    arguments that make no sense are reported too. Other unknown keywords and ``format`` are
    annotations.
    """
    if schema is False:
        return [f"{where}: not allowed"]
    if not isinstance(schema, dict):
        return []
    try:
        return _violations(value, schema, where, schema if root is None else root, refs)
    except (TypeError, ValueError, AttributeError, ArithmeticError, RecursionError, regex.error):
        return [f"{where}: unsupported schema"]


def _violations(value, schema: dict, where: str, root: dict, refs: frozenset) -> list[str]:
    def here(part) -> list[str]:
        return violations(value, part, where, root, refs)

    def below(part, x, name: str) -> list[str]:
        return violations(x, part, name, root)

    out, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{where}: not of type {'|'.join(map(str, kinds))}"]
    out += [f"{where}: unsupported {k}" for k in sorted(UNSUPPORTED & set(schema))]
    if "$ref" in schema:
        ref, target = schema["$ref"], root
        if ref in refs or not (ref == "#" or ref.startswith("#/")):
            out.append(f"{where}: unsupported $ref")
        else:
            for part in ref.split("/")[1:]:
                part = unquote(part).replace("~1", "/").replace("~0", "~")
                target = target[int(part)] if isinstance(target, list) and part.isdigit() and int(part) < len(target) else target.get(part) if isinstance(target, dict) else None
            out += [f"{where}: unsupported $ref"] if target is None else violations(value, target, where, root, refs | {ref})
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{where}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{where}: not const")
    for k, (types, keeps, said) in LIMITS.items():
        if k in schema and isinstance(value, types) and not isinstance(value, bool) and not keeps(value, schema[k]):
            out.append(f"{where}: {said}")
    for part in schema.get("allOf") or []:
        out += here(part)
    if "anyOf" in schema and all(map(here, schema["anyOf"])):
        out.append(f"{where}: none of anyOf")
    if "oneOf" in schema and sum(not here(part) for part in schema["oneOf"]) != 1:
        out.append(f"{where}: not one of oneOf")
    if "not" in schema and not here(schema["not"]):
        out.append(f"{where}: as not forbids")
    if "if" in schema:
        out += here(schema.get("else" if here(schema["if"]) else "then", True))
    if isinstance(value, dict):
        known, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
        if not isinstance(known, dict) or not isinstance(patterns, dict):
            raise TypeError("properties")
        out += [f"{where}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        depends = {**(schema.get("dependencies") or {}), **(schema.get("dependentRequired") or {})}
        for k in sorted(set(depends) & set(value)):
            out += [f"{where}.{x}: missing" for x in depends[k] if x not in value] if isinstance(depends[k], list) else here(depends[k])
        for k, part in sorted((schema.get("dependentSchemas") or {}).items()):
            out += here(part) if k in value else []
        for k in sorted(value, key=lambda k: (k in known, k)):
            matched = [x for x in patterns if regex.search(x, k)]
            if k not in known and not matched:
                out += below(schema.get("additionalProperties", True), value[k], f"{where}.{k}")
            for part in [*([known[k]] if k in known else []), *(patterns[x] for x in matched)]:
                out += below(part, value[k], f"{where}.{k}")
            if "propertyNames" in schema:
                out += below(schema["propertyNames"], k, f"{where}.{k}")
    if isinstance(value, list):
        items = schema.get("items", True)
        first = schema.get("prefixItems") or []
        if isinstance(items, list):  # the older form of prefixItems
            first, items = items, schema.get("additionalItems", True)
        for k, x in enumerate(value):
            out += below(first[k] if k < len(first) else items, x, f"{where}[{k}]")
        if "contains" in schema:
            n = sum(not below(schema["contains"], x, where) for x in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.append(f"{where}: not as contains says")
    return out


_PARSED = "row bigint, conv_id bigint, turn bigint, role string, text string, calls array<struct<id:string,name:string,args:string>>, answers string, tools array<struct<name:string,schema:string>>"
_MESSAGES = "conv_id bigint, turn bigint, at_turn bigint, step int, role string, n_calls bigint, n_answered bigint, linked boolean, n_invalid bigint, message string"
_CALLS = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("args", pa.string())]))
_TOOLS = pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))


def _parsed(batches):
    for part, texts in chunks(batches, "text"):
        got = [parse(t) for t in texts]
        calls = [[{"id": c["id"], "name": c["name"], "args": canonical(c["arguments"])} for c in g[0]] for g in got]
        names = ["row", "conv_id", "turn", "role", "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(calls, _CALLS), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], _TOOLS)], names=[*names, "calls", "answers", "tools"])


def _written_out(batches):
    for part, texts in chunks(batches, "text"):
        messages, invalid = [], []
        roles, linked, schemas = (part.column(c).to_pylist() for c in ("role", "answered", "schemas"))
        for text, role, ids, found in zip(texts, roles, linked, schemas, strict=True):
            calls, answers, tools, content = parse(text)
            by_name = {x["name"]: json.loads(x["schema"]) for x in found or []}
            message: dict = {"role": role or "", "content": content}
            bad = 0
            if calls:
                message["tool_calls"] = []
                for call in calls:
                    wrong = violations(call["arguments"], by_name.get(call["name"], {}))
                    bad += bool(wrong)
                    message["tool_calls"].append(call | {"answered": call["id"] in (ids or [])} | ({"violations": wrong} if wrong else {}))
            if answers:
                message["tool_call_id"] = answers
            if tools:
                message["tools"] = [{"name": t["name"], "parameters": json.loads(t["schema"])} for t in tools]
            messages.append(canonical(message))
            invalid.append(bad)
        names = ["conv_id", "turn", "at_turn", "step", "role", "n_calls", "n_answered", "linked"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(invalid, pa.int64()), pa.array(messages, pa.string())], names=[*names, "n_invalid", "message"])


def _places(nodes: DataFrame, name: str) -> DataFrame:
    """(row, at_turn, step) of (row, turn, parent): the greatest (turn, distance) over a message and those it depends on.

    A state covers the ``n`` messages from a row up to, not including, ``up``; joining it
    with the state of ``up`` doubles its reach.
    """
    now = nodes.select("row", F.struct(F.col("turn").alias("t"), F.lit(0).cast("bigint").alias("d")).alias("place"), F.lit(1).cast("bigint").alias("n"), F.col("parent").alias("up"))
    linked, reach = nodes.where("parent is not null").count(), 1
    while reach <= linked:
        ahead = now.select(F.col("row").alias("up"), F.col("place.t").alias("t"), F.col("place.d").alias("d"), F.col("n").alias("m"), F.col("up").alias("next"))
        far = F.struct(F.col("t"), (F.col("d") + F.col("n")).alias("d"))
        place = F.when(F.col("m").isNull(), F.col("place")).otherwise(F.greatest("place", far))
        now = written(now.join(ahead, "up", "left").select("row", place.alias("place"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.col("next").alias("up")), f"{name}-places")
        if now.where("up is not null").isEmpty():
            break
        reach *= 2
    # What still has someone ahead of it after that many steps is on a circle or behind one.
    settled = now.where("up is null").select("row", F.col("place.t").alias("at_turn"), F.col("place.d").cast("int").alias("step"))
    return nodes.select("row", "turn").join(settled, "row", "left").select("row", F.coalesce("at_turn", "turn").alias("at_turn"), F.coalesce("step", F.lit(0)).alias("step"))


def _rules(calls: DataFrame, declared: DataFrame, name: str) -> DataFrame:
    """(row, schemas): for each tool that a row calls, the last declaration at or before its turn.

    Events are dealt by ranges of (conversation, tool, turn), so a busy conversation is
    spread over tasks; a range's last declaration of a tool is handed to later ranges.
    """
    none = F.lit(None).cast("bigint")
    events = declared.select("conv_id", "tool", "turn", F.lit(0).alias("kind"), "row", "pos", F.struct("row", "pos").alias("found"))
    events = events.unionByName(calls.select("conv_id", "tool", "turn", "row").distinct().select("conv_id", "tool", "turn", F.lit(1).alias("kind"), "row", none.cast("int").alias("pos"), F.lit(None).cast(events.schema["found"].dataType).alias("found")))
    order = ["turn", "kind", "row", "pos"]
    dealt = written(events.where("conv_id is not null and turn is not null").repartitionByRange("conv_id", "tool", *order).withColumn("part", F.spark_partition_id()), f"{name}-events")
    here = F.last("found", ignorenulls=True).over(Window.partitionBy("conv_id", "tool", "part").orderBy(*order))
    seen = dealt.withColumn("seen", here)
    ends = dealt.where("kind = 0").groupBy("conv_id", "tool", "part").agg(F.max_by("found", F.struct(*order)).alias("end"))
    parts = dealt.select("conv_id", "tool", "part").distinct().join(ends, ["conv_id", "tool", "part"], "left")
    before = Window.partitionBy("conv_id", "tool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select("conv_id", "tool", "part", F.last("end", ignorenulls=True).over(before).alias("handed"))
    valid = seen.where("kind = 1").join(handed, ["conv_id", "tool", "part"]).select("row", F.col("tool").alias("called"), F.coalesce("seen", "handed").alias("by")).where("by is not null")
    schemas = declared.select(F.struct("row", "pos").alias("by"), "schema")
    return valid.join(schemas, "by").groupBy("row").agg(F.collect_list(F.struct(F.col("called").alias("name"), "schema")).alias("schemas"))


def format_conversations(turns: DataFrame, name: str = "chat") -> DataFrame:
    """One row for each message: conv_id, turn, at_turn, step, role, n_calls, n_answered, n_invalid, linked, message.

    ``order by at_turn, step, turn`` is the order of a conversation's messages; ``linked``
    tells whether a result has its call (null for other messages).
    """
    prepare(turns.sparkSession)
    source = turns.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = written(source.mapInArrow(_parsed, _PARSED), f"{name}-parsed")
    tool_data = "(size(calls) > 0 or answers is not null or size(tools) > 0)"
    with_tools = parsed.where(tool_data)
    plain = parsed.where(f"not {tool_data}").select("conv_id", "turn", F.col("turn").alias("at_turn"), F.lit(0).alias("step"), "role", F.lit(0).cast("bigint").alias("n_calls"), F.lit(0).cast("bigint").alias("n_answered"), F.lit(None).cast("boolean").alias("linked"), "text", F.lit(None).cast("array<string>").alias("answered"), F.lit(None).cast("array<struct<name:string,schema:string>>").alias("schemas"))
    if with_tools.isEmpty():
        return plain.mapInArrow(_written_out, _MESSAGES)
    every = with_tools.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", F.col("c.id").alias("call"), F.col("c.name").alias("tool"))
    calls = every.where("call <> ''")
    results = with_tools.where("answers is not null").select("row", "conv_id", F.col("answers").alias("call"))
    first = calls.groupBy("conv_id", "call").agg(F.min(F.struct("turn", "row")).alias("first"))
    back = results.join(first, ["conv_id", "call"]).select("row", F.col("first.row").alias("parent"))
    nodes = written(with_tools.select("row", "turn").join(back, "row", "left"), f"{name}-nodes")
    places = _places(nodes, name).join(nodes.select("row", "parent"), "row")
    told = calls.join(results.select("conv_id", "call").distinct(), ["conv_id", "call"]).groupBy("row").agg(F.collect_set("call").alias("answered"))
    declared = with_tools.select("row", "conv_id", "turn", F.posexplode("tools").alias("pos", "t")).select("row", "conv_id", "turn", "pos", F.col("t.name").alias("tool"), F.col("t.schema").alias("schema"))
    rules = _rules(every, declared, name)
    tooled = with_tools.join(places, "row").join(told, "row", "left").join(rules, "row", "left").select(
        "conv_id", "turn", "at_turn", "step", "role", F.size("calls").cast("bigint").alias("n_calls"),
        F.size(F.filter("calls", lambda c: F.array_contains(F.coalesce("answered", F.array().cast("array<string>")), c["id"]))).cast("bigint").alias("n_answered"), F.when(F.col("answers").isNotNull(), F.col("parent").isNotNull()).alias("linked"), "text", "answered", "schemas")
    return plain.unionByName(tooled).mapInArrow(_written_out, _MESSAGES)
