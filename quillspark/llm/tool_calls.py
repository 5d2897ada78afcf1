"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are hash-joined by (conversation, call id). A call may come ``after`` another (it
needs that call's result); its place in topological order is its depth in that forest, found by
pointer doubling, so a chain of n calls takes log2(n) joins and no conversation is gathered in one
task. Arguments are checked against a JSON schema per tool name and written as canonical JSON: keys
sorted by code point, no blank space, UTF-8 as it is, numbers in their shortest form (1.0 is 1), lone
surrogates as escapes. Rows that are done leave the joins, so a call that many come after is met once.

Cases: of calls that repeat (conversation, id) the one with the least arguments text counts, and all
are told by ``n_same``; of repeated results the least content counts and ``n_answers`` tells all; a
call without a result is ``unanswered``, a result without a call ``orphan``; a call or result whose
conversation or call id is null links with nothing and is a row of its own, ``unlinked``; a call after
an unknown call starts a chain; calls on a cycle have a null depth; arguments that are null, no JSON
object, or hold ``NaN``, ``Infinity`` or a number beyond the doubles are a ``problem``, as are those of
a tool without a schema or nested over ``DEEPEST`` levels (then no arguments are shown); texts of any
length are serialised whole; only the named columns are read, so other columns may have any name;
empty tables give an empty result.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

KINDS: dict[str, Any] = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
DEEPEST = 200  # levels of nesting
_SURROGATE = re.compile("[\ud800-\udfff]")


def number(value: float) -> str:
    """A finite double as ECMAScript writes it."""
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    mantissa, _, power = repr(value).partition("e")
    if not power:
        return mantissa
    n = int(power)
    if -7 < n < 0:  # repr leaves the plain form at 1e-5 already
        digits = mantissa.replace(".", "").lstrip("-")
        return ("-" if value < 0 else "") + "0." + "0" * (-n - 1) + digits
    return f"{mantissa}e{n:+d}"


def canonical(value: Any) -> str:
    """Canonical JSON of a parsed value of at most ``DEEPEST`` levels."""
    if isinstance(value, str):
        return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, ensure_ascii=False))
    if isinstance(value, float):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value)


def problem(value: Any, schema: dict) -> str | None:
    """The first way in which a value breaks a schema (a common subset of JSON Schema)."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (kind == "integer" and value != int(value)):
            return f"not {kind}"
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return "out of range"
    elif kind and not isinstance(value, KINDS[kind]):
        return f"not {kind}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return "not in enum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return "bad length"
    if isinstance(value, list) and "items" in schema:
        return next((p for x in value if (p := problem(x, schema["items"]))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in sorted(schema.get("required", ())):
            if k not in value:
                return f"{k}: missing"
        for k in sorted(value):
            if k in known:
                if p := problem(value[k], known[k]):
                    return f"{k}: {p}"
            elif schema.get("additionalProperties") is False:
                return f"{k}: unknown"
    return None


def _levels(value: Any) -> int:
    """Levels of nesting, without recursion."""
    now, n = [value], 0
    while now:
        n += 1
        now = [x for v in now if isinstance(v, (list, dict)) for x in (v.values() if isinstance(v, dict) else v)]
    return n


def _finite(text: str) -> float:
    if (x := float(text)) in (float("inf"), float("-inf")):
        raise ValueError(text)
    return x


def _no_constant(text: str) -> Any:
    raise ValueError(text)


def one(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str | None, str | None]:
    """Arguments in canonical JSON (null where they are none) and what is wrong with them."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
    except (TypeError, ValueError):
        return None, "not JSON"
    except RecursionError:
        return None, "too deep"
    if _levels(value) > DEEPEST:
        return None, "too deep"
    if not isinstance(value, dict):
        return canonical(value), "not object"
    return canonical(value), "no schema" if name not in schemas else problem(value, schemas[name])


def written(schemas: dict[str, dict]):
    """Pandas UDF: (name, arguments, content, call id) to the message as canonical JSON and what is
    wrong with the arguments. One writer makes the whole message."""

    @F.pandas_udf("message string, problem string")
    def write(name: pd.Series, text: pd.Series, content: pd.Series, call_id: pd.Series) -> pd.DataFrame:
        out = []
        known = lambda column: [x if isinstance(x, str) else None for x in column]
        for n, t, c, i in zip(*map(known, (name, text, content, call_id)), strict=True):
            arguments, wrong = one(n, t, schemas)
            out.append((f'{{"arguments":{arguments or "null"},"content":{canonical(c)},"id":{canonical(i)},"name":{canonical(n)}}}', wrong))
        return pd.DataFrame(out, columns=["message", "problem"])

    return write


def depths(edges: DataFrame) -> DataFrame:
    """``edges``: conv_id, call_id, after. Gives conv_id, call_id, depth (0 at a chain's start; null on
    a cycle or behind one). Each round doubles the reach of the pointers; rows at their chain's start
    go around the join."""
    known = edges.select("conv_id", F.col("call_id").alias("after"), F.lit(1).alias("_known"))
    pointing = edges.where("after is not null").join(known, ["conv_id", "after"], "left")
    found = F.col("_known").isNotNull()
    now = pointing.select("conv_id", "call_id", F.when(found, F.col("after")).alias("to"), F.when(found, 1).otherwise(0).cast("long").alias("depth"))
    now = now.unionByName(edges.where("after is null").select("conv_id", "call_id", F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("depth")))
    now = stored(now, "depths")
    limit = max(1, int(now.count())).bit_length() + 1
    for _ in range(limit):
        if not now.where("to is not null").limit(1).count():
            break
        target = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        moved = now.where("to is not null").join(target, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        before, now = now, stored(moved.unionByName(now.where("to is null")), "depths")
        dropped(before)
    return now.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls``: conv_id, call_id, name, arguments, after; ``results``: conv_id, call_id, content.

    One row per call and per result without one: conv_id, call_id, depth, status (linked, unanswered,
    orphan, unlinked), n_same, n_answers, problem (null: valid) and message, canonical JSON of call
    and result."""
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one_each = calls.where(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.coalesce("arguments", F.lit("")), "name", "after", "arguments")).alias("c"), F.count("*").alias("n_same")
    ).select("conv_id", "call_id", "c.name", "c.arguments", "c.after", "n_same")
    one_each = stored(one_each, "calls")
    answer = results.where(named).groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_answers"))
    ordered = one_each.drop("after").join(depths(one_each.select("conv_id", "call_id", "after")), ["conv_id", "call_id"]).withColumn("_called", F.lit(1))
    both = ordered.join(answer, ["conv_id", "call_id"], "full").withColumn("status", F.when(F.col("_called").isNull(), "orphan").when(F.col("n_answers").isNull(), "unanswered").otherwise("linked"))
    text, long = F.lit(None).cast("string"), F.lit(None).cast("long")
    columns = ["conv_id", "call_id", "depth", "status", "n_same", "n_answers", "name", "arguments", "content", "_called"]
    lone_calls = calls.where(~named).select("conv_id", "call_id", long.alias("depth"), F.lit("unlinked").alias("status"), F.lit(1).cast("long").alias("n_same"), F.lit(0).cast("long").alias("n_answers"), "name", "arguments", text.alias("content"), F.lit(1).alias("_called"))
    lone_results = results.where(~named).select("conv_id", "call_id", long.alias("depth"), F.lit("unlinked").alias("status"), F.lit(0).cast("long").alias("n_same"), F.lit(1).cast("long").alias("n_answers"), text.alias("name"), text.alias("arguments"), "content", F.lit(None).cast("int").alias("_called"))
    both = both.select(*columns).unionByName(lone_calls.select(*columns)).unionByName(lone_results.select(*columns))
    both = both.withColumn("_c", written(schemas)("name", "arguments", "content", "call_id"))
    return both.select(
        "conv_id", "call_id", "depth", "status", F.coalesce("n_same", F.lit(0)).alias("n_same"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"),
        F.when(F.col("_called").isNotNull(), F.col("_c.problem")).alias("problem"), F.col("_c.message").alias("message"),
    )


#: The one tool of the conversations table: a user's turn asks, the assistant's next turn answers.
ASK = {
    "ask": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 24, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of ``ask``, assistant turns as results of the turn before; a call comes
    after the one two turns before. Turns of any other role (system, tool, null) neither call nor
    answer: they are results of their own turn's number under a name that no call has, so ``link``
    shows each as an orphan with its text. Repeated turns are left to ``link``."""
    ident = lambda c: F.concat(F.lit("call_"), c.cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text"))).alias("arguments"), ident(F.col("turn") - 2).alias("after"),
    )
    answers = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    others = turns.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select("conv_id", F.concat_ws("_", F.coalesce("role", F.lit("turn")), F.col("turn").cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, answers.unionByName(others)


ORACLE = """
WITH calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, 'call_' || (turn - 2) AS after,
         '{"text":' || to_json(text) || ',"turn":' || turn || '}' AS arguments, length(text) AS n
  FROM conversations WHERE role = 'user'),
islands AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM islands),
results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, coalesce(role, 'turn') || '_' || turn, text FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, call_id, c.depth AS depth,
       CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN c.turn IS NULL THEN 0 ELSE 1 END::BIGINT AS n_same,
       CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_answers,
       CASE WHEN c.n < 24 OR c.n > 400 THEN 'text: bad length' END AS problem,
       '{"arguments":' || coalesce(c.arguments, 'null') || ',"content":' || coalesce(to_json(r.content)::VARCHAR, 'null')
         || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '"ask"' END || '}' AS message
FROM ordered c FULL JOIN results r USING (conv_id, call_id)
"""
