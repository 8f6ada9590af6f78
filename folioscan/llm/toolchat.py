"""Tool-call linking for chat formatting: join calls and results by identifier, order them, check them, write JSON."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, map_texts, scratch_path

TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, and nothing escaped but what must be. Whole numbers have no fraction: 1.0 and 1e0 are 1."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _number(text: str) -> int | float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is out of range")
    return int(value) if value.is_integer() and abs(value) < 2 ** 53 else value


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    members = dict(pairs)
    if len(members) < len(pairs):
        raise ValueError("a key stands twice in one object")
    return members


def strict_json(text: str) -> Any:
    """The value of a JSON text; NaN, infinities, numbers beyond a double and repeated keys are refused."""
    return json.loads(text, parse_float=_number, parse_constant=_refuse, object_pairs_hook=_members)


def _is(kind: str | list[str], value: Any) -> bool:
    if isinstance(kind, list):
        return any(_is(k, value) for k in kind)
    if kind in ("number", "integer"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or whole)
    return isinstance(value, TYPES[kind])


def faults(value: Any, schema: dict, path: str = "") -> list[str]:
    """What a value lacks to fit a schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    here = path or "arguments"
    if "type" in schema and not _is(schema["type"], value):
        return [f"{here}: not {schema['type'] if isinstance(schema['type'], str) else ' or '.join(schema['type'])}"]
    allowed = [canonical(strict_json(json.dumps(v))) for v in schema["enum"]] if "enum" in schema else []
    found = [f"{here}: not one of the allowed values"] if "enum" in schema and canonical(value) not in allowed else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{here}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            found += [f"{here}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                found += faults(value[k], known[k], f"{here}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += faults(item, schema["items"], f"{here}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{here}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{here}: range")
    return found


def levels(calls: DataFrame) -> DataFrame:
    """`(conv_id, call_id, level)` of `calls (conv_id, call_id, after)`: how many calls must run before one.

    A call waits for one other, named in `after`. Pointer jumping doubles the distance looked at in every round, so a chain
    of n calls takes log2(n) joins on the unique identifiers, however long a conversation is, and no conversation is
    gathered. A call that waits for itself through others never reaches a start: its level is null."""
    spark = calls.sparkSession
    ids = calls.select("conv_id", F.col("call_id").alias("target__")).withColumn("there__", F.lit(True))
    known = calls.select("conv_id", "call_id", F.col("after").alias("target__")).join(ids, ["conv_id", "target__"], "left")
    state = known.select("conv_id", "call_id", F.when(F.col("there__"), F.col("target__")).alias("jump"),
                         F.when(F.col("there__"), 1).otherwise(0).cast("long").alias("level"))
    path = None
    before, rounds = None, 0
    while True:
        fresh = scratch_path(spark, "levels")
        state.write.parquet(fresh)
        if path:
            drop_path(spark, path)
        path = fresh
        state = spark.read.schema(state.schema).parquet(path)
        moving, total = state.agg(F.count("jump"), F.count("*")).first()
        if not moving or moving == before and 1 << rounds > total:
            break
        before, rounds = moving, rounds + 1
        step = state.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("jump2"), F.col("level").alias("level2"))
        state = state.join(step, ["conv_id", "jump"], "left").select(
            "conv_id", "call_id", F.col("jump2").alias("jump"), F.when(F.col("jump").isNotNull() & (F.col("level") < 1 << 62), F.try_add("level", F.coalesce("level2", F.lit(0))))
            .otherwise(F.col("level")).alias("level"))
    return state.select("conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call identifier of a conversation, and per result that no call asked for.

    `calls (conv_id, call_id, position, name, arguments, after)`, `results (conv_id, call_id, position, content)`; more
    columns are not read. Returns `conv_id, call_id, position, level, status, faults, record`. `status` is linked, unanswered,
    orphan (a result without call), cycle (it waits for itself) or unnamed (no identifier: such rows stand alone and unlinked).
    Of repeated identifiers the earliest call and result count, ties by their content. (level, position, call_id) is a
    topological order; level is null for orphans and cycles. `faults` lists what the arguments violate: no JSON (NaN, infinities
    and repeated keys are none), unknown tool, or the schema. `record` is canonical JSON of id, name, arguments (the text itself if it is no JSON) and result.
    Null names, arguments and contents are JSON null. Empty tables give no rows. Both sides are reduced to one row per
    identifier before they meet, so the join keys are unique and no conversation is gathered."""
    first = lambda df, *cols: df.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", *cols)).alias("s")).select("conv_id", "call_id", "s.*")
    cols, out = ["conv_id", "call_id", "position", "name", "arguments", "after"], ["conv_id", "call_id", "position", "content"]
    calls, results = calls.select(*cols), results.select(*out)
    missing = F.col("call_id").isNull() | F.col("conv_id").isNull()
    named, answers = first(calls.where(~missing), "name", "arguments", "after"), first(results.where(~missing), "content")
    order = levels(named)
    linked = named.join(order, ["conv_id", "call_id"]).withColumn("called", F.lit(True)).join(
        answers.select("conv_id", "call_id", F.col("position").alias("position2"), "content", F.lit(True).alias("answered")), ["conv_id", "call_id"], "full")
    status = (F.when(F.col("called").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("linked"))
    linked = linked.select("conv_id", "call_id", F.coalesce("position", "position2").alias("position"), "level", status.alias("status"), "name", "arguments", "content")
    alone = calls.where(missing).select("conv_id", "call_id", "position", F.lit(None).cast("long").alias("level"), F.lit("unnamed").alias("status"), "name", "arguments",
                                        F.lit(None).cast("string").alias("content"))
    loose = results.where(missing).select("conv_id", "call_id", "position", F.lit(None).cast("long").alias("level"), F.lit("unnamed").alias("status"),
                                          F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content")
    rows = linked.unionByName(alone).unionByName(loose).withColumn("raw__", F.to_json(F.struct(F.col("call_id").cast("string").alias("id"), "name", "arguments", "content", "status"),
                                                                                   {"ignoreNullFields": "false"}))

    def make():
        def work(raw: str) -> tuple:
            row = json.loads(raw)
            value, found = row["arguments"], []
            if row["status"] != "orphan" and not (row["status"] == "unnamed" and row["name"] is None and value is None):
                try:
                    value = strict_json(value) if value is not None else None
                    canonical(value).encode()
                except (ValueError, RecursionError):
                    value, found = row["arguments"], ["arguments: no JSON"]
                if row["name"] not in schemas:
                    found = [*found, "name: unknown tool"]
                elif not found:
                    found = faults(value, schemas[row["name"]])
            return found, canonical({"id": row["id"], "name": row["name"], "arguments": value, "result": row["content"]})
        return work

    return map_texts(rows, ["conv_id", "call_id", "position", "level", "status"], "raw__", "faults array<string>, record string", make)
