"""Tool calls linked with their results, in an order their dependencies allow, as canonical JSON.

All in DataFrame operations.  Calls and results meet in a hash join on the
identifier; levels of the dependency graph are peeled off round by round;
arguments are checked against the tool's schema as columns; and each call is one
line of JSON with sorted keys and no spare white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import numbered, stored

#: What a JSON type is called by the variant type.
_KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, sorted; empty if they fit the tool's schema.

    A schema gives, for each argument, its JSON type and whether it is required.
    ``not an object``, ``unknown tool``, ``missing x``, ``type of x`` and
    ``unexpected x`` are the findings.  A null argument counts as missing.
    """
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    by_tool: Column = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, (kind, required) in fields.items():
            path = f"$['{field}']"
            own = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            absent = own.isNull() | (own == "VOID")
            wrong = F.when(absent, F.lit(f"missing {field}") if required else F.lit(None)).when(
                ~own.rlike(f"^({_KINDS[kind]})$"), F.lit(f"type of {field}")
            )
            found.append(F.array(wrong))
        by_tool = F.when(name == tool, F.array_sort(F.array_compact(F.concat(*found)))).otherwise(by_tool)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("not an object"))).otherwise(by_tool)


def levels(calls: DataFrame) -> DataFrame:
    """``call_id`` and ``level`` of each call that has dependencies among the calls.

    Level 0 depends on nothing; any other is one above the highest it depends
    on.  Each round settles the calls whose last dependency was settled in the
    round before, so there are as many rounds as levels.  Calls in a cycle, or
    behind one, get no level.
    """
    ids = calls.where("call_id IS NOT NULL").select("call_id").distinct()
    edges = calls.select("call_id", F.explode("depends_on").alias("needs")).where("call_id IS NOT NULL").distinct()
    edges = stored(edges.join(ids.select(F.col("call_id").alias("needs")), "needs", "left_semi"), "call-edges")
    settled = []
    # Those that something needs and that need nothing themselves.
    ready = stored(edges.select(F.col("needs").alias("call_id")).distinct().join(edges, "call_id", "left_anti"), "call-level")
    level = 0
    while not edges.isEmpty():
        left = stored(edges.join(ready.select(F.col("call_id").alias("needs")), "needs", "left_anti"), "call-edges")
        level += 1
        ready = stored(
            edges.select("call_id").distinct().join(left.select("call_id").distinct(), "call_id", "left_anti"), "call-level"
        )
        if ready.isEmpty():
            settled.append(edges.select("call_id").distinct().withColumn("level", F.lit(None).cast("int")))
            break
        settled.append(ready.withColumn("level", F.lit(level)))
        edges = left
    out = calls.sparkSession.createDataFrame([], "call_id string, level int")
    for part in settled:
        out = out.union(part)
    return out


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Every call with its result, its place in its conversation and its line of JSON.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON) and depends_on
    (ids); ``results`` has call_id, turn and content.  Returns a row per call:
    ``conv_id``, ``turn``, ``call_id``, ``level``, ``place`` (from 0 in its
    conversation: by level, then turn; calls in a cycle last), ``errors`` (see
    ``argument_errors``), ``linked`` and ``line``.

    Of several results for an id the earliest counts; a result without a call is
    left out; a call without id has no result and level 0.  Dependencies on ids
    that do not occur count for nothing.  Calls that repeat an id are rows of
    their own that share their result and level.  Null or unreadable arguments
    are null in the line.  Other columns are not looked at.
    """
    rows = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min_by(F.struct("content"), F.struct("turn", "content")).alias("result")
    )
    found = rows.join(answers.hint("shuffle_hash"), "call_id", "left")
    ranked = stored(levels(rows), "call-levels").withColumn("ranked", F.lit(True))
    found = found.join(ranked, "call_id", "left").withColumns(
        {
            # Without dependencies: level 0; in a cycle: none.
            "level": F.when(F.col("ranked"), F.col("level")).otherwise(0),
            "errors": argument_errors(F.col("name"), F.col("arguments"), schemas),
            "linked": F.col("result").isNotNull(),
            "line": F.to_json(
                F.struct(
                    F.try_parse_json("arguments").alias("arguments"),
                    F.col("call_id").alias("id"),
                    "name",
                    F.col("result.content").alias("result"),
                ),
                {"ignoreNullFields": "false"},
            ),
        }
    )
    found = found.select("conv_id", "turn", "call_id", "level", "errors", "linked", "line")
    found = found.withColumn("_last", F.coalesce("level", F.lit((1 << 31) - 1)))
    placed = numbered(found, ["conv_id", "_last", "turn", "call_id"], "calls-in-order")
    placed = stored(placed, "calls-numbered")
    firsts = stored(placed.groupBy("conv_id").agg(F.min("number").alias("first")), "conversation-starts")
    same = placed["conv_id"].eqNullSafe(firsts["conv_id"])
    return placed.join(firsts, same).select(
        placed["conv_id"], "turn", "call_id", "level", (F.col("number") - F.col("first")).alias("place"),
        "errors", "linked", "line",
    )
