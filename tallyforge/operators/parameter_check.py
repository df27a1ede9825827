"""Rules for a tool call against the tool's schema.

Checks run in a fixed order and the first fault is reported: tool name, required parameters (as the
schema lists them), parameter names (as the call lists them), types, allowed ranges that a description states. All in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a call's value may be in JSON's own types for each declared type.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}
SPEC = "map<string,struct<type:string,required:boolean,items:struct<type:string>,minItems:int,maxItems:int>>"


def _spaced(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def _kind(value: Column) -> Column:
    """The JSON type of a value given as JSON text."""
    text = F.trim(value)
    return (
        F.when(text.startswith('"'), "STRING").when(text.startswith("["), "ARRAY").when(text.startswith("{"), "OBJECT").when(text.isin("true", "false"), "BOOLEAN")
        .when(text == "null", "NULL").when(text.rlike(r"^-?\d+$"), "BIGINT").otherwise("DOUBLE")
    )


def _fits(value: Column, spec: Column) -> Column:
    kind, type_ = _kind(value), F.lower(spec["type"])
    scalar = F.lit(False)
    for name, kinds in _KINDS.items():
        scalar = scalar | ((type_ == name) & kind.isin(kinds))
    items = F.from_json(value, "array<string>")
    sizes = (F.coalesce(spec["minItems"], F.lit(0)) <= F.size(items)) & (F.size(items) <= F.coalesce(spec["maxItems"], F.lit(2**31 - 1)))
    nested = value.rlike(r"^\s*\[\s*[\[{]")
    return F.when(type_.isin("array", "list"), (kind == "ARRAY") & ~nested & sizes).when(type_.isin("object", "dictionary"), kind == "OBJECT").when(type_.isin(*_KINDS), scalar).otherwise(True)


def check(calls: DataFrame) -> DataFrame:
    """calls with status (PASS or FAIL), code and message.

    calls has tool_name, parameters (JSON of the schema), called_name and arguments (JSON object). A name may have underscores for
    blanks. Messages: Invalid tool name, Missing required parameter, Unknown parameter, Invalid type for; null for PASS.
    """
    spec = F.from_json("parameters", SPEC)
    given = F.from_json("arguments", "map<string,string>", {"primitivesAsString": "true"})
    # values as JSON text, so that "1" and 1 differ
    raw = F.map_from_entries(F.transform(F.json_object_keys("arguments"), lambda k: F.struct(_spaced(k).alias("key"), k.alias("value"))))
    df = calls.withColumn("__spec", F.map_from_entries(F.transform(F.map_entries(spec), lambda e: F.struct(_spaced(e["key"]), e["value"])))).withColumn("__given", F.map_from_entries(F.transform(F.map_entries(given), lambda e: F.struct(_spaced(e["key"]), e["value"])))).withColumn("__keys", F.map_keys(raw))
    quoted = F.from_json("arguments", "map<string,variant>")
    df = df.withColumn("__json", F.map_from_entries(F.transform(F.map_entries(quoted), lambda e: F.struct(_spaced(e["key"]), F.to_json(e["value"])))))
    entries = F.map_entries("__spec")
    missing = F.try_element_at(F.filter(entries, lambda e: F.coalesce(e["value"]["required"], F.lit(False)) & ~F.array_contains("__keys", e["key"])), F.lit(1))["key"]
    unknown = F.try_element_at(F.filter("__keys", lambda k: ~F.array_contains(F.map_keys("__spec"), k)), F.lit(1))
    wrong = F.try_element_at(F.filter("__keys", lambda k: ~F.coalesce(_fits(F.try_element_at("__json", k), F.try_element_at("__spec", k)), F.lit(True))), F.lit(1))
    type_ = F.try_element_at("__spec", wrong)["type"]
    named = _spaced(F.col("called_name")) == _spaced(F.col("tool_name"))
    message = (
        F.when(~F.coalesce(named, F.lit(False)), F.concat(F.lit("Invalid tool name: "), F.coalesce("called_name", F.lit("")), F.lit(".")))
        .when(missing.isNotNull(), F.concat(F.lit("Missing required parameter: "), missing, F.lit(".")))
        .when(unknown.isNotNull(), F.concat(F.lit("Unknown parameter: "), unknown, F.lit(".")))
        .when(wrong.isNotNull(), F.concat(F.lit("Invalid type for "), wrong, F.lit(": expected "), type_, F.lit(".")))
    )
    df = df.withColumn("message", message)
    return df.withColumn("status", F.when(F.col("message").isNull(), "PASS").otherwise("FAIL")).withColumn("code", F.when(F.col("message").isNull(), 200).otherwise(400)).drop("__spec", "__given", "__keys", "__json")


def error_branch(response: Column) -> Column:
    """Whether a checker's answer lets the call pass."""
    return response.contains("Status: PASS")
