"""Function calls in interaction logs: extraction, resolution and verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import calls as C
from ..functions.text import lookup_name, stripped

CALL = Y.ArrayType(Y.StructType([Y.StructField("name", Y.StringType()), Y.StructField("parameters", Y.MapType(Y.StringType(), Y.StringType())), Y.StructField("canonical", Y.StringType())]))


@F.pandas_udf(CALL)
def calls(texts: pd.Series) -> pd.Series:
    """All calls of each text: name, parameters as text, canonical form."""
    return pd.Series([[{"name": n, "parameters": p, "canonical": C.canonical_of(n, p)} for n, p in map(C.normalised, C.all_calls(t))] for t in texts])


@F.pandas_udf(Y.StructType([Y.StructField("canonical", Y.ArrayType(Y.StringType())), Y.StructField("extraneous", Y.BooleanType())]))
def scanned(texts: pd.Series) -> pd.DataFrame:
    """The canonical calls of each text, and whether there is more than calls and white space, from one scan."""
    found = [C.all_calls(t) for t in texts]
    rest = ["".join((t or "").split()) != "".join("".join(c.split()) for c in some) for t, some in zip(texts, found)]
    return pd.DataFrame({"canonical": [[C.canonical(c) for c in some] for some in found], "extraneous": rest})


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def call_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([C.all_calls(t) for t in texts])


@F.pandas_udf(Y.BooleanType())
def agent_turns(texts: pd.Series) -> pd.Series:
    return pd.Series([C.is_agent_turn(t) for t in texts])


@F.pandas_udf(Y.StringType())
def decoded_calls(texts: pd.Series) -> pd.Series:
    """Calls in Python's syntax as JSON; null for what can't be read."""
    import json

    def one(text):
        try:
            return None if text is None else json.dumps(C.decoded(text), default=str)
        except ValueError:
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def attempts(text: Column) -> Column:
    """The bodies between two <ATTEMPT> tags, then those between <ATTEMPT_START> and <ATTEMPT_END>, trimmed."""
    first = F.regexp_extract_all(text, F.lit(r"(?s)<ATTEMPT>(.*?)<ATTEMPT>"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(r"(?s)<ATTEMPT_START>(.*?)<ATTEMPT_END>"), F.lit(1))
    return F.transform(F.concat(first, second), stripped)


def without_attempts(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(text, r"(?s)<ATTEMPT>.*?<ATTEMPT>", ""), r"(?s)<ATTEMPT_START>.*?<ATTEMPT_END>", ""))


def extraneous(attempt: Column) -> Column:
    """Whether there is more than calls and white space."""
    return F.regexp_replace(attempt, r"(?U)\s+", "") != F.regexp_replace(F.array_join(call_texts(attempt), ""), r"(?U)\s+", "")


def same_calls(a: Column, b: Column, in_order: bool) -> Column:
    """Arrays of canonical calls as sequences or as multisets."""
    return a == b if in_order else F.array_sort(a) == F.array_sort(b)


def verify(logs: DataFrame, solutions: DataFrame, in_order: bool = False) -> DataFrame:
    """(task, n, attempt, verdict): each attempt of each turn, as correct, wrong or extraneous.

    logs has task, n and agent_text, solutions task and solution (array of calls as text).
    """
    tried = logs.select("task", "n", F.posexplode(attempts(F.col("agent_text"))).alias("attempt", "body"))
    wanted = solutions.select("task", scanned(F.array_join("solution", "\n"))["canonical"].alias("__wanted"))
    judged = tried.join(wanted, "task").withColumn("__got", scanned(F.col("body")))
    right = same_calls(F.col("__got.canonical"), F.col("__wanted"), in_order)
    return judged.select("task", "n", F.col("attempt") + 1, F.when(F.col("__got.extraneous"), "extraneous").when(right, "correct").otherwise("wrong").alias("verdict")).toDF("task", "n", "attempt", "verdict")


def resolve(turns: DataFrame, tools: DataFrame, text: str = "agent_text") -> DataFrame:
    """turns with called (the first name before a bracket), tool_id, and an error for a name that no tool has.

    Names are compared by letters and digits only. tools has tool_id and tool_name; of equal names the lowest tool_id counts.
    """
    named = turns.withColumn("called", F.regexp_extract(F.col(text), r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)).withColumn("__key", F.when(F.col("called") != "", lookup_name(F.col("called"))))
    registry = tools.groupBy(lookup_name(F.col("tool_name")).alias("__key")).agg(F.min("tool_id").alias("tool_id"))
    missed = F.format_string("Status Code: 500\nResponse: {\"error\": \"TOOL_NOT_FOUND\", \"tool\": \"%s\"}", F.col("called"))
    return named.join(registry, "__key", "left").withColumn("error", F.when(F.col("tool_id").isNull(), missed)).drop("__key")


def until_finished(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", text: str = "text", most: int | None = None) -> DataFrame:
    """messages up to the first after the second that says finish conversation, and not over most of them."""
    ends = F.min(F.when((F.col(order) > 1) & F.col(text).contains("finish conversation"), F.col(order))).over(Window.partitionBy(conversation))
    kept = messages.withColumn("__end", ends).where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")
    return kept if most is None else kept.where(F.col(order) < most)
