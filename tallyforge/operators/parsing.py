"""Parsers as DataFrame operators: texts in, rows out. Python runs on Arrow batches only where brackets or YAML need it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions.text import first_given, slug
from ..plans.spread import spread


def fenced_blocks(text: Column) -> Column:
    """The bodies of all ```json blocks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?is)```json\s*(.*?)\s*```"), F.lit(1))


def fenced_tools(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each block that holds a JSON object: position (from 1) and block. All in the JVM."""
    blocks = df.select("*", F.posexplode(fenced_blocks(F.col(text))).alias("position", "block"))
    return blocks.where(F.try_parse_json("block").isNotNull() & F.trim("block").startswith("{")).withColumn("position", F.col("position") + 1)


def _records(df: DataFrame, text: str, schema: str, rows: Callable[[str | None], list[tuple]]) -> DataFrame:
    """df, without the text, with a row for each tuple that rows gives for it."""
    names = [c for c in df.columns if c != text]
    added = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [rows(t) for t in part[text]]
            out = part[names].loc[part.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [r for f in found for r in f]
            for k, name in enumerate(added):
                out[name] = pd.Series([r[k] for r in flat], dtype=object)
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return spread(df).mapInPandas(run, f"{kept}, {schema}" if kept else schema)


def extract_tools(specs: DataFrame, text: str = "text") -> DataFrame:
    """(.., position, tool_name, tool): the named tools of each specification, tool as JSON text with sorted keys."""
    return _records(specs, text, "position int, tool_name string, tool string", lambda t: [(i, D.tool_name(x), D.canonical_json(x)) for i, x in enumerate(D.extracted(t), 1)])


def named_tools(tools: DataFrame) -> DataFrame:
    """Tools with a name, each canonical text once (the first by position), with the name slugged; tools has spec, position, tool (JSON)."""
    parsed = tools.withColumn("__first", F.row_number().over(Window.partitionBy("spec", "tool").orderBy("position"))).where("__first = 1").drop("__first")
    names = [F.trim(F.get_json_object("tool", f"$.{k}")) for k in ("tool_name", "name", "id", "title")]
    named = parsed.withColumn("chosen", first_given(*names))
    return named.withColumn("slug", F.coalesce(slug(F.col("chosen")), F.format_string("tool_%02d", F.col("position"))))


def last_of_slug(tools: DataFrame) -> DataFrame:
    """One row for each (spec, slug): the last by position, as files of one name would be overwritten."""
    return tools.withColumn("__last", F.row_number().over(Window.partitionBy("spec", "slug").orderBy(F.desc("position")))).where("__last = 1").drop("__last")


def coerced_json(text: Column) -> Column:
    """The JSON object in a text: all of it, the first in a fence, or from the first { to the last }; null if there is none. In the JVM."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull(), F.trim(c))
    return F.coalesce(ok(text), ok(fence), ok(outer))


def error_record(text: Column) -> Column:
    """coerced_json, or the record that keeps a text that is no JSON."""
    return F.coalesce(coerced_json(text), F.to_json(F.struct(F.lit(True).alias("_parse_error"), text.alias("_raw"))))


def judgments(answer: Column) -> Column:
    """Struct of judgment (one of VERDICTS or unknown), confidence (0.0 if missing) and reasoning of a judge's answer. In the JVM."""
    fence = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    body = first_given(fence, outer, answer)
    label = F.lower(F.trim(F.get_json_object(body, "$.judgment")))
    return F.struct(
        F.when(label.isin(*D.VERDICTS), label).otherwise("unknown").alias("judgment"),
        F.coalesce(F.get_json_object(body, "$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        first_given(F.get_json_object(body, "$.reasoning"), F.lit("no reasoning given")).alias("reasoning"),
    )


def string_leaves(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., leaf): all text leaves of each YAML text."""
    return _records(df, text, "leaf string", lambda t: [(s,) for s in D.strings(D.yaml_value(t))])


def tools_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., tool): objects under keys that read tools."""
    return _records(df, text, "tool string", lambda t: [(D.canonical_json(x),) for x in D.under_tools(D.yaml_value(t))])


def environment_tasks(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., position, task_type, task, metadata): a row for each task of each environment text; the last two as JSON."""

    def rows(text_: str | None) -> list[tuple]:
        value = D.environment(text_)
        metadata = D.canonical_json(D.metadata_of(value))
        return [(i, name, D.canonical_json(task), metadata) for i, (name, task) in enumerate(D.tasks_of(value), 1)]

    return _records(df, text, "position int, task_type string, task string, metadata string", rows)


def markdown_tasks(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., position, task)."""
    return _records(df, text, "position int, task string", lambda t: [(i, D.canonical_json(x)) for i, x in enumerate(D.markdown_tasks(t or ""), 1)])


def lists_in(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., position, item): the items of each text's list; a text without one gives no row."""

    def rows(text_: str | None) -> list[tuple]:
        try:
            return [(i, x if isinstance(x, str) else D.canonical_json(x)) for i, x in enumerate(D.listed(text_ or ""), 1)]
        except ValueError:
            return []

    return _records(df, text, "position int, item string", rows)


def _text_function(name: str, function: Callable[[dict], str]) -> Callable[[Column], Column]:
    def of(tool: Column) -> Column:
        """Null for what is no JSON object."""

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            parsed = (D.top_level(D._json(v)) if v is not None else None for v in values)
            return pd.Series([None if x is None else function(x) for x in parsed], dtype=object)

        return run(tool)

    of.__name__ = name
    return of


search_text = _text_function("search_text", D.search_text)
embedding_text = _text_function("embedding_text", D.embedding_text)
shown_metadata = _text_function("shown_metadata", lambda x: D.canonical_json(D.shown_metadata(x)))
context_metadata = _text_function("context_metadata", lambda x: D.canonical_json(D.context_metadata(x)))
top_level_tool = _text_function("top_level_tool", D.canonical_json)


def merged_metadata(base: Column, own: Column) -> Column:
    """Two maps as one; own wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
