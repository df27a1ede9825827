"""Joins and counts of tools, verdicts and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_name, lookup_name


def with_reliability(tools: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """tools with reliable: 1 for a correct verdict, 0 for another, null without one. verdicts has key and judgment."""
    judged = verdicts.groupBy(F.col(key).alias("__key")).agg(F.max(F.when(F.col("judgment") == "correct", 1).otherwise(0)).cast("int").alias("reliable"))
    return tools.join(judged, tools[key] == judged["__key"], "left").drop("__key")


def reliability_counts(tools: DataFrame) -> DataFrame:
    """(reliable_1, reliable_0, reliable_null, total)."""
    r = F.col("reliable")
    return tools.agg(F.count_if(r == 1).alias("reliable_1"), F.count_if(r == 0).alias("reliable_0"), F.count_if(r.isNull()).alias("reliable_null"), F.count(F.lit(1)).alias("total"))


def folder_counts(files: DataFrame) -> DataFrame:
    """(folders, non_empty, correct, incorrect, missing_judge, unparsable, issues) of evaluation logs.

    files has folder, kind (log, judge, or null for a folder without files) and judgment (null where a verdict
    can't be read, which counts as neither correct nor incorrect). A folder with a log and no verdict misses its judge.
    """
    judge = F.col("kind") == "judge"
    per = files.groupBy("folder").agg(
        F.coalesce(F.max(F.col("kind") == "log"), F.lit(False)).alias("log"), F.coalesce(F.max(judge), F.lit(False)).alias("judged"),
        F.count_if(judge & (F.col("judgment") == "correct")).alias("right"), F.count_if(judge & (F.col("judgment") != "correct")).alias("wrong"), F.count_if(judge & F.col("judgment").isNull()).alias("unread"),
    )
    missing = F.col("log") & ~F.col("judged")
    return per.agg(
        F.count(F.lit(1)).alias("folders"), F.count_if(F.col("log") | F.col("judged")).alias("non_empty"), F.count_if(F.col("right") > 0).alias("correct"),
        F.count_if(F.col("wrong") > 0).alias("incorrect"), F.count_if(missing).alias("missing_judge"), F.count_if(F.col("unread") > 0).alias("unparsable"),
        (F.count_if(missing) + F.count_if(F.col("wrong") > 0)).alias("issues"),
    )


def loose_counts(files: DataFrame) -> DataFrame:
    """(folders, loose_json, fixed_correct): the older count; files has folder, file_name, judgment; folder is null for files beside the folders."""
    return files.agg(
        F.countDistinct("folder").alias("folders"), F.count_if(F.col("folder").isNull() & F.col("file_name").endswith(".json")).alias("loose_json"),
        F.count_if((F.col("file_name") == "meta_data_tool_call_fixed.judge.json") & (F.col("judgment") == "correct")).alias("fixed_correct"),
    )


def with_specs(tools: DataFrame, specs: DataFrame) -> DataFrame:
    """tools with subfield and task of their (field, spec); null where there is none. specs has one row for each (field, spec)."""
    return tools.join(specs.select("field", "spec", "subfield", "task"), ["field", "spec"], "left")


def with_tools(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """(spec, task_id, position, tool_name, tool_json): a row for each tool that a task requires, tool_json null where none is found.

    Names are compared with runs of other characters as one underscore, within one spec. tasks has spec, task_id, tools_required; tools spec, tool_name, tool_json.
    """
    wanted = tasks.select("spec", "task_id", F.posexplode("tools_required").alias("position", "tool_name")).withColumn("__key", joined_name(F.col("tool_name")))
    known = tools.groupBy("spec", joined_name(F.col("tool_name")).alias("__key")).agg(F.min("tool_json").alias("tool_json"))
    return wanted.join(known, ["spec", "__key"], "left").select("spec", "task_id", (F.col("position") + 1).alias("position"), "tool_name", "tool_json")


def task_documents(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """(spec, task_id, valid, tools): tasks with the tools they require as an ordered array; valid if none is missing."""
    rows = with_tools(tasks, tools)
    return rows.groupBy("spec", "task_id").agg(
        (F.count_if(F.col("tool_json").isNull()) == 0).alias("valid"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "tool_name", "tool_json"))), lambda t: F.struct(t["tool_name"].alias("tool_name"), t["tool_json"].alias("tool_json"))).alias("tools"),
    )


def preferred(candidates: DataFrame, keys: list[str], better: Column, order: list[Column]) -> DataFrame:
    """One row for each key: a better one if there is any, else the first by order."""
    first = Window.partitionBy(*keys).orderBy(F.desc(better.cast("int")), *order)
    return candidates.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")


def metadata_files(tools: DataFrame, files: DataFrame) -> DataFrame:
    """(tool_id, path): of the metadata files of a tool's name that of the tool's own spec, else the first by path.

    tools has tool_id, tool_name and spec, files path (<field>_tool_spec_<n>__<name>__output.json).
    """
    named = files.select("path", lookup_name(F.regexp_extract("path", r"__(.+)__output\.json$", 1)).alias("__key"), F.regexp_extract("path", r"_tool_spec_(\d+)__", 1).try_cast("long").alias("__spec"))
    # tools meet one file of a name and one of a name and spec, not all files of the name
    first, own = (named.groupBy(*keys).agg(F.min("path").alias(name)) for keys, name in ((["__key"], "__first"), (["__key", "__spec"], "__own")))
    keyed = tools.select("tool_id", "spec", lookup_name(F.col("tool_name")).alias("__key")).join(first, "__key")
    both = keyed.join(own.withColumnRenamed("__key", "__name"), (F.col("__key") == F.col("__name")) & (F.col("spec") == F.col("__spec")), "left")
    return both.groupBy("tool_id").agg(F.coalesce(F.min("__own"), F.min("__first")).alias("path"))


def not_done(todo: DataFrame, done: DataFrame, key: str, more_than: int = 0) -> DataFrame:
    """Rows of todo of which done has no more than so many."""
    enough = done.groupBy(F.col(key).alias("__done")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > more_than)
    return todo.join(enough, todo[key] == enough["__done"], "left_anti")


def first_distinct(df: DataFrame, parent: str, value: str, order: str, most: int) -> DataFrame:
    """The first so many distinct values of each parent, by order."""
    once = df.groupBy(parent, value).agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(order, value))
    return once.withColumn("place", rank).where(F.col("place") <= most)


def next_spec(ids: DataFrame, key: str = "id") -> DataFrame:
    """(next_spec): one more than the largest spec number of all ids, 1 if there is none."""
    return ids.agg((F.coalesce(F.max(F.regexp_extract(key, r"_tool_spec_(\d+)", 1).try_cast("long")), F.lit(0)) + 1).alias("next_spec"))


def available(uses: DataFrame, group: str, tool: str = "tool_name") -> DataFrame:
    """(group, n, tools): how many different tools each group has, and their names in order, with commas."""
    names = F.array_sort(F.collect_set(F.col(tool).cast("string")))
    return uses.groupBy(group).agg(F.countDistinct(tool).alias("n"), F.array_join(names, ", ").alias("tools"))
