"""Writers. Each writes from the executors; a folder is replaced only as a whole."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def tool_list(tools: DataFrame, path: str, flags: DataFrame | None = None, keys: list[str] | None = None) -> None:
    """JSON lines in order of id: the tools' columns and, from flags (id, tau, dropped), dropped_<tau> for each of keys."""
    out = tools
    if flags is not None:
        wide = flags.withColumn("__c", F.concat(F.lit("dropped_"), F.col("tau"))).groupBy(F.col("id").alias("__id")).pivot("__c", [f"dropped_{k}" for k in keys or []] or None).agg(F.max("dropped"))
        out = out.join(wide, out["id"] == wide["__id"], "left").drop("__id")
    out.orderBy("id").write.mode("overwrite").json(path)


def survivors(tools: DataFrame, flags: DataFrame, path: str) -> None:
    """The tools left at each threshold, as one folder tau=<key> each, replaced as a whole; tools has id and tool (JSON), flags id, tau and dropped."""
    left = flags.where(~F.col("dropped")).select(F.col("id").alias("__id"), "tau")
    tools.join(left, tools["id"] == left["__id"]).drop("__id").write.mode("overwrite").partitionBy("tau").json(path)


def vectors(df: DataFrame, path: str) -> None:
    """(id, model, embedding, text_length, embedding_dim, dtype) as Parquet, vectors of length one; a zero vector stays."""
    from ..functions.vectors import unit

    df.select("id", "model", F.transform(unit(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"), "text_length", F.size("embedding").cast("long").alias("embedding_dim"), F.lit("float32").alias("dtype")).write.mode("overwrite").parquet(path)


def statistics(frames: dict[str, DataFrame], path: str) -> list[str]:
    """A CSV folder for each named frame; one without rows is left out. The names written."""
    done = []
    for name, frame in frames.items():
        if not frame.isEmpty():
            frame.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
            done.append(name)
    return done


def judged(df: DataFrame, path: str) -> None:
    """Verdicts (id, judgment, confidence, reasoning) as JSON, by judgment."""
    df.write.mode("overwrite").partitionBy("judgment").json(path)


def appended(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows added to what is there: logs grow by rows, and no record is read to be written again."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def category(test_id: Column) -> Column:
    """A test's id without its last part; its first two parts for normal_multi_turn ids."""
    multi = F.array_join(F.slice(F.split(test_id, "_"), 1, 4), "_")
    return F.when(test_id.startswith("normal_multi_turn"), multi).otherwise(F.regexp_replace(test_id, "_[^_]*$", ""))


def results(df: DataFrame, path: str, test_id: str = "id") -> None:
    appended(df.withColumn("category", category(F.col(test_id))), path, ["category"])


def per_task(df: DataFrame, path: str) -> None:
    """Task documents by (spec, n)."""
    df.write.mode("overwrite").partitionBy("spec", "n").json(path)


def literal_yaml(records: Column) -> Column:
    """JSON texts as YAML with literal blocks (|-) for texts of several lines."""
    import json

    import yaml

    class Literal(yaml.SafeDumper):
        pass

    Literal.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else yaml.dump(json.loads(v), Dumper=Literal, allow_unicode=True, sort_keys=False, width=2**31))

    return run(records)


def texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One text a row, as text files."""
    df.select(F.replace(F.col(text), F.lit("\r"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def chat_index(df: DataFrame, latest: int, group: str, order: str) -> DataFrame:
    """df with index: numbers that go on from the latest one used, by group and order."""
    from pyspark.sql import Window

    return df.withColumn("index", F.row_number().over(Window.partitionBy(group).orderBy(order)) + F.lit(latest))


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def dialogue(messages: list[tuple[str, str, str]], width: int = 120) -> str:
    """(sender, recipient, message) as a table with fixed columns; wide characters count twice and messages wrap at width."""
    head = [("sender", "recipient", "message"), *messages]
    sizes = [max(_width(r[k]) for r in head) for k in (0, 1)]
    lines = []
    for a, b, text in head:
        parts = []
        for line in text.split("\n"):
            now = ""
            for ch in line:
                if _width(now + ch) > width:
                    parts.append(now)
                    now = ""
                now += ch
            parts.append(now)
        for k, part in enumerate(parts):
            left = (a, b) if k == 0 else ("", "")
            lines.append(" | ".join([*(v + " " * (s - _width(v)) for v, s in zip(left, sizes)), part]).rstrip())
    return "\n".join(lines)


def flag_column(tau: float) -> str:
    """The column of a threshold's flag."""
    return "dropped_" + ("%.6f" % tau).rstrip("0").rstrip(".")

