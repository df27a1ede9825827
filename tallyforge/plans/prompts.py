"""Prompts assembled from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, filled_block, indented


def multi_turn(template: Column, task: Column, tools: Column) -> Column:
    """The template with {{task}} and {{tools_data}} as indented blocks."""
    return F.replace(F.replace(template, F.lit("{{task}}"), indented(task, "  ")), F.lit("{{tools_data}}"), indented(tools, "  "))


def from_template(df: DataFrame, template: str, **columns: str) -> DataFrame:
    """df with prompt: the template with each {name} as the column given for it."""
    return df.withColumn("prompt", filled(F.lit(template), **{k: F.coalesce(F.col(c), F.lit("")) for k, c in columns.items()}))


def with_block(df: DataFrame, template: str, placeholder: str, block: str) -> DataFrame:
    """df with prompt: the template's placeholder line as the block, indented; a template without that line is an error."""
    return df.withColumn("prompt", filled_block(F.lit(template), placeholder, F.col(block)))
