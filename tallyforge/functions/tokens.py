"""Token counts in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")
