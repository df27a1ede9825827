"""Documents with everything that may be wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id int, text string, lang string, source string, n_chars int"
LONG = " ".join(f"word{k % 977} in sentence{k % 31}." for k in range(60_000))
ROWS = [
    (1, "The river bends twice before it reaches the old mill.", "en", "web", 53),
    (1, "The river bends twice before it reaches the old mill.", "en", "web", 53),
    (2, None, "en", "web", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "books", 4),
    (None, "A row without a name is still a row of words.", "en", "web", 45),
    (None, None, None, None, None),
    (5, LONG, "en", None, len(LONG)),
    (6, "Alone", None, "books", 5),
    (7, "Une rivière, deux ponts, et le moulin qui tourne encore.", "fr", "web", 57),
    (8, "tie tie tie tie", "en", "books", 15),
    (9, "tie tie tie tie", "en", "books", 15),
    (10, "퟿\U0001f600 ∑∆ 123 ...", "en", "web", 14),
]
#: Names that the operators use inside, or give to their results.
CLASHES = (
    "__row __gone __key __rank __source __group __n __s __f __rep __bucket __weight __sum __before __at __all __quota __supply __taken __file __end key keys a b u v m node "
    "component group_id similarity score clauses toxic keep bits language tokens start block shard slot position bin_id n_tokens token_from record seq one two signature n_words uses piece times word least"
).split()


def messy(spark) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def crowded(docs: DataFrame) -> DataFrame:
    """docs with columns of all the names."""
    return docs.select("*", *(F.lit(f"my {c}").alias(c) for c in CLASHES))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df: DataFrame) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
