"""A corpus pipeline: toxicity, language, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.bagminhash import without_near_duplicates
from tallyforge.llm.langid import of_known_language
from tallyforge.llm.mixing import in_mixture
from tallyforge.llm.packing import pack
from tallyforge.llm.queries import labels
from tallyforge.llm.toxicity import without_toxic
from tallyforge.plans.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", lambda spark, docs, sf_dir: without_toxic(docs, labels(spark, sf_dir))),
    ("language", lambda spark, docs, sf_dir: of_known_language(docs)),
    ("near duplicates", lambda spark, docs, sf_dir: without_near_duplicates(docs)),
    ("mixture", lambda spark, docs, sf_dir: in_mixture(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Toxicity, language and near copies have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: the rows of the last stage over documents.

    Nulls, empty texts, repeated rows, clashing columns and empty tables: as each stage's operator states.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spark.read.parquet(written(out, f"stage-{name.replace(' ', '-')}"))
    return out
