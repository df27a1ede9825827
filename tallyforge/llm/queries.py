"""The queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, interleave, langid, lattice, lzprint, materialize, mixing, packing, repetition, toxicity


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels of the documents, if there is such a table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/labels.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{sf_dir}/labels.parquet") if there else None


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": _on_documents(mixing.mix),
    "op2_lz_fingerprints": _on_documents(lzprint.linked),
    "op3_repetition": _on_documents(repetition.repetition),
    "op4_lattice_likelihood": _on_documents(lattice.score),
    "op5_best_two_fit": _on_documents(packing.pack),
    "op6_language": _on_documents(langid.identify),
    "op7_interleaving": _on_documents(interleave.interleave),
    "op8_toxicity": lambda spark, sf_dir: toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels(spark, sf_dir)),
    "op9_near_duplicates": _on_documents(bagminhash.near_duplicates),
    "op10_training_order": _on_documents(materialize.materialised),
}

_COUNTED = "len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))"

SQL: dict[str, str] = {
    "op1_mixture": f"""
WITH rows AS (
  SELECT doc_id, source, {_COUNTED} AS tokens, md5('{mixing.SEED}|' || doc_id) AS k FROM documents),
streams AS (
  SELECT doc_id, source, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id) - tokens AS start FROM rows),
sizes AS (
  SELECT source, CAST(floor(sqrt(CAST(sum(tokens) AS DOUBLE)) * 1000) AS BIGINT) AS w, CAST(sum(tokens) AS BIGINT) AS total,
         CAST(sum(tokens) + {mixing.BLOCK_TOKENS} - 1 AS BIGINT) // {mixing.BLOCK_TOKENS} AS supply FROM rows GROUP BY source),
seats AS (
  SELECT source, row_number() OVER (ORDER BY w / (2.0::DOUBLE * n - 1) DESC, source) AS place
  FROM sizes, range(1, ({mixing.EPOCHS} * total + {mixing.BLOCK_TOKENS} - 1) // {mixing.BLOCK_TOKENS} + 1) AS t(n)),
counts AS (
  SELECT source, count(*) AS quota FROM seats
  WHERE place <= (SELECT ceil({mixing.KEEP}::DOUBLE * sum(supply)) FROM sizes) GROUP BY source),
quotas AS (SELECT source, quota, sum(quota) OVER (ORDER BY source) - quota AS before FROM counts),
blocks AS (
  SELECT source, total, quota, before, n AS block, n // supply * supply +
         row_number() OVER (PARTITION BY source, n // supply ORDER BY md5('{mixing.SEED}|' || source || '|' || n), n) - 1 AS r
  FROM quotas JOIN sizes USING (source), range(0, (quota + supply - 1) // supply * supply) AS t(n)),
pieces AS (
  SELECT *, greatest(block * {mixing.BLOCK_TOKENS} - lap * total, 0) AS a, least((block + 1) * {mixing.BLOCK_TOKENS} - lap * total, total) AS z
  FROM (SELECT * FROM blocks WHERE r < quota) AS taken,
       range(block * {mixing.BLOCK_TOKENS} // total, ((block + 1) * {mixing.BLOCK_TOKENS} - 1) // total + 1) AS t(lap))
SELECT source, CAST(block AS BIGINT) AS block, CAST((before + r) % {mixing.SHARDS} AS INTEGER) AS shard, CAST(r // {mixing.SHARDS} AS BIGINT) AS slot, doc_id,
       CAST(greatest(start, a) - start AS BIGINT) AS token_from, CAST(least(start + tokens, z) - start AS BIGINT) AS token_to
FROM pieces JOIN streams USING (source)
WHERE tokens > 0 AND start < z AND start + tokens > a""",
    "op7_interleaving": f"""
WITH ranks AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{interleave.SEED}|' || doc_id), doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n FROM documents),
placed AS (
  SELECT doc_id, source, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source) - 1 AS position, count(*) OVER () AS total
  FROM ranks)
SELECT doc_id, source, CAST(position AS BIGINT) AS position, CAST(position * {interleave.SHARDS} // total AS INTEGER) AS shard FROM placed""",
}
