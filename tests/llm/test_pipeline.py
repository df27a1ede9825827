"""The pipeline against its stages by brute force."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from tallyforge.llm import bagminhash as B
from tallyforge.llm import langid as L
from tallyforge.llm import mixing, packing
from tallyforge.llm import toxicity as T
from tallyforge.llm.queries import SQL
from tallyforge.llm.words import steps

from .test_packing import naive


def test_pipeline_against_brute_force(spark, sf_dir, tables):
    sf_dir = f"{sf_dir}/../sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect())
    machine, learnt = T.grammar(), T.learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    everything = {w: c for words in learnt.values() for w, c in words.items()}
    rows = [r for r in rows if sum(T.clause_scores(r[1], machine, r[2], learnt.get(r[2]) or everything)) < T.LEAST]
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    reference, limits = L.learnt(L.labelled_sample(left))
    starts = {n: L.automaton(t) for n, t in sorted(reference.items())}

    def known(text):
        letters = L.letters(text)
        size = max(1, len(letters))
        bits = {n: L.phrase_count(letters, s) * L.math.log2(len(reference[n])) / size for n, s in starts.items()}
        best = min(bits, key=bits.get)
        return bool(letters) and bits[best] <= limits[best] + L.PHRASES * L.math.log2(len(reference[best])) / size

    rows = [r for r in rows if known(r[1])]
    bags = []
    for step in steps(pa.array([r[1] for r in rows], pa.string())):
        doc, feature, times = B.bags(step)
        bags += [(feature[doc == i], times[doc == i]) for i in range(step.n)]
    stay: list[int] = []
    for k in range(len(rows)):
        if all(B.overlap(bags[k], bags[j]) < B.LEAST for j in stay):
            stay.append(k)
    rows = [rows[k] for k in stay]
    tables.execute("CREATE OR REPLACE TEMP TABLE left_over (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    tables.executemany("INSERT INTO left_over VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    taken = {r[0] for r in tables.execute(f"SELECT doc_id FROM ({SQL['op1_mixture'].replace('FROM documents)', 'FROM left_over)')}) WHERE token_from = 0").fetchall()}
    rows = [r for r in rows if r[0] in taken]
    sizes = [(r[0], len([w for w in r[1].replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])) for r in rows]
    rest = [(i, n // packing.CAPACITY * packing.CAPACITY, n % packing.CAPACITY) for i, n in sizes if n % packing.CAPACITY]
    wanted = {(k, p, *rest[i]) for k, b in enumerate(naive([n for _, _, n in rest], packing.CAPACITY)) for p, i in enumerate(b)}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert wanted and {tuple(r) for r in found if r["n_tokens"] < packing.CAPACITY} == {w for w in wanted if w[-1] < packing.CAPACITY}
    assert sum(r["n_tokens"] for r in found) == sum(n for _, n in sizes)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert mixing.SHARDS and corpus_pipeline.ORACLE_SQL is None
