from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import interleave, mixing
from tallyforge.llm.queries import QUERIES, SQL

from ..comparing import assert_same


def test_queries_equal_their_sql(spark, sf_dir, tables):
    for name, sql in SQL.items():
        assert_same(QUERIES[name](spark, sf_dir).toPandas(), tables.execute(sql).df())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 12)), max_size=6), st.integers(0, 40))
def test_apportion_takes_the_highest_quotients(sources, house):
    weights, caps = [w for w, _ in sources], [c for _, c in sources]
    quotients = sorted((-w / (2 * k - 1), i) for i, (w, c) in enumerate(sources) for k in range(1, c + 1) if w)
    wanted = Counter(i for _, i in quotients[:house])
    assert mixing.apportion(weights, caps, house) == [wanted[i] for i in range(len(sources))]


def test_blocks_are_whole_and_shards_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size: Counter = Counter()
    shards = defaultdict(set)
    for r in mixing.mix(docs, block_tokens=64, shards=4).collect():
        size[r["source"], r["block"]] += r["token_to"] - r["token_from"]
        shards[r["shard"]].add((r["source"], r["block"]))
    assert size and set(size.values()) == {64}
    counts = [Counter(s for s, _ in shards[k]) for k in range(4)]
    assert all(abs(c[s] - d[s]) <= 1 for c in counts for d in counts for s in counts[0] | d)
    assert max(c.total() for c in counts) - min(c.total() for c in counts) <= 1


def test_no_source_is_too_small(spark):
    rows = [(k, "w " * 900, "nine") for k in range(9)] + [(100, "one two three", "tiny"), (101, None, "empty")] + [(k, "w " * 900, "hot") for k in range(200, 500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = mixing.mix(docs).collect()
    size: Counter = Counter()
    for r in found:
        size[r["source"], r["block"]] += r["token_to"] - r["token_from"]
    assert set(size.values()) == {mixing.BLOCK_TOKENS}
    blocks = Counter(s for s, _ in size)
    supply = {"nine": 8, "tiny": 1, "hot": 264}
    assert blocks.total() == -(-8 * sum(supply.values()) // 10)
    weights = {"hot": (300 * 900) ** 0.5, "nine": 8100**0.5, "tiny": 3**0.5}
    assert all(abs(blocks[s] - w / sum(weights.values()) * blocks.total()) <= 1 for s, w in weights.items() if s != "nine")
    assert blocks["nine"] == -(-mixing.EPOCHS * 8100 // 1024) and blocks["tiny"] == 1
    assert {r["doc_id"] for r in found if r["source"] != "hot"} == {*range(9), 100}
    kept = mixing.in_mixture(docs).collect()
    assert {r["doc_id"] for r in kept if r["source"] != "hot"} == {*range(9), 100}
    assert len(kept) > 0.7 * 310


def test_given_weights(spark):
    docs = spark.createDataFrame([(k, "a b c d " * 8, "xyz"[k % 3]) for k in range(300)], "doc_id int, text string, source string")
    weights = spark.createDataFrame([("x", 3), ("y", 1)], "source string, weight int")
    found = mixing.mix(docs, weights, block_tokens=32, shards=2, keep=0.4).select("source", "block").distinct().groupBy("source").count()
    assert {r[0]: r[1] for r in found.collect()} == {"x": 90, "y": 30}


def test_every_shard_matches_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    found = interleave.interleave(docs).collect()
    assert sorted(r["position"] for r in found) == list(range(len(found)))
    total = Counter(r["source"] for r in found)
    for shard in range(interleave.SHARDS):
        here = Counter(r["source"] for r in found if r["shard"] == shard)
        assert all(abs(here[s] - n / interleave.SHARDS) < 2 for s, n in total.items())
