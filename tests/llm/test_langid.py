from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import langid as L


def greedy(text: str, reference: str) -> int:
    """Phrases of a greedy parse, by searching the reference."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        at += n
        count += 1
    return count


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=40), st.text("abc ", max_size=60))
def test_phrases_against_search(reference, text):
    assert L.phrase_count(text, L.automaton(reference)) == greedy(text, reference)


def test_table_equals_one_by_one():
    rng = random.Random(3)
    reference = {name: "".join(rng.choices(abc + " ", k=500)) for name, abc in (("x", "abcé"), ("y", "bcdß"), ("z", "aeiou"))}
    texts = ["".join(rng.choices("abcdeéßuX .3\n", k=rng.choice([0, 1, 5, 300]))) for _ in range(300)] + [None, "", "   ", "a" * 50_000]
    parser = L.Parser(reference)
    parser.STEP = 2000  # several parts
    size, found = parser.counts(texts)
    wanted = [L.letters(t) for t in texts]
    assert size.tolist() == [len(t) for t in wanted]
    for k, name in enumerate(parser.names):
        assert found[k].tolist() == [L.phrase_count(t, L.automaton(reference[name])) for t in wanted]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reference, limits = L.learnt(L.labelled_sample(docs))
    found = {r["doc_id"]: r for r in L.identify(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(found)
    for doc_id, text in rows:
        letters = L.letters(text)
        bits = {n: greedy(letters, reference[n]) * np.log2(len(reference[n])) / max(1, len(letters)) for n in reference}
        best = min(sorted(bits), key=bits.get)
        assert found[doc_id]["language"] == (best if letters else None)
        assert not letters or abs(found[doc_id]["bits"] - bits[best]) < 1e-9
        assert found[doc_id]["keep"] == bool(letters and bits[best] <= limits[best] + L.PHRASES * np.log2(len(reference[best])) / len(letters) + 1e-12)


def test_held_out_accuracy_and_what_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    learnt_from = {r[0] for r in docs.where("doc_id % 2 = 0").select("doc_id").collect()}
    held_out = docs.where("doc_id % 2 = 1")
    find = L.scorer(L.references(L.labelled_sample(docs.where("doc_id % 2 = 0"))))
    seen = held_out.select("doc_id", "lang", "text", find(held_out["text"]).alias("f")).collect()
    judged = [(r["lang"], r["f"]["language"]) for r in seen if r["f"]["n_letters"] >= 40]
    assert learnt_from and sum(a == b for a, b in judged) >= 0.95 * len(judged)
    kept = [r["f"]["bits"] <= L.MOST_BITS for r in seen if r["f"]["n_letters"] >= 40]
    assert sum(kept) >= 0.97 * len(kept)


def test_noise_is_rejected(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("aeiou", k=2)) + "n" for _ in range(50)]
    rows = [(k, " ".join(rng.choices(words, k=300)), "x") for k in range(20)]
    noise = "".join(rng.choices("qwzxjkvbpfgh", k=600))
    docs = spark.createDataFrame([*rows, (99, noise, None)], "doc_id int, text string, lang string")
    found = {r["doc_id"]: r["keep"] for r in L.identify(docs).collect()}
    assert not found[99] and all(found[k] for k in range(20))


def test_a_rare_label_leaves_the_others_as_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    plain = L.references(sample := L.labelled_sample(docs))
    for stray in ("et les amis de la maison ici", "un deux trois quatre cinq six sept " * 60):
        found = L.references(sample | {"xx": [stray]})
        assert {n: found[n] for n in plain} == plain and ("xx" in found) == (len(stray) >= L.LEAST_LETTERS)
    rare = docs.union(spark.createDataFrame([(-1, "et les amis de la maison ici", "xx")], docs.schema))
    before, after = ({r["doc_id"]: tuple(r) for r in L.identify(d).collect()} for d in (docs, rare))
    after.pop(-1)
    assert after == before


def test_poor_labels_alone_are_learnt_at_one_length():
    found = L.references({"x": ["aba abba baab"], "y": ["cdc dccd dcddc cddc"]})
    assert sorted(found) == ["x", "y"] and abs(len(found["x"]) - len(found["y"])) <= 1


OTHERS = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!",
    "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät, hampahilleni hajoovat.",
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie: Ile cię trzeba cenić, ten tylko się dowie, Kto cię stracił. Dziś piękność twą w całej ozdobie Widzę i opisuję, bo tęsknię po tobie.",
]


def test_real_text_of_other_languages_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    short = ["qzvxkjwqpz", "Wszczebrzeszyn", "gjhrtkmvbn qwrtzp"]
    rows = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate([*OTHERS, *short])], docs.schema)
    seen = L.identify(docs.union(rows)).collect()
    assert not [r["doc_id"] for r in seen if r["doc_id"] < 0 and r["keep"]]
    judged = [r["keep"] for r in seen if r["doc_id"] >= 0 and r["n_letters"] > 0]
    assert sum(judged) >= 0.99 * len(judged)


def test_rows_that_are_much_alike_set_no_tight_limit():
    _, limits = L.learnt({"x": ["the same line of the same notice, with nothing new in it"] * 30})
    assert limits["x"] > 3
