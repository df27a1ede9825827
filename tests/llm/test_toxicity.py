from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import toxicity as T
from tallyforge.llm.queries import QUERIES

TOXIC = [
    "You are a worthless idiot.",
    "I will kill you tonight.",
    "Go kill yourself.",
    "They are all disgusting vermin.",
    "He is a complete moron and a loser.",
    "You should die.",
    "I'm going to stab him.",
    "People like you should be shot.",
    "They should all be hanged.",
    "I hope you get cancer and die.",
    "Kill all of them!",
    "I'll kill you",
    "Du bist ein Idiot.",
    "Ihr seid alle Abschaum.",
    "Ich bringe dich um.",
    "Ich werde dich töten",
    "Ich hoffe, du stirbst.",
    "Sie sollten erschossen werden.",
    "Tu es un imbécile.",
    "Je vais te tuer.",
    "J'espère que tu vas crever.",
    "Ils devraient être pendus.",
    "Eres un idiota.",
    "Te voy a matar",
    "Voy a matarte.",
    "Ojalá te mueras.",
    "Ellos deberían ser fusilados.",
]
CLEAN = [
    "You are not an idiot.",
    "He said that the plan was stupid.",
    '"You idiot," she said, and he laughed.',
    "The trash is collected on Mondays.",
    "I will never kill anyone.",
    "The article reported threats: he wrote I will kill you.",
    "Roll the die and hurt nobody.",
    "",
    "I am such an idiot.",
    "The process should be killed.",
    "They should never be killed.",
    "She was shot at the border in 1914 and he was beaten twice.",
    "Mosquitoes are a nuisance; kill them with soap.",
    "I hope you get well soon.",
    "Du bist kein Idiot, du bist kein Trottel.",
    "Ich bringe dich um acht Uhr nach Hause.",
    "Ich werde dich niemals töten.",
    "Er sagte: Du bist ein Idiot.",
    "Die Frau ist die Chefin, und die Kinder sind hier.",
    "Tu n'es pas un idiot.",
    "Je ne vais pas te tuer.",
    "Il a dit que tu es un imbécile.",
    "No eres un idiota.",
    "No voy a matarte.",
    "Dijo que eres un idiota.",
]


def one_after_the_other(text: str, lang: str | None = None, learnt: dict[str, str] | None = None) -> list[float]:
    """The five machines run in turn, without composing them."""
    parts = [T.negation(), T.reported(), T.targeted(), T.threats(), T.weights()]
    states, out = [0] * len(parts), []
    for symbol in T.symbols(text, lang, learnt):
        total = 0.0
        for k, part in enumerate(parts):
            symbol, weight, states[k] = part.step(states[k], symbol)
            total += weight
        if symbol == "clause":
            out.append(total)
    return out


def taught(rows: list[tuple[str | None, bool, str]]) -> dict:
    """learnt() by its definition: rows are (lang, toxic, text)."""
    out: dict = {}
    for lang in {r[0] for r in rows}:
        texts = {kind: [t for g, x, t in rows if (g, x) == (lang, kind)] for kind in (True, False)}
        often, contexts = {kind: defaultdict(int) for kind in (True, False)}, defaultdict(set)
        for kind, some in texts.items():
            for text in some:
                words = ["", *(t.replace("’", "'") for t in T._TOKEN.findall(text.lower()) if t[0].isalpha()), ""]
                for word in set(words[1:-1]):
                    often[kind][word] += 1
                for k in range(1, len(words) - 1):
                    if kind:
                        contexts[words[k]].add(sum(map(ord, words[k - 1] + " " + words[k + 1])) % 63)
        some = {w: n for w, n in often[True].items() if n > 2}
        chance = (len(texts[True]) + 1) / (len(texts[True]) + len(texts[False]) + 2)
        for word, n in some.items():
            different = math.inf if len(contexts[word]) == 63 else -63 * math.log(1 - len(contexts[word]) / 63)
            share = (n + 1) / (n + often[False][word] + 2)
            if share >= T.SHARE and min(n, different) * -math.log(chance) >= math.log(len(some) / T.CHANCE):
                out.setdefault(lang, {})[word] = "strong" if share >= T.STRONG else "weak"
    return out


@pytest.mark.parametrize("text", TOXIC)
def test_toxic(text):
    assert sum(T.clause_scores(text, T.grammar())) >= T.LEAST


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert sum(T.clause_scores(text, T.grammar())) < T.LEAST


def test_query_equals_brute_force_on_all_documents(spark, sf_dir):
    sf_dir = f"{sf_dir}/../sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()}
    texts = docs.select("doc_id", "text", "lang").collect()
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    learnt = taught([(lang, labels[i] == 1, text) for i, text, lang in texts if i in labels])
    assert learnt and learnt == T.learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    everything = {w: c for words in learnt.values() for w, c in words.items()}
    assert len(found) == len(texts)
    for doc_id, text, lang in texts:
        clauses = one_after_the_other(text, lang, learnt.get(lang) or everything)
        assert (found[doc_id]["score"], found[doc_id]["clauses"]) == (sum(clauses), len(clauses))
        assert found[doc_id]["toxic"] == (sum(clauses) >= T.LEAST)


def test_held_out_documents_of_all_languages(spark, sf_dir):
    """Labels of one half of the documents teach the words for the other half."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    scored = docs.select("doc_id", "lang", T.scores(F.col("text"), F.col("lang"), T.learnt(docs, labels.where(half == 0)))["score"].alias("score"))
    seen = scored.join(labels.where(half == 1), "doc_id").collect()
    toxic, clean = ([r["score"] >= T.LEAST for r in seen if r["toxic"] == k] for k in (1, 0))
    assert len(clean) > 1000 and sum(clean) <= 0.005 * len(clean)
    assert sum(toxic) >= 0.8 * len(toxic)
    for lang in ("de", "fr"):  # the Spanish half has 13 toxic documents, too few to teach many words
        found = [r["score"] >= T.LEAST for r in seen if r["toxic"] == 1 and r["lang"] == lang]
        assert len(found) > 20 and sum(found) >= 0.8 * len(found)


def test_what_labels_teach(spark):
    name = ["".join(chr(97 + k // d % 26) for d in (1, 26)) for k in range(2000)]
    rows = [(k, "en", f"{name[k]}w bad {name[k * 7]}x plain {name[k]}y" if k % 4 == 0 else f"{name[k]}w plain {name[k]}z") for k in range(200)]
    rows += [(k, "en", "a copy of one text says odd things") for k in range(200, 220)]
    docs = spark.createDataFrame([*rows, (None, "en", "bad"), (900, "en", None)], "doc_id int, lang string, text string")
    labels = [(k, int(k % 4 == 0 and k < 200 or k >= 200)) for k in range(220)] + [(None, 1), (5, None), (900, 1), (901, 1)]
    schema = "doc_id int, toxic int"
    assert T.learnt(docs, spark.createDataFrame(labels, schema)) == {"en": {"bad": "strong"}}
    both = [(k, 1 - t) for k, t in labels[:220]]
    assert T.learnt(docs, spark.createDataFrame(labels + both, schema)) == {}
    assert T.learnt(docs.drop("lang"), spark.createDataFrame(labels, schema)) == {None: {"bad": "strong"}}
    assert T.learnt(docs, spark.createDataFrame([], schema)) == {}
    other = spark.createDataFrame([(1, "xx", "BAD, bad!"), (2, None, "bad and bad"), (3, "en", "not bad, not bad")], "doc_id int, lang string, text string")
    assert {r["doc_id"]: r["toxic"] for r in T.toxicity(other.unionByName(docs.limit(0)), None).collect()} == {1: False, 2: False, 3: False}
    found = other.select("doc_id", T.scores(F.col("text"), F.col("lang"), {"en": {"bad": "strong"}})["score"]).collect()
    assert dict(found) == {1: 2.0, 2: 2.0, 3: 0.0}


AFTER_A_QUOTATION = [
    'He wrote "All is fine." You are an idiot.',
    'She said "Go home." I will kill you.',
    "He wrote “All is fine.” You are an idiot.",
    "Er schrieb „Alles gut.“ You are an idiot.",
    "Elle a dit « Tout va bien. » You are an idiot.",
    "Sie rief »Halt!« You are an idiot.",
    'A 5" screen. You are an idiot.',
    'A stray "mark, and no other.\nYou are an idiot.',
    'A stray "mark\n\nYou are an idiot.',
]
WITHIN_A_QUOTATION = [
    '"Stop it. You are an idiot," she said.',
    '"Stop it! You are an idiot."',
    "“Stop it. You are an idiot,” she said.",
    "„Halt. You are an idiot“, sagte sie.",
    "« Halte. You are an idiot », dit-elle.",
    'He said "fine", you are an idiot.',
    '"Stop it, I have\nhad enough. You are an idiot," she said.',
]


@pytest.mark.parametrize("text", AFTER_A_QUOTATION)
def test_the_authors_words_after_a_quotation(text):
    assert sum(T.clause_scores(text, T.grammar())) >= T.LEAST


@pytest.mark.parametrize("text", WITHIN_A_QUOTATION)
def test_another_ones_words_in_a_quotation(text):
    assert sum(T.clause_scores(text, T.grammar())) < T.LEAST
