from __future__ import annotations

import random
import re

import pytest

from tallyforge.llm import repetition as R

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def brute(text: str | None) -> list[float]:
    text = (text or "").lower()
    words = WORD.findall(text)
    total = sum(map(len, words))
    out = []
    for n in R.LIMITS:
        seen, marked = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k : k + n])
            if gram in seen:
                marked |= set(range(k, k + n))
            seen.add(gram)
        out.append(sum(len(words[k]) for k in marked) / total if total else 0.0)
    lines, seen = [x for x in text.split("\n") if x], set()
    again = [x for x in lines if x in seen or seen.add(x)]
    chars = sum(map(len, lines))
    return [*out, len(lines), len(again) / len(lines) if lines else 0.0, sum(map(len, again)) / chars if chars else 0.0]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r[0]: r for r in R.repetition(docs).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert list(found[i][1:-1]) == pytest.approx(brute(text)), text
        *_, n_lines, share, _ = wanted = brute(text)
        within = all(v <= m + 1e-12 for v, m in zip([*wanted[:-3], wanted[-1]], [*R.LIMITS.values(), R.LINE_CHARACTERS]))
        assert found[i]["keep"] == (within and (n_lines < R.LEAST_LINES or share <= R.LINES + 1e-12))


def test_against_brute_force_on_random_texts(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice(["a ", "b ", "é ", "c\n", "dd, "]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for k in range(120)]
    check(spark, [*rows, (1000, None), (1001, "\n\n"), (1002, "x\n" * 5000)])


def test_query_against_brute_force_on_documents(spark, sf_dir):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_repeating_goes_and_plain_text_stays(spark):
    rng = random.Random(8)
    plain = " ".join(str(rng.random()) for _ in range(400))
    some = plain.split()
    menu = "\n".join(f"{' '.join(some[k * 20 : k * 20 + 20])}\nShare" for k in range(12))
    rows = [(1, plain), (2, "buy this now and save a lot today " * 50), (3, "same line\n" * 40), (4, menu), (5, "\n".join(menu.split("\n")[:4]))]
    found = {r["doc_id"]: r["keep"] for r in R.repetition(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: True}
