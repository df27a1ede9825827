from __future__ import annotations

import random
import re

import pyarrow as pa

from tallyforge.llm import bagminhash as B
from tallyforge.llm import lzprint as Z
from tallyforge.llm import repetition as R
from tallyforge.llm.words import steps

CHINESE = "春天来了山上的花都开了河水慢慢地流过村子孩子们在树下唱歌老人坐在门口看着远处的云"
THAI = "ฤดูใบไม้ผลิมาถึงแล้วดอกไม้บนภูเขาก็บานเด็กๆร้องเพลงอยู่ใต้ต้นไม้"
FRENCH = "Le moulin tourne encore, dit-il ; la rivière monte : « demain, elle sera au pont » et personne ne dort dans la vallée cette nuit."


def words(texts: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in texts]
    for step in steps(pa.array(texts)):
        for doc, a, b in zip(step.doc, step.starts, step.ends):
            out[step.first + doc].append(step.data[a:b].tobytes().decode())
    return out


def overlap(a: str, b: str) -> float:
    (step,) = steps(pa.array([a, b]))
    doc, feature, times = B.bags(step)
    return B.overlap(*((feature[doc == i], times[doc == i]) for i in (0, 1)))


def test_words_of_many_scripts():
    assert words(["a—b\u00a0c…“d”", "été, Straße", "春天a来", "", "하늘 은", "a1😀😀x", "นก", "日。", "’x’"]) == [
        ["a", "b", "c", "d"], ["été", "straße"], ["春", "天", "a", "来"], [], ["하늘", "은"], ["a1", "😀", "😀", "x"], ["น", "ก"], ["日"], ["x"],
    ]


def test_words_against_a_pattern():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab1é春的😀ß \u00a0—“”,。\n", k=rng.choice([0, 1, 2, 7, 60]))) for _ in range(500)]
    assert words(texts) == [re.findall("[ab1éß]+|[春的😀]", t) for t in texts]


def test_near_copies_without_spaces_and_with_other_spaces_and_quotes():
    for text in (CHINESE, THAI):
        assert overlap(text, text[:20] + "x" + text[21:]) >= B.LEAST
    assert overlap(FRENCH, FRENCH.replace(" ", "\u00a0").replace("«", "“").replace("»", "”")) == 1


def test_repeats_and_phrases_without_spaces():
    (step,) = steps(pa.array([CHINESE * 3, CHINESE]))
    shares = R.measured(step)
    assert (shares[: len(R.LIMITS), 0] > 0.5).all() and (shares[: len(R.LIMITS), 1] == 0).all()
    assert len(Z.parsed(step)[0][1]) > 10
