"""Text models as injected adapters: prompts before, parsing after, and the call itself in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parsing import coerced_json, error_record, judgments, lists_in


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]:
        """An answer for each prompt."""


class VectorModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""


class Echo:
    """The model of tests: answers each prompt with what a function makes of it."""

    def __init__(self, answer: Callable[[str], str] = lambda prompt: prompt):
        self.answer = answer

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


class Hashed:
    """The vector model of tests: signed counts of hashed words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for text in texts:
            vector = [0.0] * self.size
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(vector)
        return out


def retried(call: Callable[[], list], tries: int = 3, first_delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """call(), up to tries times, with a delay that doubles; after the last failure a RuntimeError."""
    for i in range(tries):
        try:
            return call()
        except Exception as e:
            if i + 1 == tries:
                raise RuntimeError(f"no answer after {tries} tries: {e}") from e
            sleep(first_delay * 2**i)
    return []


def completed(df: DataFrame, model: Callable[[], TextModel], prompt: str = "prompt", batch: int = 64, tries: int = 3, first_delay: float = 2.0) -> DataFrame:
    """df with answer and status: ok, or the fault of the batch, then of the row when it was tried alone. model() is called once a task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for part in batches:
            answers: list[str | None] = []
            status: list[str] = []
            prompts = part[prompt].tolist()
            for k in range(0, len(prompts), batch):
                some = prompts[k : k + batch]
                try:
                    answers += retried(lambda some=some: client.complete(some), tries, first_delay)
                    status += ["ok"] * len(some)
                except RuntimeError:
                    for one in some:
                        try:
                            answers += retried(lambda one=one: client.complete([one]), tries, first_delay)
                            status.append("ok")
                        except RuntimeError as e:
                            answers.append(None)
                            status.append(str(e))
            yield part.assign(answer=pd.Series(answers, dtype=object, index=part.index), status=status)

    return df.mapInPandas(run, f"{schema}, answer string, status string")


def embedded(df: DataFrame, model: Callable[[], VectorModel], text: str = "text", batch: int = 64, first_delay: float = 1.5) -> DataFrame:
    """df with embedding and text_length of the text with line ends as blanks; a batch that fails is tried row by row, and a row that fails has a null embedding.

    A null text has no vector and no length.
    """
    flat = df.withColumn("__text", F.replace(F.col(text), F.lit("\n"), F.lit(" ")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for part in batches:
            out: list[list[float] | None] = []
            given = [None if pd.isna(t) else t for t in part.pop("__text")]
            there = [t for t in given if t is not None]
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                try:
                    out += retried(lambda some=some: client.embed(some), 3, first_delay)
                except RuntimeError:
                    for one in some:
                        try:
                            out += retried(lambda one=one: client.embed([one]), 3, first_delay)
                        except RuntimeError:
                            out.append(None)
            found = iter(out)
            out = [None if t is None else next(found) for t in given]
            yield part.assign(embedding=pd.Series(out, dtype=object, index=part.index), text_length=pd.Series([None if t is None else len(t) for t in given], dtype="Int64", index=part.index))

    return flat.mapInPandas(run, f"{schema}, embedding array<float>, text_length long")


def expanded_lists(df: DataFrame, model: Callable[[], TextModel], most: int | None = None) -> DataFrame:
    """df's rows with (position, item) for each item of the list in the answer to prompt: fields to subfields, subfields to tasks."""
    answered = completed(df, model)
    rows = lists_in(answered.drop("prompt", "status"), "answer")
    return rows if most is None else rows.where(F.col("position") <= most)


def objects(df: DataFrame, model: Callable[[], TextModel]) -> DataFrame:
    """df with record: the JSON object in the answer, or the record that keeps an answer without one."""
    return completed(df, model).withColumn("record", error_record(F.col("answer"))).withColumn("parsed", coerced_json(F.col("answer")).isNotNull())


def judged(df: DataFrame, model: Callable[[], TextModel]) -> DataFrame:
    """df with judgment, confidence and reasoning of the answer."""
    return completed(df, model).withColumn("__j", judgments(F.col("answer"))).select("*", "__j.*").drop("__j")


def simulated(calls: DataFrame, model: Callable[[], TextModel]) -> DataFrame:
    """calls (checked: status, code, message, and prompt) with response: of a failed check its own message, else the model's answer. A null status is no pass."""
    passed = completed(calls.where("status = 'PASS'").withColumnRenamed("status", "checked"), model).withColumn("response", F.concat(F.lit("Status Code: 200\nResponse: "), F.coalesce("answer", F.lit("")))).drop("answer", "status").withColumnRenamed("checked", "status")
    failed = calls.where("status is null or status <> 'PASS'").withColumn("response", F.format_string('Status Code: %d\nResponse: {"error": "%s"}', F.coalesce("code", F.lit(400)), F.coalesce("message", F.lit("The call was not checked."))))
    return passed.unionByName(failed)
