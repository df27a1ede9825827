"""Quality rule: how much of a text repeats what it has already said."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Step, grams, steps

#: n-gram lengths in words, and the largest share of characters that may lie in duplicated n-grams.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of the lines that may repeat an earlier one, from LEAST_LINES lines on (in a text of three lines one short line
#: would be a third), and of the lines' characters, in any text.
LINES, LEAST_LINES, LINE_CHARACTERS = 0.30, 10, 0.20
_MEASURES = [*(f"dup_{n}gram" for n in LIMITS), "n_lines", "dup_lines", "dup_line_chars"]


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(keys.size, bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def _any(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    often = np.zeros(keys.size, bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    return often


def _shares(part: np.ndarray, of: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    whole = np.bincount(doc, of, n)
    return np.divide(np.bincount(doc, part, n), whole, out=np.zeros(n), where=whole > 0)


def measured(step: Step) -> np.ndarray:
    """A row of _MEASURES for each text of the step."""
    salt = step.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words, letters = step.hashes(step.starts, step.ends), step.letters()
    out = np.zeros((len(_MEASURES), step.n))
    open_ = np.ones(words.size, bool)  # where an n-gram may start that occurs more than once
    for k, n in enumerate(LIMITS):
        keys, at = grams(words, step.doc, n)
        some = open_[at]
        keys, at = keys[some] ^ salt[at[some]], at[some]
        if not at.size:
            break
        again = at[_later(keys)]
        cover = np.zeros(words.size + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + n, -1)
        out[k] = _shares((np.cumsum(cover[:-1]) > 0) * letters, letters, step.doc, step.n)
        open_ = np.zeros(words.size, bool)
        open_[at[_any(keys)]] = True
    breaks = np.flatnonzero(step.data == 10)
    starts = np.union1d(step.edges[:-1], breaks + 1)
    starts = starts[starts < step.data.size]
    ends = np.append(starts[1:], step.data.size) if starts.size else starts
    if starts.size:
        ends = np.where(step.data[ends - 1] == 10, ends - 1, ends)
    starts, ends = starts[ends > starts], ends[ends > starts]
    if starts.size:
        doc = np.searchsorted(step.edges, starts, "right") - 1
        seen = np.concatenate([[0], np.cumsum((step.data & 0xC0) != 0x80)])
        again = _later(step.hashes(starts, ends) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out[-3] = np.bincount(doc, minlength=step.n)
        out[-2] = _shares(again, np.ones(starts.size), doc, step.n)
        size = seen[ends] - seen[starts]
        out[-1] = _shares(again * size, size, doc, step.n)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measured(s) for s in steps(batch.column("text"))]
        found = np.concatenate(found, axis=1) if found else np.zeros((len(_MEASURES), 0))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64) if m == "n_lines" else x) for m, x in zip(_MEASURES, found))], ["doc_id", *_MEASURES])


def kept(limits: dict[int, float] | None = None, lines: float = LINES, line_chars: float = LINE_CHARACTERS) -> Column:
    """Whether no share is over its limit."""
    ok = ((F.col("n_lines") < LEAST_LINES) | (F.col("dup_lines") <= lines)) & (F.col("dup_line_chars") <= line_chars)
    for n, most in (LIMITS if limits is None else limits).items():
        ok = ok & (F.col(f"dup_{n}gram") <= most)
    return ok


def repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, dup_5gram .. dup_10gram, n_lines, dup_lines, dup_line_chars, keep): one row for each row of docs.

    dup_<n>gram: the share of the characters of all words that lie in an n-gram of words that occurred
    before in the text; overlapping ones count once. n_lines: lines that are not empty; dup_lines: the share of them that equal an
    earlier one; dup_line_chars: that share in characters. keep: the shares of characters are
    within LIMITS and LINE_CHARACTERS, and that of lines within LINES if there are LEAST_LINES. Upper and lower case are alike.

    Null, empty and one-word texts repeat nothing: all shares are 0 and they are kept. Rows of equal
    doc_id get a row each. No documents: no rows. Other columns are not looked at.
    """
    schema = "doc_id long, " + ", ".join(f"{m} {'long' if m == 'n_lines' else 'double'}" for m in _MEASURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, schema).withColumn("keep", kept())
