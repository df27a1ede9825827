"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import seeded_key

#: The sample of labelled rows per language: so many rows at most, of which so many letters are used.
SAMPLE_ROWS, SAMPLE_LETTERS, SEED = 64, 40_000, 53
#: A language whose sample has fewer letters is learnt only if all have fewer: any text is single letters of so short a reference.
LEAST_LETTERS = 1000
#: A text is rejected if its best language needs more bits than its letters times that language's limit, and PHRASES phrases (the parse
#: begins and ends within words, which counts in a short text). No limit is over MOST_BITS a letter: with references of SAMPLE_LETTERS phrases are then single letters and pairs.
MOST_BITS, PHRASES = 9.0, 2
#: The limit of a language, at most MOST_BITS: so many times the bits a letter, without those of PHRASES, that the share QUANTILE of its held-out rows needs.
QUANTILE, MARGIN = 0.98, 1.75

_OTHER = re.compile(r"[\W\d_]+")
Automaton = dict  # character -> Automaton


def letters(text: str | None) -> str:
    """text in lower case, each run of anything but letters as one blank."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def automaton(text: str) -> Automaton:
    """The start of the suffix automaton of text: its paths spell exactly the substrings."""
    next_: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new, at = len(next_), last
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and ch not in next_[at]:
            next_[at][ch] = new
            at = link[at]
        if at >= 0:
            to = next_[at][ch]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(next_)
                next_.append(dict(next_[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and next_[at].get(ch) == to:
                    next_[at][ch] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    nodes: list[Automaton] = [{} for _ in next_]
    for node, arcs in zip(nodes, next_):
        for ch, to in arcs.items():
            node[ch] = nodes[to]
    return nodes[0]


def phrase_count(text: str, start: Automaton) -> int:
    """Phrases of the greedy parse of text into longest substrings of the automaton's text; an unknown letter is one."""
    count, node, first = 0, start, start.get
    for ch in text:
        to = node.get(ch)
        if to is None:
            count += node is not start
            to = first(ch)
            if to is None:
                count += 1
                to = start
        node = to
    return count + (node is not start)


class Parser:
    """Phrase counts of many texts against several references at once.

    The automata are one table, (state, letter) -> (next state, phrases begun), and a step of numpy moves all
    texts and languages by a letter; the few longest texts are finished one by one. With alphabets for
    which the table would have over TABLE cells, all texts are parsed one by one. Texts are taken in parts of
    STEP letters (a longer text is a part of its own), so that memory doesn't grow with their number.
    """

    TABLE, FEW, STEP = 1 << 26, 48, 1 << 22

    def __init__(self, reference: dict[str, str]):
        self.names = sorted(reference)
        self.starts = [automaton(reference[n]) for n in self.names]
        self.bits = np.array([math.log2(max(2, len(reference[n]))) for n in self.names])
        alphabet = sorted({" ", *(ch for text in reference.values() for ch in text)})
        orders, cells = [], 0
        for start in self.starts:
            order, todo = {id(start): 0}, [start]
            for node in todo:
                for to in node.values():
                    if id(to) not in order:
                        order[id(to)] = len(todo)
                        todo.append(to)
            orders.append((order, todo))
            cells += len(todo) * (len(alphabet) + 1)
        self.table = None
        if cells > self.TABLE or not self.names:
            return
        width = len(alphabet) + 1  # the last column: letters that no reference has
        self.code = _letter_classes().copy()
        self.code[self.code > 1] = width - 1
        for k, ch in enumerate(alphabet):
            self.code[ord(ch)] = k
        column = {ch: k for k, ch in enumerate(alphabet)}
        self.starts = []
        self.table, self.base, base = np.zeros(cells, np.int32), [], 0
        for order, todo in orders:
            root = np.full(width, base, np.int32)
            for ch, to in todo[0].items():
                root[column[ch]] = base + order[id(to)] * width
            begun = np.where(root == base, 2, 1)
            part = np.tile(root * 4 + begun, (len(todo), 1))
            part[0] -= 1
            for row, node in enumerate(todo):
                for ch, to in node.items():
                    part[row, column[ch]] = (base + order[id(to)] * width) * 4
            self.table[base : base + part.size] = part.ravel()
            self.base.append(base)
            base += part.size

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and phrases by language and text."""
        parts, first, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > self.STEP and k > first:
                parts.append(self._counts(texts[first:k]))
                first, size = k, len(text or "")
        parts.append(self._counts(texts[first:]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)

    def _counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            found = [letters(t) for t in texts]
            return np.array([len(t) for t in found], np.int64), np.array([[phrase_count(t, s) for t in found] for s in self.starts], np.int64).reshape(len(self.starts), len(texts))
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
        blank = _letter_classes()[points] < 2
        lead = np.ones(points.size, bool)
        lead[1:] = blank[:-1]
        lead[edges[:-1][edges[:-1] < points.size]] = True
        stays = ~(blank & lead)
        codes = self.code[points[stays]]
        kept = np.concatenate([[0], np.cumsum(stays)])[edges]
        first, size = kept[:-1], np.diff(kept)
        some = size > 0
        ends_blank = np.zeros(len(texts), bool)
        ends_blank[some] = codes[kept[1:][some] - 1] == self.code[32]
        size = size - ends_blank
        order = np.argsort(-size, kind="stable")
        at, left = first[order].copy(), size[order]
        state = np.repeat(np.array(self.base, np.int32)[:, None] * np.int32(4), len(texts), axis=1)
        total = np.zeros(state.shape, np.int64)
        step = 0
        while True:
            live = int(np.searchsorted(-left, -step, "left"))  # texts longer than step
            if live <= self.FEW:
                break
            until = int(left[live - 1])
            moved, sums, here = state[:, :live].copy(), total[:, :live].copy(), at[:live] + step
            for _ in range(until - step):
                moved = self.table[(moved >> 2) + codes[here]]
                sums += moved & 3
                here += 1
            state[:, :live], total[:, :live], step = moved, sums, until
        flat = self.table
        for k in range(live):
            rest = codes[at[k] + step : at[k] + left[k]].tolist()
            for lang in range(len(self.base)):
                now, begun = int(state[lang, k]), 0
                for c in rest:
                    now = flat.item((now >> 2) + c)
                    begun += now & 3
                state[lang, k] = now
                total[lang, k] += begun
        total += (state >> 2) != np.array(self.base, np.int64)[:, None]
        found = np.zeros_like(total)
        found[:, order] = total
        return size, found


@lru_cache(maxsize=1)
def _parser(reference: tuple[tuple[str, str], ...]) -> Parser:
    """The parser that all tasks of a Python worker share."""
    return Parser(dict(reference))


_classes: list[np.ndarray] = []


def _letter_classes() -> np.ndarray:
    """By code point: 2 for a letter, else 0."""
    if not _classes:
        all_ = "".join(map(chr, range(0x110000)))
        found = np.full(0x110000, 2, np.uint16)
        for m in _OTHER.finditer(all_):
            found[m.start() : m.end()] = 0
        _classes.append(found)
    return _classes[0]


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED) -> dict[str, list[str]]:
    """The letters of up to rows seeded rows per language, on the driver. Rows without a language or letters don't count;
    of rows of equal lang and doc_id the lowest text does."""
    key = seeded_key(seed, F.col("doc_id"))
    narrow = docs.where("lang is not null and doc_id is not null and text is not null").select("lang", "doc_id", key.alias("__key"))
    # the limit per language applies before the shuffle
    drawn = narrow.withColumn("__row", F.row_number().over(Window.partitionBy("lang").orderBy("__key", "doc_id"))).where(F.col("__row") <= rows)
    pairs = {(r["lang"], r["doc_id"]) for r in drawn.select("lang", "doc_id").collect()}
    texts: dict[str, list[tuple[str, str]]] = {}
    found_rows = docs.where(F.col("doc_id").isin(sorted({i for _, i in pairs}))).where("lang is not null").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    for lang, doc_id, text, key_ in found_rows.select("lang", "doc_id", "text", key).collect() if pairs else ():
        if (lang, doc_id) in pairs and (found := letters(text)):
            texts.setdefault(lang, []).append((key_, found))
    return {lang: [t for _, t in sorted(some)] for lang, some in texts.items()}


def references(sample: dict[str, list[str]], most: int = SAMPLE_LETTERS) -> dict[str, str]:
    """The reference texts of learnt()."""
    return learnt(sample, most)[0]


def learnt(sample: dict[str, list[str]], most: int = SAMPLE_LETTERS) -> tuple[dict[str, str], dict[str, float]]:
    """References and limits.

    A reference text per language, as long as its own sample allows, up to most letters.

    A language of under LEAST_LETTERS letters is left out, so that a rare or stray label changes nothing for the
    others; with only such languages all are learnt, at one length, as their scores compare only so. A first round of references
    parses the sample; a row that another language parses with fewer bits is left out of the second round, as
    its label may be wrong, unless nothing would be left of the language.

    The limit of a language, in bits a letter: MARGIN times what the share QUANTILE of its rows needs that the first
    round parsed by a reference without them, but no less than the entropy of its single letters, which a sample of rows
    that are much alike would fall below, and no more than MOST_BITS. A language without such rows has the largest of the others' limits.
    """
    letters_of = {lang: sum(len(t) + 1 for t in some) for lang, some in sample.items()}
    enough = {lang for lang, n in letters_of.items() if n >= LEAST_LETTERS}
    if enough:
        sample = {lang: some for lang, some in sample.items() if lang in enough}

    def joined(of: dict[str, list[str]]) -> dict[str, str]:
        sizes = {lang: min(most, sum(len(t) + 1 for t in some)) for lang, some in of.items()}
        if not enough:
            sizes = dict.fromkeys(sizes, min(sizes.values()))
        # a slice of each row, so that one long row can't be the whole reference
        out = {}
        for lang, some in of.items():
            size = sizes[lang]
            share = max(1, size // len(some))
            while sum(min(len(t), share) + 1 for t in some) < size:
                share *= 2
            out[lang] = " ".join(t[:share] for t in some)[:size]
        return out

    if not sample:
        return {}, {}
    held_out: dict[str, list[float]] = {lang: [] for lang in sample}
    halves = [{lang: some[k::2] or some for lang, some in sample.items()} for k in (0, 1)]
    kept: dict[str, list[str]] = {lang: [] for lang in sample}
    for k in (0, 1):
        starts = {lang: (automaton(t), math.log2(max(2, len(t)))) for lang, t in joined(halves[1 - k]).items()}
        for lang, some in halves[k].items():
            for t in some:
                bits = {x: phrase_count(t, start) * size / len(t) for x, (start, size) in starts.items()}
                if min(starts, key=lambda x: (bits[x], x != lang)) == lang:
                    kept[lang].append(t)
                    if len(sample[lang]) > 1:
                        held_out[lang].append(bits[lang] - PHRASES * starts[lang][1] / len(t))
    found = joined({lang: sorted(set(kept[lang])) or some for lang, some in sample.items()})
    limits = {lang: min(MOST_BITS, max(_letter_bits(found[lang]), MARGIN * float(np.quantile(bits, QUANTILE)))) for lang, bits in held_out.items() if bits}
    return found, {lang: limits.get(lang, max(limits.values(), default=MOST_BITS)) for lang in found}


def _letter_bits(text: str) -> float:
    """Entropy of the single letters of text."""
    share = np.unique(list(text), return_counts=True)[1] / len(text)
    return float(-(share * np.log2(share)).sum())


def scorer(reference: dict[str, str]):
    """A pandas function of texts, giving for each its letters, language, bits a letter and those of the second best."""
    names = sorted(reference)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(tuple(sorted(reference.items())))
        for texts in batches:
            size, found = parser.counts(texts.tolist())
            out = pd.DataFrame({"n_letters": size, "language": pd.Series([None] * len(size), dtype=object), "bits": np.nan, "next_bits": np.nan})
            if names and len(size):
                bits = found * parser.bits[:, None] / np.maximum(size, 1)
                order = np.argsort(bits, axis=0, kind="stable")
                known = size > 0
                out["language"] = np.where(known, np.array(names, object)[order[0]], None)
                ranked = np.take_along_axis(bits, order, 0)
                out["bits"] = np.where(known, ranked[0], np.nan)
                if len(names) > 1:
                    out["next_bits"] = np.where(known, ranked[1], np.nan)
            yield out

    return F.pandas_udf(run, "n_letters long, language string, bits double, next_bits double")


def most_bits(n_letters, language: str, reference: dict[str, str], limits: dict[str, float]):
    """Bits a letter that a text of n_letters (a number or a column) in a language may need."""
    return limits[language] + PHRASES * math.log2(max(2, len(reference[language]))) / n_letters


def _kept(found: Column, reference: dict[str, str], limits: dict[str, float]) -> Column:
    ok = found["language"].isNull()
    for lang in limits:
        ok = ok | ((found["language"] == lang) & (found["bits"] <= most_bits(found["n_letters"], lang, reference, limits)))
    return (found["n_letters"] > 0) & ok


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, n_letters, language, bits, next_bits, keep): one row for each row of docs.

    The suffix automaton of a reference text per language parses each whole text greedily into longest
    matches; phrases * log2(reference length) / letters is an estimate of the cross entropy in bits a
    letter. The language that needs fewest bits wins, the first by name on a tie. The references come from
    a sample of rows with a lang, bounded by SAMPLE_ROWS and SAMPLE_LETTERS; a lang with under LEAST_LETTERS letters there
    is not known, if another has more. keep is false for a text without letters,
    and for one whose language needs more than most_bits(), whose limit comes from held-out rows of the sample (learnt()).

    Null, empty and letterless texts have no language and are not kept. Rows with a null lang or doc_id are identified
    but not learnt from; with no labelled row no language is known, and texts with letters are kept. Rows of
    equal doc_id get a row each. No documents: no rows. Other columns are not looked at.
    """
    reference, limits = learnt(labelled_sample(docs))
    found = scorer(reference)(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("__f")).select("doc_id", "__f.*", _kept(F.col("__f"), reference, limits).alias("keep"))


def of_known_language(docs: DataFrame) -> DataFrame:
    """docs that identify() keeps, with all columns."""
    reference, limits = learnt(labelled_sample(docs))
    find = scorer(reference)
    return docs.where(_kept(find(F.col("text")), reference, limits))
