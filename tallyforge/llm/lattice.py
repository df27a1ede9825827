"""Marginal document probability over all segmentations into subwords."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Expected count that is added to each piece's.
SMOOTHING = 0.1
#: Words whose probabilities a task keeps at once; what is dropped is computed again.
REMEMBERED = 300_000
#: Words that are computed together, and letters of text whose words are looked up together.
TOGETHER, LETTERS = 50_000, 1 << 20

_SPACE = "▁"


def vocabulary(model_file: str = MODEL) -> dict[str, float]:
    """Log probability of each piece that the vocabulary's own scores give.

    The scores rank the pieces; a piece's probability is taken as inverse to its place (Zipf's law), that of byte pieces, which
    have no score, as that of the last place.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
    scored = sorted((i for i in ids if not model.is_byte(i)), key=lambda i: -model.get_score(i))
    weight = {model.id_to_piece(i): 1 / (k + 1) for k, i in enumerate(scored)}
    weight |= {model.id_to_piece(i): 1 / len(ids) for i in ids if model.is_byte(i)}
    total = sum(weight.values())
    return {p: math.log(w / total) for p, w in weight.items()}


class Lattice:
    """All segmentations of a word into pieces; a character that is no piece is spelt in byte pieces."""

    def __init__(self, log_p: dict[str, float]):
        #: every prefix of a piece; None where it is no piece itself
        self.paths: dict[str, float | None] = {}
        for piece, value in log_p.items():
            if not self.is_byte(piece):
                for k in range(1, len(piece)):
                    self.paths.setdefault(piece[:k], None)
                self.paths[piece] = value
        self.bytes = [log_p.get(f"<0x{b:02X}>", -math.inf) for b in range(256)]

    @staticmethod
    def is_byte(piece: str) -> bool:
        return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")

    def arcs(self, word: str) -> Iterator[tuple[int, int, float]]:
        """(from, to, log probability), by from."""
        paths, n = self.paths, len(word)
        for i in range(n):
            alone = False
            for j in range(i + 1, n + 1):
                try:
                    value = paths[word[i:j]]
                except KeyError:
                    break
                if value is not None:
                    alone |= j == i + 1
                    yield i, j, value
            if not alone:
                yield i, i + 1, sum(self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass"))

    @staticmethod
    def _added(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        most = max(terms)
        return most + math.log(sum(math.exp(t - most) for t in terms)) if most > -math.inf else most

    def forward(self, word: str, arcs: list | None = None) -> list[float]:
        """Log of the summed probability of all ways to each place in the word."""
        into: list[list[float]] = [[] for _ in range(len(word) + 1)]
        into[0] = [0.0]
        alpha = [0.0] * (len(word) + 1)
        done = -1
        for i, j, value in self.arcs(word) if arcs is None else arcs:
            if i != done:
                alpha[i], done = self._added(into[i]), i
            into[j].append(alpha[i] + value)
        alpha[-1] = self._added(into[-1])
        return alpha

    def expected(self, word: str, times: float, counts: dict[str, float]) -> None:
        """Adds times the expected number of uses of each piece over all segmentations."""
        arcs = list(self.arcs(word))
        alpha = self.forward(word, arcs)
        if alpha[-1] == -math.inf:
            return
        out: list[list[float]] = [[] for _ in range(len(word) + 1)]
        out[-1] = [0.0]
        beta: list[float | None] = [None] * (len(word) + 1)
        for i, j, value in reversed(arcs):
            if beta[j] is None:
                beta[j] = self._added(out[j])
            out[i].append(beta[j] + value)
            share = times * math.exp(alpha[i] + value + beta[j] - alpha[-1])
            if self.paths.get(word[i:j]) is not None:
                counts[word[i:j]] += share
            else:
                for b in word[i:j].encode("utf-8", "surrogatepass"):
                    counts[f"<0x{b:02X}>"] += share


class Table:
    """The same lattice for many words at once, as numpy arrays: words of one length move together.

    A row of the table is a prefix of a piece, a column one of the CODES - 1 letters that begin most ways on; words with another
    letter are left to Lattice.
    """

    CODES, CELLS = 256, 1 << 19

    def __init__(self, log_p: dict[str, float]):
        self.lattice = Lattice(log_p)
        paths = self.lattice.paths
        self.number = {p: k for k, p in enumerate(paths, 2)}  # 0: no piece begins so; 1: nothing read yet
        often = Counter(p[-1] for p in paths)
        letters = sorted(often, key=lambda c: (c != _SPACE, -often[c], c))[: self.CODES - 1]
        self.code = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(letters, 1):
            self.code[ord(c)] = k
        self.letters = ["", *letters]
        self.next = np.zeros((len(paths) + 2, self.CODES), np.int32)
        self.value = np.full(len(paths) + 2, -math.inf)
        for p, k in self.number.items():
            self.next[self.number[p[:-1]] if len(p) > 1 else 1, self.code[ord(p[-1])]] = k
            if paths[p] is not None:
                self.value[k] = paths[p]
        self.next[:, 0] = 0
        spelt = lambda c: sum(self.lattice.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
        #: of each letter alone: as a piece, else in bytes
        self.alone = np.array([-math.inf, *(spelt(c) if paths.get(c) is None else paths[c] for c in letters)])
        self.in_bytes = np.array([False, *(paths.get(c) is None for c in letters)])

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(places in words, letters as codes by place in the word and word), the codes None for words that Lattice must do."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        codes = self.code[points]
        rare = np.zeros(len(words), bool)
        rare[np.searchsorted(first, np.flatnonzero(codes == 0), "right") - 1] = True
        if rare.any():
            yield np.flatnonzero(rare), None
        plain = np.flatnonzero(~rare)
        plain = plain[np.argsort(size[plain], kind="stable")]
        cuts = np.flatnonzero(np.diff(size[plain])) + 1
        for part in np.split(plain, cuts) if plain.size else ():
            n = int(size[part[0]])
            step = max(1, self.CELLS // (n + 1))
            for k in range(0, part.size, step):
                some = part[k : k + step]
                out = np.empty((n + 1, some.size), np.uint8)
                out[0] = self.code[ord(_SPACE)]
                out[1:] = codes[first[some] + np.arange(n)[:, None]]
                yield some, out

    def arcs(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray, np.ndarray]]:
        """(to, words, rows of the table, log probabilities) of the pieces that start at place i."""
        state = self.next[1, codes[i]]
        yield i + 1, slice(None), state, self.alone[codes[i]]
        live = np.flatnonzero(state)
        state = state[live]
        for j in range(i + 1, len(codes)):
            state = self.next[state, codes[j, live]]
            on = state > 0
            live, state = live[on], state[on]
            if not live.size:
                return
            value = self.value[state]
            piece = value > -math.inf
            if piece.any():
                yield j + 1, live[piece], state[piece], value[piece]

    def forward(self, codes: np.ndarray) -> np.ndarray:
        alpha = np.full((len(codes) + 1, codes.shape[1]), -math.inf)
        alpha[0] = 0.0
        for i in range(len(codes)):
            for j, at, _, value in self.arcs(codes, i):
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + value)
        return alpha

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Of each word, with a word mark before it."""
        out = np.zeros(len(words))
        for at, codes in self.groups(words):
            out[at] = [self.lattice.forward(_SPACE + words[k])[-1] for k in at] if codes is None else self.forward(codes)[-1]
        return out

    def expected(self, words: list[str], times: np.ndarray, counts: dict[str, float]) -> None:
        """Adds the expected number of uses of each piece in all the words, each so many times."""
        uses, spelt = np.zeros(len(self.value)), np.zeros(self.CODES)
        for at, codes in self.groups(words):
            if codes is None:
                for k in at:
                    self.lattice.expected(_SPACE + words[k], int(times[k]), counts)
                continue
            alpha = self.forward(codes)
            beta = np.full(alpha.shape, -math.inf)
            beta[-1] = 0.0
            weight = times[at].astype(float)
            states, shares = [], []
            for i in range(len(codes) - 1, -1, -1):
                for j, some, state, value in self.arcs(codes, i):
                    on = value + beta[j, some]
                    beta[i, some] = np.logaddexp(beta[i, some], on)
                    share = weight[some] * np.exp(alpha[i, some] + on - alpha[-1, some])
                    if isinstance(some, slice):  # single letters
                        by = self.in_bytes[codes[i]]
                        if by.any():
                            spelt += np.bincount(codes[i][by], share[by], self.CODES)
                            state, share = state[~by], share[~by]
                    states.append(state)
                    shares.append(share)
            uses += np.bincount(np.concatenate(states), np.concatenate(shares), uses.size)
        for piece, k in self.number.items():
            if uses[k]:
                counts[piece] += uses[k]
        for c, n in zip(self.letters, spelt):
            for b in c.encode("utf-8", "surrogatepass") if n else b"":
                counts[f"<0x{b:02X}>"] += n


def estimated(docs: DataFrame, log_p: dict[str, float]) -> dict[str, float]:
    """log_p after a step of expectation maximisation over the words of all docs.

    Spark counts the distinct words; only the pieces' expected counts, one row each, come to the driver.
    """
    words = docs.where("text is not null").select(F.explode(F.split("text", "(?U)\\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    given = docs.sparkSession.sparkContext.broadcast(log_p)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = Table(given.value), defaultdict(float)
        held: list[pa.RecordBatch] = []

        def used() -> None:
            rows = pa.Table.from_batches(held)
            table.expected(rows.column("word").to_pylist(), rows.column("times").to_numpy(), counts)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                used()
        if held:
            used()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], ["piece", "uses"])

    uses = dict(words.mapInArrow(expect, "piece string, uses double").groupBy("piece").agg(F.sum("uses")).collect())
    total = sum(uses.values()) + SMOOTHING * len(log_p)
    return {p: math.log((uses.get(p, 0.0) + SMOOTHING) / total) for p in log_p}


def score(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, n_words, n_bytes, log_prob, bits_per_byte): one row for each row of docs.

    log_prob is the natural logarithm of the probability that pieces drawn independently spell the text,
    summed over all segmentations by a forward recursion in log space. A text is normalised to words with
    one word mark before each, as the vocabulary writes it; no piece crosses a word mark, so the lattice falls
    into one per word and each distinct word is computed once in a task. n_bytes counts the UTF-8 bytes of the words and of one blank
    before each. The pieces' probabilities start from the vocabulary's scores and are estimated from all docs.

    Null, empty and blank texts have no words: log_prob is 0 and bits_per_byte null. Rows of equal or null doc_id get a
    row each. No documents: no rows. Other columns are not looked at.
    """
    given = docs.sparkSession.sparkContext.broadcast(estimated(docs, vocabulary(model_file)))

    def scored_part(table: Table, known: dict[str, float], texts: list[str]) -> tuple[list, list, list]:
        split = [t.split() for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        for k in range(0, len(new), TOGETHER):
            known.update(zip(new[k : k + TOGETHER], table.log_probs(new[k : k + TOGETHER]).tolist()))
        found = [math.fsum(map(known.__getitem__, words)) for words in split]
        if len(known) > REMEMBERED:
            known.clear()
        return [len(w) for w in split], [len(w) + len("".join(w).encode("utf-8", "surrogatepass")) for w in split], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = Table(given.value), {}
        for batch in batches:
            texts, out, part, size = batch.column("text").to_pylist(), ([], [], []), [], 0
            for k, text in enumerate(texts):
                part.append(text or "")
                size += len(part[-1])
                if size >= LETTERS or k + 1 == len(texts):
                    for column, more in zip(out, scored_part(table, known, part)):
                        column += more
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["doc_id", "n_words", "n_bytes", "log_prob"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_bytes long, log_prob double")
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.lit(math.log(2)) / F.col("n_bytes")))
