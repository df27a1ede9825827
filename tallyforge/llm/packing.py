"""Best-two-fit packing of documents into bins of equal token capacity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import word_count
from ..plans.ranking import seeded_key
from ..plans.scratch import cut

CAPACITY, GROUP, SEED = 2048, 20_000, 41


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths (1 to capacity each).

    A bin takes the largest piece that fits until none does. Then, if two unpacked pieces together are
    longer than its smallest piece and fit where that one and the gap are, the pair that leaves least
    takes its place (of equal pairs that with the shortest piece) and it is unpacked again. Of pieces of
    equal length the first goes first.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[i], []).append(i)
    count = np.zeros(capacity + 1, np.int64)
    there = 0  # bit n: a piece of length n is unpacked
    for n, stack in stacks.items():
        count[n] = len(stack)
        there |= 1 << n
    bins = []
    while there:
        packed: list[tuple[int, int]] = []
        gap = capacity
        while n := max(0, (there & ((1 << (gap + 1)) - 1)).bit_length() - 1):
            packed.append((n, stacks[n].pop()))
            count[n] -= 1
            there ^= (not count[n]) << n
            gap -= n
        small, which = packed[-1]
        if gap and there:
            room = gap + small
            left = np.flatnonzero(count[:room])
            if left.size:
                other = np.searchsorted(left, room - left, "right") - 1
                ok = other >= 0
                pair = np.where(ok, left[other], 0)
                same = (pair == left) & (count[left] < 2)  # a piece can't pair with itself: take the next shorter
                pair = np.where(same, np.where(other > 0, left[np.maximum(other - 1, 0)], 0), pair)
                both = np.where(pair > 0, left + pair, 0)
                best = int(both.argmax())
                if both[best] > small:
                    packed.pop()
                    stacks[small].append(which)
                    count[small] += 1
                    there |= 1 << small
                    for n in sorted((int(left[best]), int(pair[best])), reverse=True):
                        packed.append((n, stacks[n].pop()))
                        count[n] -= 1
                        there ^= (not count[n]) << n
        bins.append([i for _, i in packed])
    return bins


def pack(docs: DataFrame, tokens: Column | None = None, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(bin_id, position, doc_id, token_from, n_tokens): which slice of which document lies where in which bin.

    Documents are packed in seeded groups of about group of them, each by best_two_fit, so the work of a
    task doesn't grow with the corpus. A document longer than capacity fills bins of its own and its rest
    is packed like a document. Every token of every document is in exactly one bin.

    Null and empty texts have no tokens and are in no bin. Rows of equal doc_id are packed each. Of pieces
    of equal length the lower doc_id (null first) goes first. No documents: no rows. Other columns are not
    looked at.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) if tokens is None else tokens).cast("long").alias("__n"), seeded_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")))).alias("__key")).where("__n > 0"))
    groups = max(1, -(-rows.count() // group))
    # the first 15 digits as a number, so that groups are alike at any count of them
    rows = rows.select("doc_id", "__n", (F.conv(F.substring("__key", 1, 15), 16, 10).cast("long") % groups).alias("__group"))

    def bins(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("doc_id", "ascending"), ("__n", "ascending")], null_placement="at_start"))
        sizes = part.column("__n").to_numpy()
        rest, full = sizes % capacity, sizes // capacity
        left = np.flatnonzero(rest)
        packed = best_two_fit(rest[left].tolist(), capacity)
        whole = np.repeat(np.arange(len(sizes)), full)
        at = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        order = left[np.fromiter((i for b in packed for i in b), np.int64, left.size)]
        number = np.repeat(np.arange(len(packed)), [len(b) for b in packed])
        position = np.fromiter((k for b in packed for k in range(len(b))), np.int64, left.size)
        return pa.table({
            "bin_id": pa.array(np.concatenate([number, len(packed) + np.arange(len(whole))]) + (part.column("__group")[0].as_py() << 32), pa.int64()),
            "position": pa.array(np.concatenate([position, np.zeros(len(whole), np.int64)]), pa.int32()),
            "doc_id": part.column("doc_id").take(pa.array(np.concatenate([order, whole]))),
            "token_from": pa.array(np.concatenate([full[order] * capacity, at * capacity]), pa.int64()),
            "n_tokens": pa.array(np.concatenate([rest[order], np.full(len(whole), capacity)]), pa.int32()),
        })

    return rows.groupBy("__group").applyInArrow(bins, "bin_id long, position int, doc_id long, token_from long, n_tokens int")
