"""Problem 8: documents, measured in tokens, in sequences of a fixed capacity.

The plan is made on the histogram of lengths, which has no more entries than the capacity whatever the collection's
size. Sequences are opened with the longest length left; while the gap is too wide for three items the longest that
fits goes in; then a single length, a pair or a triple whose sum is exactly the gap is looked up among the lengths
that are still available, and the combination is consumed as often as the counts allow. What finds no exact
complement goes by best fit into the open sequences with the least room, also by length and count. The result is a
list of patterns with multiplicities; every item finds its sequence from its rank among the items of its length, which
comes from counts per file and length and not from one task holding a length.

Only an item above the capacity is split, into full sequences and a remainder.

Defined results: null and empty texts (no token) get no sequence, one row with null place; a row delivered twice is
packed twice; equal lengths are ordered by file and place in the file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread, written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points given to the tokenizer at once; a longer text goes in parts that end at a blank before a letter.
PART = 200_000


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the split pattern that belongs to the vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of the text. A very long text is cut before " letter", where the pattern starts a new match anyway."""
    import re

    e = _encoding(path)
    if len(text) <= PART:
        return len(e.encode_ordinary(text))
    n, i, seam = 0, 0, re.compile(r"(?<=\S)(?= [^\W\d_])")
    while i < len(text):
        m = seam.search(text, i + PART)
        j = m.start() if m else len(text)
        n += len(e.encode_ordinary(text[i:j]))
        i = j
    return n


def _complement(gap: int, count: np.ndarray) -> list[int] | None:
    """One, two or three available lengths that sum to the gap exactly."""
    if gap < len(count) and count[gap] > 0:
        return [gap]

    def pair(total: int, most: int) -> list[int] | None:
        a = np.arange(min(total - 1, most, len(count) - 1), (total - 1) // 2, -1)
        a = a[(count[a] > 0) & (count[total - a] > 0) & ((a * 2 != total) | (count[a] > 1))]
        return [int(a[0]), int(total - a[0])] if len(a) else None

    two = pair(gap, gap)
    if two:
        return two
    for a in np.flatnonzero(count[: gap - 1])[::-1]:
        if a * 3 < gap:
            break
        count[a] -= 1
        two = pair(int(gap - a), int(a))
        count[a] += 1
        if two:
            return [int(a), *two]
    return None


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths in order of place) that use up histogram[1..capacity] exactly."""
    count = np.zeros(capacity + 1, np.int64)
    count[: len(histogram)] = histogram
    count[0] = 0
    done: list[tuple[int, list[int]]] = []
    rest = np.zeros(capacity + 1, np.int64)

    def take(items: list[int]) -> int:
        used = np.unique(items, return_counts=True)
        return int((count[used[0]] // used[1]).min()), used

    if count[capacity]:
        done.append((int(count[capacity]), [capacity]))
        count[capacity] = 0
    while count.any():
        longest = int(np.flatnonzero(count)[-1])
        items, gap = [longest], capacity - longest
        count[longest] -= 1
        while True:
            some = np.flatnonzero(count[: gap + 1])
            if not len(some) or gap <= 3 * int(some[-1]):
                break
            items.append(int(some[-1]))
            count[some[-1]] -= 1
            gap -= int(some[-1])
        more = _complement(gap, count) if gap else []
        for x in items:
            count[x] += 1
        if more is None or gap and not len(np.flatnonzero(count[: gap + 1])):
            rest[longest] += count[longest]
            count[longest] = 0
            continue
        items += more
        m, used = take(items)
        count[used[0]] -= used[1] * m
        done.append((m, items))
    # best fit, longest first, on groups of equal open sequences
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in np.flatnonzero(rest)[::-1].tolist():
        n = int(rest[length])
        for r in sorted(k for k in room if k >= length):
            while n and room.get(r):
                m, items = room[r].pop()
                fits = min(r // length, n) if m == 1 else 1
                k = min(m, n // fits)
                if k < m:
                    room[r].append((m - k, items))
                room.setdefault(r - fits * length, []).append((k, items + [length] * fits))
                n -= k * fits
            if not room.get(r):
                room.pop(r, None)
        each = capacity // length
        if n >= each:
            room.setdefault(capacity - each * length, []).append((n // each, [length] * each))
        if n % each:
            room.setdefault(capacity - n % each * length, []).append((1, [length] * (n % each)))
    for groups in room.values():
        done += groups
    return done


def _intervals(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length in turn the ranks at which a pattern's items begin, with the pattern's sequences and places."""
    rows: list[tuple[int, ...]] = []
    used = np.zeros(capacity + 1, np.int64)
    base = 0
    for m, items in patterns:
        place = offset = 0
        for length in items:
            rows.append((length, int(used[length]), m, base, place, offset))
            used[length] += m
            place, offset = place + 1, offset + length
        base += m
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(6))


def measured(df: DataFrame, capacity: int, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (doc_id, piece, pieces, token_start, token_end, length, file, nth): one row a piece; nth is the
    piece's place among those of its length in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = np.zeros(capacity + 1, np.int64)
        file = TaskContext.get().partitionId()
        for b in batches:
            n = np.array([count_tokens(t, tokenizer) if t else 0 for t in b.column(1).to_pylist()], np.int64)
            pieces = np.maximum(-(-n // capacity), 1)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            end = np.minimum(start + capacity, n[row])
            length = end - start
            order = np.argsort(length, kind="stable")
            s = length[order]
            at = np.empty(len(s), np.int64)
            at[order] = np.arange(len(s)) - np.searchsorted(s, s, "left")
            place = nth[length] + at
            nth += np.bincount(length, minlength=capacity + 1)
            cols = [b.column(0).take(pa.array(row)), *(pa.array(x) for x in (piece + 1, pieces[row], start, end, length, np.full(len(row), file), place))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "pieces", "token_start", "token_end", "length", "file", "nth"])

    names = "doc_id long, piece long, pieces long, token_start long, token_end long, length long, file long, nth long"
    return written(spread(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))).mapInArrow(run, names))


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, pieces, token_start, token_end, sequence, place (from 1), offset (tokens before it)."""
    items = measured(df, capacity, tokenizer, key, text)
    per_file = items.where("length > 0").groupBy("length", "file").agg(F.count("*").alias("n"))
    total = per_file.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most capacity rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in total:
        histogram[r.length] = r.n
    table = _intervals(plan(histogram, capacity), capacity)
    held = df.sparkSession.sparkContext.broadcast(table)
    before = per_file.select("length", "file", F.expr("sum(n) OVER (PARTITION BY length ORDER BY file) - n").alias("before"))
    ranked = items.join(before, ["length", "file"], "left").select(
        "doc_id", "piece", "pieces", "token_start", "token_end", "length", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, _, bases, places, offsets = held.value
        code = lengths << 44 | starts
        for b in batches:
            length, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            i = np.maximum(np.searchsorted(code, length << 44 | rank, "right") - 1, 0)
            none = length == 0
            if not len(code):
                i, got = np.zeros(len(length), np.int64), [np.zeros(len(length), np.int64)] * 3
            else:
                got = [bases[i] + rank - starts[i], places[i] + 1, offsets[i]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(x, pa.int64(), mask=none) for x in got)], names=["doc_id", "piece", "pieces", "token_start", "token_end", "sequence", "place", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece long, pieces long, token_start long, token_end long, sequence long, place long, offset long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, share of the room that is filled, and the least number of sequences possible."""
    s = packed.where("sequence IS NOT NULL").agg(F.countDistinct("sequence").alias("sequences"), F.coalesce(F.sum(F.col("token_end") - F.col("token_start")), F.lit(0)).alias("tokens"))
    return s.select("sequences", "tokens", (F.col("tokens") / F.greatest(F.col("sequences") * capacity, F.lit(1))).alias("filled"), F.ceil(F.col("tokens") / capacity).alias("least_sequences"))
