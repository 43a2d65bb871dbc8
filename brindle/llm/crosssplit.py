"""Problem 2: the same or nearly the same record in training and in an evaluation split.

A question's plain words are cut into chunks by their content: a hash rolls over the words, and a chunk ends at every
word whose hash is less than that of its REACH neighbours on either side. Chunks are about three words long; an edit
changes those next to it only, and all before and after come out the same. A chunk is also ended at LONGEST words. Chunk digests are joined across the splits,
the lengths of shared chunks are summed and divided by the length of each record, and a pair goes on whose lesser
fraction is at least SHARE. An exact check on the runs of three words follows. The cutting is done with SEEDS different
hashes, since an edit that spoils the chunks of one seldom spoils those of the others; how many pairs all miss is
measured in tests/llm and given in the README.

Which digests must be joined: with a record's chunks ordered by how many records carry them, two records that share
chunks of SHARE of their length share one of those before the last chunks that together are shorter than SHARE. Only
those are joined, so that template words that all questions share are hardly ever among them. A digest that more than
HOT records carry is not joined alone: the pair must share a second chunk (unless the one is SHARE of the record by
itself), so the digest is joined together with each other chunk that could be the next of the shared ones. Nothing is
lost by either: any order that is the same for all records does, so the counts may be rough. They are those of 32 bits
of the digest, and every task holds the TABLE most frequent ones.

What goes to disk: the text is read three times (counts, keys, texts of the classes that are in a pair), since its
features are many times its size. A key is shuffled with its class and a signature only, 112 bits that the runs of three
words set and the number of runs. Two sets of runs differ in at least as many runs as their signatures in bits, so most
pairs that are not near are dropped where they meet, and no near one is. Copies of a question are one class in each
task and at each key before any join.

Defined results: rows without id or question take part in nothing; partition ignores case and outer blanks, anything
but training, development and final is none of them; a case delivered twice counts once; questions without any word
are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import spread, written

from .words import grid, mix, plain, runs, text_hashes

THRESHOLD, SHARE = 0.7, 0.6
SEEDS, REACH, LONGEST = (7, 11, 13, 17), 1, 4
HOT = 8
#: Digests whose counts each task holds; others count as rare, which costs pairs to look at but loses none.
TABLE = 2_000_000
#: Classes in a pair up to which each task holds them when their texts are read; with more they are joined.
WANTED = 4_000_000
#: Bits of a signature's first number, above which stands the number of runs, and of its second one.
BITS, MORE = 48, 64


def partition_of(col: Column) -> Column:
    p = F.lower(F.trim(col))
    return F.when(p.isin("training", "development", "final"), p)


def cut(words: np.ndarray, at: np.ndarray, seed: int = 7, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and length (in words) of every chunk, and where each text's chunks begin; a text without words has none."""
    roll = mix(words + np.uint64(seed))
    last = np.ones(len(words), bool)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for d in range(1, reach + 1):
        apart = text[d:] != text[:-d]
        less = roll[d:] < roll[:-d]
        last[d:] &= less | apart
        last[:-d] &= ~less | apart
    last[at[1:][np.diff(at) > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])[: len(stop)]
    inside = np.arange(len(words)) - np.repeat(start, stop - start)
    last |= inside % LONGEST == LONGEST - 1
    stop = np.flatnonzero(last) + 1
    ends = np.concatenate([[0], stop]).astype(np.int64)
    digest = mix(text_hashes(words, ends) + np.uint64(seed)) if len(stop) else np.empty(0, np.uint64)
    digest = digest & ~np.uint64(7) | np.diff(ends).astype(np.uint64)  # the length can be read from the digest
    return digest, np.diff(ends), np.searchsorted(stop, at, "right").astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, 5000):
            part = b.slice(s, 5000)
            yield part, *grid([plain(t) for t in part.column(text).to_pylist()])


def _different(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's different values, by owner and value."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def chunks(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different digests of every text under every hash; text i under the k-th hash is owner i * len(SEEDS) + k."""
    digests, owners = [], []
    for k, seed in enumerate(SEEDS):
        digest, _, of = cut(words, at, seed)
        digests.append(digest.view(np.int64))
        owners.append(np.repeat(np.arange(len(at) - 1) * len(SEEDS) + k, np.diff(of)))
    return _different(np.concatenate(digests), np.concatenate(owners))


def _run_sets(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, to = runs(words, at)
    return _different(h.view(np.int64), np.repeat(np.arange(len(at) - 1), np.diff(to)))


def signatures(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every text the bits that its runs of words set, in two numbers, with the number of runs above the first's."""
    h, owner = _run_sets(words, at)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.bincount(owner)  # every text has a run
    bit = h.view(np.uint64) % np.uint64(BITS + MORE)
    one, low = np.uint64(1), bit < BITS
    halves = (np.where(low, one << (bit % np.uint64(BITS)), np.uint64(0)), np.where(low, np.uint64(0), one << ((bit - np.uint64(BITS)) % np.uint64(MORE))))
    first, second = (np.bitwise_or.reduceat(x, np.cumsum(n) - n).view(np.int64) for x in halves)
    return np.minimum(n, 32767) << BITS | first, second


def _rough(digest: np.ndarray) -> np.ndarray:
    return (digest >> 32).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> pa.RecordBatch:
        d, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(n)], names=["d", "n"])

    seen: list[np.ndarray] = []
    for _, words, at in _slices(batches, "q"):
        seen.append(_rough(chunks(words, at)[0]))
        if sum(map(len, seen)) > 1_000_000:
            yield counted()
            seen = []
    if seen:
        yield counted()


def frequencies(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent digests, in ascending order, and how many records carry each."""
    n = written(spread(src.select("q")).mapInArrow(_counts, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 1"))
    least = 1
    while n.where(F.col("n") > least).count() > TABLE:
        least *= 2
    t = n.where(F.col("n") > least).toArrow()
    d, n = t["d"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(d)
    return d[order], n[order]


def records(df: DataFrame) -> DataFrame:
    """The split records: id, part and question; copies are still among them."""
    src = df.select(F.col("case_id").cast("string").alias("id"), partition_of(F.col("partition")).alias("part"), F.col("question").alias("q"))
    return src.where("id IS NOT NULL AND part IS NOT NULL AND q IS NOT NULL")


def join_keys(words: np.ndarray, of: np.ndarray, digest: np.ndarray, length: np.ndarray, carried: np.ndarray, share: float = SHARE, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which records must be joined, and the record of each. Record i has words[i] words and the shared
    chunks from of[i] to of[i + 1]; carried tells how many classes carry a chunk. Chunks that are in one split only
    are not given; they are the rarest."""
    n = len(words)
    owner = np.repeat(np.arange(n), np.diff(of))
    order = np.lexsort((digest, carried, owner))
    digest, length, carried = digest[order], length[order].astype(np.int64), carried[order]
    total = np.concatenate([[0], np.cumsum(length)])
    left = total[of[1:]][owner] - total[:-1]  # this chunk and the more frequent ones
    need = share * words[owner] - 1e-9
    head = left >= need
    alone = head & ((carried <= hot) | (length >= need))
    keys, rows = [digest[alone]], [owner[alone]]
    first = np.flatnonzero(head & (carried > hot))
    count = of[1:][owner[first]] - first - 1
    x = np.repeat(first, count)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    fit = left[y] >= need[x] - length[x]
    x, y = x[fit], y[fit]
    keys.append(mix(digest[x].view(np.uint64) * np.uint64(31) + digest[y].view(np.uint64)).view(np.int64))
    rows.append(owner[x])
    return np.concatenate(keys), np.concatenate(rows)


def _keys(src: DataFrame, held: Broadcast) -> DataFrame:
    """(key, cls, sig, more), each once and all of a key in one partition."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = held.value
        for _, words, at in _slices(batches, "q"):
            cls, size = text_hashes(words, at).view(np.int64), np.diff(at)
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            digest, owner = chunks(words, at)
            rough = _rough(digest)
            place = np.searchsorted(often, rough)
            known = place < len(often)
            known[known] = often[place[known]] == rough[known]
            carried = np.ones(len(digest), np.int64)
            carried[known] = times[place[known]]
            of = np.searchsorted(owner, np.arange(len(cls) * len(SEEDS) + 1))
            key, row = join_keys(np.repeat(size, len(SEEDS)), of, digest, digest & 7, carried)
            row = row // len(SEEDS)
            bare = np.flatnonzero(size == 0)  # a question without words has no chunk
            key, row = np.concatenate([key, cls[bare]]), np.concatenate([row, bare])
            key, row = key[first[row]], row[first[row]]
            sig, more = signatures(words, at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, cls[row], sig[row], more[row])], names=["key", "cls", "sig", "more"])

    return spread(src.select("q")).mapInArrow(keys, "key long, cls long, sig long, more long").repartition("key").distinct()


def candidates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Written table of (a, b): training and evaluation classes that share a key and may reach the threshold."""
    held = rows.sparkSession.sparkContext.broadcast(frequencies(rows))
    a = _keys(rows.where("part = 'training'"), held).withColumnsRenamed({"cls": "a", "sig": "sa", "more": "ma"})
    b = _keys(rows.where("part <> 'training'"), held).withColumnsRenamed({"cls": "b", "sig": "sb", "more": "mb"})
    # sets of x and y runs with overlap t differ in at most (1 - t) / (1 + t) * (x + y) runs
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")).bitwiseAND(F.lit((1 << BITS) - 1))) + F.bit_count(F.col("ma").bitwiseXOR(F.col("mb")))
    most = (1 - threshold) / (1 + threshold) * (F.shiftright("sa", BITS) + F.shiftright("sb", BITS)) + 1e-6
    return written(a.join(b, "key").where(apart <= most).select("a", "b").distinct())


def members(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written table of the records whose class is in a pair: id, part, q and cls."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    few = wanted.count() <= WANTED
    held = rows.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["cls"].to_numpy()) if few else None)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for part, words, at in _slices(batches, "q"):
            cls = text_hashes(words, at).view(np.int64)
            out = pa.RecordBatch.from_arrays([*part.columns, pa.array(cls)], names=["id", "part", "q", "cls"])
            if known is not None:
                place = np.searchsorted(known, cls)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == cls[hit]
                out = out.filter(pa.array(hit))
            yield out

    m = spread(rows).mapInArrow(classes, "id string, part string, q string, cls long")
    return written(m if few else m.join(wanted, "cls", "left_semi").select("id", "part", "q", "cls"))


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n: int, weighed: bool = False) -> np.ndarray:
    """How many values owners have in both, or the sum of the lengths that stand in them."""
    h, owner = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    return np.bincount(owner[both], h[both] & 7 if weighed else None, n)


def class_overlaps(pairs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, chunk_overlap, overlap): training class a and evaluation class b, both questions' words, at the threshold
    or above; a = b where the questions are equal. chunk_overlap is the shared chunks' length over that of the longer
    record, by the hash that gives more."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, words, at in _slices([b], "qa"):
                n = part.num_rows
                other, to = grid([plain(t) for t in part.column("qb").to_pylist()])
                x, y = _run_sets(words, at), _run_sets(other, to)
                common = _common(x, y, n)
                overlap = common / (np.bincount(x[1], minlength=n) + np.bincount(y[1], minlength=n) - common)
                longer = np.maximum(np.diff(at), np.diff(to))
                share = _common(chunks(words, at), chunks(other, to), n * len(SEEDS), True).reshape(n, -1).max(1, initial=0) / np.maximum(longer, 1)
                equal = part.column("a").to_numpy() == part.column("b").to_numpy()
                overlap[equal] = share[equal] = 1.0
                near = pa.array((share >= SHARE) & (overlap >= threshold))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(share), pa.array(overlap)], names=["a", "b", "chunk_overlap", "overlap"]).filter(near)

    text = rows.groupBy("cls").agg(F.first("q").alias("q"))
    both = pairs.join(text.withColumnsRenamed({"cls": "a", "q": "qa"}), "a").join(text.withColumnsRenamed({"cls": "b", "q": "qb"}), "b")
    return both.select("a", "b", "qa", "qb").mapInArrow(overlaps, "a long, b long, chunk_overlap double, overlap double")


def cross_pairs(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """train_id, eval_id, eval_part, chunk_overlap, overlap for every such pair of cases."""
    src = records(df)
    pairs = candidates(src, threshold)
    rows = members(src, pairs)
    near = class_overlaps(pairs, rows, threshold)
    member = rows.select("id", "part", "cls").distinct()
    t = member.where("part = 'training'").select(F.col("id").alias("train_id"), F.col("cls").alias("a"))
    e = member.where("part <> 'training'").select(F.col("id").alias("eval_id"), F.col("part").alias("eval_part"), F.col("cls").alias("b"))
    return near.join(t, "a").join(e, "b").where("train_id <> eval_id").select("train_id", "eval_id", "eval_part", "chunk_overlap", "overlap")


def found(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    p = cross_pairs(df, threshold)
    return p.select(F.least("train_id", "eval_id").alias("case_id_a"), F.greatest("train_id", "eval_id").alias("case_id_b")).distinct()


def report(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each evaluation partition and group: cases, cases that stand in training too, and their highest overlap."""
    group = df.select(F.col("case_id").cast("string").alias("id"), partition_of(F.col("partition")).alias("part"), F.lower(F.trim("group_id")).alias("grp")).where("id IS NOT NULL AND part IN ('development', 'final')").distinct()
    hit = cross_pairs(df, threshold).groupBy(F.col("eval_id").alias("id"), F.col("eval_part").alias("part")).agg(F.max("overlap").alias("overlap"), F.count("*").alias("partners"))
    g = group.join(hit, ["id", "part"], "left").groupBy("part", "grp")
    return g.agg(F.countDistinct("id").alias("cases"), F.countDistinct(F.when(F.col("overlap").isNotNull(), F.col("id"))).alias("leaked"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.max("overlap").alias("highest"))
