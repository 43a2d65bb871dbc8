"""Problem 5: near-duplicate passages, by bit-sliced comparison of signatures.

A text is the set of its runs of three words. From 128 min-hashes come a 128-bit signature (one bit of each) whose
Hamming distance falls with the overlap, and BANDS keys of ROWS min-hashes each that bring likely partners together.
Within a task the signatures are stored vertically, once: plane k holds bit k of all rows, 64 rows a machine word, the
largest groups first. Row i is compared with row i + d, for all i at once, by exclusive-or of the planes with themselves
shifted by d bits; carry-save adders count the differing bits of all these pairs, and a stretch of pairs is abandoned as
soon as every counter in it is beyond the radius. What is left is checked exactly on the runs themselves.

Equal texts (the same words in the same order) are one class from the start, so copies cost nothing; they are spread
out again in the pair output only. A band key that too many classes share is split: its classes are dealt to blocks
and every pair of blocks is compared in a task of its own, so that no task gets the whole group and none is cut short.
Such keys are found by counting over all partitions: first in buckets of the key's leading bits, as many as keep the
mean bucket far below a group, then key by key in the buckets that hold more than a group.

At the threshold of 0.7 a pair is missed by all bands with a chance of (1 - 0.7^3)^26 = 2e-5, and by the radius with
one of about 3e-7; at 0.8 with less than 1e-8. A run is known by 48 bits of its hash and a class by 64: two of the runs
of a pair of texts of 1,000 words fall together with a chance of 1e-8.

Defined results: rows without id or text take part in nothing; an id delivered twice counts once; texts without any
word are one class; ties cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import slots, spread, written

from .words import grid, mix, plain, runs, text_hashes

BITS, BANDS, ROWS = 128, 26, 3
#: Hamming distance up to which a pair is checked exactly; 0.15 * 128 is expected at an overlap of 0.7, 64 for strangers.
RADIUS = 40
#: Classes that share a band key and are compared in one task at most.
GROUP = 40_000
SEEDS = mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _minhash(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(texts, BITS) uint32: the least value of each hash function over each text's runs."""
    n = len(to) - 1
    out = np.empty((n, BITS), np.uint32)
    odd, add = SEEDS | np.uint64(1), mix(SEEDS)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(to, to[i] + 1500, "right")) - 1)
        part = h[to[i] : to[j]]
        v = ((part[None, :] * odd[:, None] + add[:, None]) >> np.uint64(32)).astype(np.uint32)
        out[i:j] = np.minimum.reduceat(v, to[i:j] - to[i], axis=1).T
        i = j
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2^48 in six bytes each."""
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 1000):
            part = b.slice(s, 1000)
            words, at = grid([plain(t) for t in part.column(1).to_pylist()])
            h, to = runs(words, at)
            low = _minhash(h, to)
            sig = np.packbits((low >> 7 & 1).astype(bool), axis=1)
            keys = np.zeros((len(low), BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix(keys * np.uint64(31) + low[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sets = [_packed(np.unique(h[to[i] : to[i + 1]] >> np.uint64(16))) for i in range(len(low))]
            first, second = np.ascontiguousarray(sig).view(np.int64).T
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(text_hashes(words, at).view(np.int64)), pa.array(first), pa.array(second),
                 pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(sets, pa.binary())],
                names=["id", "cls", "sig1", "sig2", "keys", "runs"],
            )


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64)
        at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(i).take(at) for i in range(3))], names=["key", "cls", "sig1", "sig2"])


def _bucket_counts(bits: int):
    """How many keys of the partition begin with each bit pattern."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) >> np.uint64(64 - bits) for b in batches]
        if parts:
            k, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["bucket", "n"])

    return count


def vertical(sig: np.ndarray, pad: int) -> np.ndarray:
    """(bits, words) uint64 bit planes of (rows, bytes) uint8 signatures, with at least pad words more at the end."""
    bits = np.unpackbits(sig, axis=1)
    words = -(-len(sig) // 64) + pad
    planes = np.zeros((bits.shape[1], words * 8), np.uint8)
    some = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes[:, : some.shape[1]] = some
    return planes.view(np.uint64)


class Counters:
    """Counters of many pairs, one bit of each in a word: up to two planes for every binary digit, not yet carried."""

    def __init__(self) -> None:
        self.digits: list[list[np.ndarray]] = []

    def add(self, planes: np.ndarray, digit: int = 0) -> None:
        """One more bit of weight 2^digit from each of the planes (number, ...), by full adders."""
        while len(self.digits) <= digit:
            self.digits.append([])
        x = np.concatenate([planes, *(p[None] for p in self.digits[digit])])
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            t = a ^ b
            self.add((a & b) | (t & c), digit + 1)
            x = np.concatenate([t ^ c, x[3 * m :]])
        self.digits[digit] = list(x)

    def keep(self, at: np.ndarray) -> None:
        self.digits = [[p[at] for p in d] for d in self.digits]

    def beyond(self, radius: int) -> np.ndarray:
        """Bits set where a counter is above the radius: the carries are run through, then a vertical comparison from
        the highest digit down."""
        zero = np.zeros_like(self.digits[0][0])
        binary, carry = [], zero
        for d in self.digits:
            a, b = (*d, zero, zero)[:2]
            t = a ^ b
            binary.append(t ^ carry)
            carry = (a & b) | (t & carry)
        binary.append(carry)
        over, equal = zero, ~zero
        if radius >> len(binary):
            return over
        for k in range(len(binary) - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & binary[k]
            else:
                over = over | (equal & binary[k])
                equal = equal & ~binary[k]
        return over


def close_pairs(sig: np.ndarray, group: np.ndarray, radius: int, stretch: int = 8, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i <> j, of one group (equal neighbours in group) and at most radius apart, each pair once.

    sig is (n, bytes) uint8. stretch is the number of 64-bit words after which pairs are abandoned together, step the
    number of planes between two looks at what can be abandoned.
    """
    n, none = len(sig), np.empty(0, np.int64)
    if n < 2:
        return none, none
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    by_size = np.argsort(-size, kind="stable")  # the pairs that a distance d still has are then in the first words
    size = size[by_size]
    ends = np.cumsum(size)
    rows = np.repeat(begin[by_size] - (ends - size), size) + np.arange(n)
    later = np.repeat(ends, size) - 1 - np.arange(n)  # rows of its group that come after a row
    planes = vertical(sig[rows], 2 * stretch + 2 + int(size[0]) // 64)
    nbits = len(planes)
    first, second = [], []
    for d in range(1, int(size[0])):
        top = int(ends[np.searchsorted(-size, -d, "left") - 1])  # rows in groups of more than d
        words = -(-top // (64 * stretch)) * stretch
        mask = np.zeros(words * 8, np.uint8)
        some = np.packbits(later[:top] >= d, bitorder="little")
        mask[: len(some)] = some
        live = mask.view(np.uint64).reshape(-1, stretch)
        alive = np.flatnonzero(live.any(axis=1))
        at = (alive[:, None] * stretch + np.arange(stretch)).ravel()
        whole = len(at) == words
        q, r = divmod(d, 64)
        counters = Counters()
        for k in range(0, nbits, step):
            p = planes[k : k + step]
            if whole:
                x = p[:, q : q + words] >> np.uint64(r)
                if r:
                    x |= p[:, q + 1 : q + 1 + words] << np.uint64(64 - r)
                x ^= p[:, :words]
            else:
                x = p[:, at + q] >> np.uint64(r)
                if r:
                    x |= p[:, at + q + 1] << np.uint64(64 - r)
                x ^= p[:, at]
            counters.add(x)
            done = k + step >= nbits
            if not done and k + step <= radius:
                continue
            near = ~counters.beyond(radius) & live[alive].ravel()
            keep = near.reshape(-1, stretch).any(axis=1)
            if done:
                ok = np.unpackbits(near[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
                where = (at[:, None] * 64 + np.arange(64))[ok]
                first.append(rows[where])
                second.append(rows[where + d])
            elif not keep.all():
                alive, whole = alive[keep], False
                if not len(alive):
                    break
                at = (alive[:, None] * stretch + np.arange(stretch)).ravel()
                counters.keep(np.flatnonzero(np.repeat(keep, stretch)))
    return (np.concatenate(first) if first else none), (np.concatenate(second) if second else none)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            key, cls = t["key"].to_numpy(), t["cls"].to_numpy()
            some = np.zeros(len(key), bool)  # rows that share their key with a neighbour
            same = key[1:] == key[:-1]
            some[1:] |= same
            some[:-1] |= same
            at = np.flatnonzero(some)
            sig = np.stack([t["sig1"].to_numpy()[at], t["sig2"].to_numpy()[at]], axis=1).view(np.uint8)
            i, j = close_pairs(sig, key[at], radius)
            a, b = cls[at][i], cls[at][j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        held = 0
        for b in batches:  # rows come sorted by key; a group may run over batches
            rest.append(b)
            held += b.num_rows
            if held < 60_000:
                continue
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield close([*rest[:-1], b.slice(0, cut)])
                rest = [b.slice(cut)]
                held = rest[0].num_rows
        if rest:
            yield close(rest)

    return run


def classes(df: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """Written table (id, cls, sig1, sig2, keys, runs), one row a key."""
    src = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return written(spread(src).mapInArrow(signatures, "id string, cls long, sig1 long, sig2 long, keys binary, runs binary"))


def class_pairs(rows: DataFrame, threshold: float, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b, overlap): classes that reach the threshold, a < b."""
    spark = rows.sparkSession
    n = slots(spark)
    one = rows.groupBy("cls").agg(F.first("sig1").alias("sig1"), F.first("sig2").alias("sig2"), F.first("keys").alias("keys"))
    single = one.mapInArrow(_explode, "key long, cls long, sig1 long, sig2 long")
    bits = max(10, (BANDS * 20 * rows.count() // group).bit_length())
    buckets = rows.select("keys").mapInArrow(_bucket_counts(bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = written(buckets.where(F.col("n") > group).select("bucket"))
    bound = 100_000
    some = buckets.limit(bound + 1).count()
    if some:
        held = (lambda x: F.broadcast(x)) if some <= bound else (lambda x: x)
        bucket = F.shiftrightunsigned("key", 64 - bits)
        hot = single.withColumn("bucket", bucket).join(held(buckets), "bucket", "left_semi").groupBy("key").count().where(F.col("count") > group)
        hot = hot.select("key", F.ceil(F.col("count") / (group / 2)).cast("int").alias("n"))  # at most BANDS * classes / group rows
        single = single.join(hot, "key", "left")
        mine = F.expr("pmod(cls, n)")
        others = F.expr("filter(sequence(0, n - 1), x -> x <> pmod(cls, n))")
        split = single.where("n IS NOT NULL").withColumn("m", mine).withColumn("o", F.explode(others))
        split = split.select(F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o")).alias("key"), "cls", "sig1", "sig2")
        single = single.where("n IS NULL").select("key", "cls", "sig1", "sig2").unionByName(split)
    sorted_ = single.repartition(n, "key").sortWithinPartitions("key", "cls")
    near = sorted_.mapInArrow(_compare(radius), "a long, b long").distinct()
    sets = rows.groupBy("cls").agg(F.first("runs").alias("r"))

    @F.arrow_udf("double")
    def overlap(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist()):
            u, v = _unpacked(p), _unpacked(q)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both / (len(u) + len(v) - both))
        return pa.array(out, pa.float64())

    near = near.join(sets.select(F.col("cls").alias("a"), F.col("r").alias("ra")), "a").join(sets.select(F.col("cls").alias("b"), F.col("r").alias("rb")), "b")
    return near.select("a", "b", overlap("ra", "rb").alias("overlap")).where(F.col("overlap") >= threshold)


def near_pairs(df: DataFrame, threshold: float = 0.7, key: str = "passage_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: all pairs of keys whose texts overlap by the threshold or more, equal texts included."""
    rows = classes(df, key, text)
    pairs = class_pairs(rows, threshold).select("a", "b")
    member = rows.select("id", "cls").distinct()
    x, y = member.select(F.col("id").alias("x"), F.col("cls").alias("a")), member.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def groups(df: DataFrame, threshold: float = 0.8, key: str = "passage_id", text: str = "text") -> DataFrame:
    """One row a key: its group (the least class of the near-duplicate component), the group's class links that start
    or end at its own class, and the number of keys with its very words. Copies are not expanded into pairs."""
    from .components import components

    rows = classes(df, key, text)
    pairs = written(class_pairs(rows, threshold).select("a", "b"))
    comp = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    one = rows.select("id", "cls").distinct()
    size = one.groupBy("cls").agg(F.count("*").alias("copies"))
    info = size.join(comp, "cls", "left").join(ends, "cls", "left")
    info = info.select("cls", F.coalesce("component", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return one.join(info, "cls").select(F.col("id").alias(key), "group_id", "links", "copies")
