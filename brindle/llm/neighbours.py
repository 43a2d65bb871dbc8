"""Problem 6: the most similar vectors for every vector, by a permutation index.

Pivots are drawn from the collection. A vector is represented by its nearest pivots in order of closeness and posted in
the inverted files of the first POSTS of them. Within a file the vectors are told apart by the file's own pivots: each
is represented by its LENGTH nearest of PIVOTS vectors of the file, in order, and for every vector the others are
ranked by the footrule distance of these permutations. The LIST nearest by footrule, and no others, are reranked by
their cosine in double precision. The files' results are merged per vector.

The footrule distance of two truncated permutations is a constant less twice the sum, over the pivots they share, of
the lesser of the two weights LENGTH - position. Weights are counted in steps of STEP places and written in unary, so
that the sum is the number of bits two codes have in common: LENGTH / STEP * PIVOTS bits a vector, whatever the file.

Two levels: the pivots of the first level come from a sample of at most SAMPLE vectors with the least hash (whatever
the collection's size); every vector is posted. A file that is expected to hold more than BLOCK vectors has pivots of
its own, in number to its size, and its vectors are posted once more, in the files of their LOCAL nearest ones. So the
files keep their length while the collection grows. Files that are still longer (very many vectors around one pivot)
are dealt to blocks, and each pair of blocks is compared in a task of its own. Exact copies are one class with its
six least ids, so that a vector that is a third of the collection costs as much as any other.

Memory of a task: BLOCK vectors and their codes, and CHUNK rows of BLOCK counts.

Recall against brute force is measured in tests/llm and given in the README.

Defined results: a vector is usable if it has 64 finite numbers, not all zero; others take part in nothing; a row
delivered twice counts once; equal cosines are ordered by the smaller id; fewer than k others give fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import slots, written

DIM, K = 64, 5
POSTS, LOCAL = 4, 3
PIVOTS, LENGTH, STEP = 128, 32, 8
LIST = 256
#: Postings that the first level leaves in a file on average, while SAMPLE pivots are enough for it.
FILE = 640
SAMPLE = 8_192
BLOCK = 8_000
#: Vectors of a file that its own pivots are to leave in each of their files, and the most pivots of a file.
TARGET, MOST = 1_500, 16_384
#: Vectors of a file that are posted to its own pivots by one task.
SALT = 50_000
CHUNK = 256


def usable(df: DataFrame, key: str = "vector_row", vector: str = "vector", dim: int = DIM) -> DataFrame:
    """(id, vec, cls): cls is a hash of the vector's numbers."""
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    ok = f"id IS NOT NULL AND size(vec) = {dim} AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf')) AND exists(vec, x -> x <> 0)"
    return v.where(ok).select("id", "vec", F.xxhash64("vec").alias("cls"))


def pivots_for(n: int) -> int:
    """Number of pivots for n vectors, so that a file has about FILE postings."""
    return int(min(max(POSTS * n / FILE, 16), SAMPLE, n))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def permutations(u: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row in order; ties by the pivot's number."""
    length = min(length, len(pivots))
    c = u.astype(np.float32) @ pivots.T
    top = np.sort(np.argpartition(-c, length - 1, axis=1)[:, :length], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(c, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def codes(u: np.ndarray, pivots: np.ndarray, length: int = LENGTH, step: int = STEP) -> np.ndarray:
    """(words, rows) uint64: the unary weights of each row's permutation, as bits; a plane of 64 bits a word."""
    perm = permutations(u, pivots, length)
    bits = np.zeros((len(u), -(-length // step), -(-len(pivots) // 64) * 64), bool)
    rows = np.arange(len(u))[:, None]
    for level in range(bits.shape[1]):
        bits[rows, level, perm[:, : length - level * step]] = True
    return np.ascontiguousarray(np.packbits(bits.reshape(len(u), -1), axis=1).view(np.uint64).T)


def nearest_by_footrule(code: np.ndarray, i: int, j: int, size: int) -> np.ndarray:
    """(j - i, size): for rows i to j the others with the least footrule distance, in no order."""
    common = np.zeros((j - i, code.shape[1]), np.uint16)
    for plane in code:
        common += np.bitwise_count(plane[i:j, None] & plane[None, :])
    common[np.arange(j - i), np.arange(i, j)] = 0
    return np.argpartition(common, common.shape[1] - size, axis=1)[:, common.shape[1] - size :]


def within(vectors: np.ndarray, k: int = K, size: int = LIST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of the k best of every row of one inverted file: the size nearest by footrule are
    reranked. The file's pivots are its first rows, which must come in the order of a hash."""
    n = len(vectors)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    u = unit(vectors)
    f = u.astype(np.float32)
    code = codes(f, f[:PIVOTS]) if n > size + 1 else None
    kk = min(k + 3, n - 1)
    q, b, s = [], [], []
    for i in range(0, n, CHUNK):
        j = min(i + CHUNK, n)
        if code is None:
            near, sim = np.broadcast_to(np.arange(n), (j - i, n)), f[i:j] @ f.T
        else:
            near = nearest_by_footrule(code, i, j, size)
            sim = np.matmul(f[near], f[i:j, :, None])[:, :, 0]
        sim[near == np.arange(i, j)[:, None]] = -9
        top = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
        rows = np.repeat(np.arange(j - i), kk)
        good = sim[rows, top.ravel()] > -5
        rows, cols = rows[good] + i, np.take_along_axis(near, top, 1).ravel()[good]
        exact = np.einsum("ij,ij->i", u[rows], u[cols])
        order = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, "left")
        keep = np.arange(len(rows)) - first < k
        q.append(rows[keep]), b.append(cols[keep]), s.append(exact[keep])
    return np.concatenate(q), np.concatenate(b), np.concatenate(s)


def _rows(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(b.schema.get_field_index(name))
    return col.flatten().to_numpy().reshape(len(col), -1)


def _post(pivots: np.ndarray):
    """One posting for each of a vector's first pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                raw = _rows(b, "vec").astype(np.float32)
                perm = permutations(unit(raw), pivots, POSTS)
                take = pa.array(np.repeat(np.arange(len(raw)), perm.shape[1]))
                vec = pa.array([x.tobytes() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(perm.ravel().astype(np.int64)), b.column(0).take(take), vec.take(take)], names=["file", "cls", "vec"])

    return run


def _post_again(dim: int):
    """Rows (file, salt, pivot, cls, vec) come in that order, a file's own pivots before its vectors; each vector is
    posted in the files of its nearest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own = None, [], None
        for b in batches:
            file, salt, order = (b.column(i).to_numpy() for i in range(3))
            raw = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(-1, dim)
            change = np.flatnonzero((file[1:] != file[:-1]) | (salt[1:] != salt[:-1]) | (order[1:] != order[:-1])) + 1
            cuts = [0, *change.tolist(), len(file)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if now != (file[lo], salt[lo]):
                    now, held, own = (file[lo], salt[lo]), [], None
                if order[lo] == 0:
                    held.append(raw[lo:hi])
                    continue
                if own is None:
                    own = unit(np.concatenate(held)).astype(np.float32) if held else np.zeros((1, dim), np.float32)
                for i in range(lo, hi, 2000):
                    j = min(i + 2000, hi)
                    perm = permutations(unit(raw[i:j]), own, LOCAL)
                    take = pa.array(np.repeat(np.arange(i, j), perm.shape[1]))
                    # the file's number, and from 1 the number of its own pivot
                    key = (int(file[lo]) << 32) + 1 + perm.ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(3).take(take), b.column(4).take(take)], names=["file", "cls", "vec"])

    return run


def _rank(k: int, dim: int):
    """Rows (file, pair, cls, vec) come in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            cls = t["cls"].to_numpy()
            vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(len(cls), dim)
            q, b, s = within(vec, k)
            return pa.RecordBatch.from_arrays([pa.array(cls[q]), pa.array(cls[b]), pa.array(s)], names=["cls", "other", "cosine"])

        for b in batches:
            file, pair = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(file)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and now != (file[lo], pair[lo]):
                    yield close(held)
                    held = []
                now = (file[lo], pair[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield close(held)

    return run


def _dealt(posts: DataFrame, block: int) -> DataFrame:
    """(file, pair, cls, vec): files of more than block vectors are dealt to blocks, and a posting goes to every pair
    of blocks that has its own."""
    n = posts.groupBy("file").count().where(F.col("count") > block).select("file", F.ceil(F.col("count") / (block / 2)).alias("n"))
    j = posts.join(n, "file", "left").withColumn("m", F.expr("pmod(cls, n)"))
    pairs = F.expr("CASE WHEN n IS NULL THEN array(0L) ELSE transform(filter(sequence(0L, n - 1), x -> x <> m), x -> shiftleft(least(x, m), 32) + greatest(x, m)) END")
    return j.select("file", F.explode(pairs).alias("pair"), "cls", "vec")


def _second_level(posts: DataFrame, expected: dict[int, float], dim: int, block: int) -> DataFrame:
    """(file, pair, cls, vec) of the postings in files that are expected to be long, by these files' own pivots: vectors
    with a low hash, as many as leave about TARGET vectors to each."""
    spark = posts.sparkSession
    rows = [(int(p), min(1.0, min(LOCAL * e / TARGET, MOST) / e), max(1, round(e / SALT))) for p, e in expected.items()]
    long = spark.createDataFrame(rows, "file long, share double, salts int")  # at most SAMPLE rows
    j = posts.join(F.broadcast(long), "file")
    # every vector once, and the file's pivots once more before the vectors of each salt
    low = (F.shiftrightunsigned(F.xxhash64("cls", F.lit(29)), 11) / float(2**53)) < F.col("share")
    places = F.when(low, F.expr("concat(array(struct(cast(pmod(cls, salts) AS int) AS salt, 1 AS step)), transform(sequence(0, salts - 1), x -> struct(x AS salt, 0 AS step)))"))
    places = places.otherwise(F.expr("array(struct(cast(pmod(cls, salts) AS int) AS salt, 1 AS step))"))
    each = j.select("file", F.explode(places).alias("p"), "cls", "vec").select("file", "p.salt", "p.step", "cls", "vec")
    each = each.repartition(slots(spark), "file", "salt").sortWithinPartitions("file", "salt", "step", "cls")
    return _dealt(written(each.mapInArrow(_post_again(dim), "file long, cls long, vec binary")), block)


def neighbours(df: DataFrame, k: int = K, key: str = "vector_row", vector: str = "vector", dim: int = DIM, n_pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, others): the k most similar others of every usable vector as structs (cosine, id), best first."""
    spark = df.sparkSession
    rows = usable(df, key, vector, dim)
    ranked = rows.select("cls", "id", "vec").withColumn("r", F.expr("dense_rank() OVER (PARTITION BY cls ORDER BY id)")).where(F.col("r") <= k + 1)
    reps = ranked.groupBy("cls").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))
    n = rows.agg(F.approx_count_distinct("cls", 0.02)).first()[0]  # for the number of pivots and blocks only
    # Only rows whose hash is low enough for about twice the sample are ordered, else every task would send a whole sample.
    h = F.shiftrightunsigned(F.xxhash64(F.col("cls"), F.lit(17)), 1)
    low = rows.select("cls", "vec", h.alias("h")).where(F.col("h") <= min(int(2 * SAMPLE / max(n, 1) * 2**63), 2**63 - 1))
    drawn = low.distinct().orderBy("h", "cls").limit(SAMPLE).collect()
    if not drawn:
        return rows.select("id", F.array().cast("array<struct<cosine:double,id:long>>").alias("others")).limit(0)
    sample = unit(np.array([r.vec for r in drawn], np.float64))
    p = min(n_pivots or pivots_for(n), len(sample))
    pivots = sample[:p].astype(np.float32)
    expected = np.bincount(permutations(sample, pivots, POSTS).ravel(), minlength=p) * (max(n, len(sample)) / len(sample))
    long = {int(x): float(expected[x]) for x in np.flatnonzero(expected > block)}
    posts = reps.select("cls", "vec").mapInArrow(_post(pivots), "file long, cls long, vec binary")
    files = posts.select("file", F.lit(0).cast("long").alias("pair"), "cls", "vec")
    if long:
        files = files.where(~F.col("file").isin(list(long))).unionByName(_second_level(posts, long, dim, block))
    files = files.repartition(slots(spark), "file", "pair").sortWithinPartitions("file", "pair", "cls")
    near = files.mapInArrow(_rank(k, dim), "cls long, other long, cosine double")
    near = near.groupBy("cls", "other").agg(F.max("cosine").alias("cosine"))
    near = near.withColumn("r", F.expr("row_number() OVER (PARTITION BY cls ORDER BY cosine DESC, other)")).where(F.col("r") <= k)
    ids = reps.select(F.col("cls").alias("other"), "ids")
    lists = near.join(ids, "other").groupBy("cls").agg(F.collect_list(F.struct("cosine", "ids")).alias("near"))
    own = reps.select("cls", "ids").join(lists, "cls", "left")
    member = rows.select("id", "cls").distinct().join(own, "cls")
    flat = (
        "concat(transform(ids, x -> struct(-2D AS minus, x AS id)), "
        "flatten(transform(coalesce(near, array()), y -> transform(y.ids, x -> struct(-y.cosine AS minus, x AS id)))))"
    )  # copies of the vector itself come first
    best = F.expr(f"transform(slice(array_sort(filter({flat}, z -> z.id <> id)), 1, {k}), z -> struct(least(-z.minus, 1D) AS cosine, z.id AS id))")
    return member.select("id", best.alias("others"))


def found(df: DataFrame) -> DataFrame:
    e = neighbours(df).select("id", F.explode("others").alias("o"))
    return e.select(F.least("id", "o.id").alias("vector_row_a"), F.greatest("id", "o.id").alias("vector_row_b")).distinct()
