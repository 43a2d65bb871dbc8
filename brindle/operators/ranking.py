"""Top-k, fusion, reranking and selection of evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.corpus import components
from brindle.session import written

RRF_K = 60


def top_k(df: DataFrame, k: int, by: str, key: str, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, best score first, ties by the smaller key."""
    w = Window.partitionBy(group).orderBy(F.desc(by), F.asc(key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense_top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query of a stated set: blocks of vectors against the whole query matrix, k
    best of each block kept, then merged; what is shuffled is k rows a query and block. Scores are rounded to nine
    places, so that equal ones tie, and ties go to the smaller key. Keys are numbers or strings; a null one takes no
    part."""
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), len(queries[0][1]) if queries else 0)
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    kind = "string" if dict(vectors.dtypes)[key] == "string" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = held.value
        for b in batches:
            keys = np.array(b.column(0).to_pylist())
            s = np.round(q @ b.column(1).flatten().to_numpy().reshape(len(keys), -1).astype(np.float64).T, 9)
            rows, cols = [], []
            for i in range(len(q)):
                best = np.lexsort((keys, -s[i]))[:k]
                rows.append(np.full(len(best), i)), cols.append(best)
            if rows:
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(keys[c].tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(s[r, c])], names=["query_id", key, "score"])

    dim = matrix.shape[1]
    src = vectors.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()) & F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key), F.col(vector).cast("array<double>").alias(vector))
    return top_k(src.mapInArrow(run, f"query_id long, {key} {kind}, score double"), k, "score", key)


def rrf(branches: list[DataFrame], key: str, k: int = 30) -> DataFrame:
    """Reciprocal rank fusion. Each branch (query_id, key, score, higher is better) is reduced to its
    best row a key, ranked anew from 1, and 1 / (60 + rank) is summed."""
    ranked = []
    for b in branches:
        one = b.groupBy("query_id", key).agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
        ranked.append(one.select("query_id", key, F.row_number().over(w).alias("r")))
    u = ranked[0]
    for r in ranked[1:]:
        u = u.unionByName(r)
    s = u.groupBy("query_id", key).agg(F.sum(1 / (RRF_K + F.col("r"))).alias("score"))
    return top_k(s, k, "score", key)


def overlap_score(query_terms: Column, doc_terms: Column) -> Column:
    """Common distinct terms less two."""
    return F.size(F.array_intersect(query_terms, doc_terms)) - 2


def _overlap(a: list, b: list) -> float:
    """Shared length of two span lists over the shorter one's length."""
    def total(s: list) -> int:
        return sum(max(0, y - x) for _, x, y in s)

    shared = sum(max(0, min(y, v) - max(x, u)) for i, x, y in a for j, u, v in b if i == j)
    least = min(total(a), total(b))
    return shared / least if least else 0.0


def _settle(ids: list, records: dict, most: int) -> tuple[list, dict] | None:
    """The conflict fixpoint of one query. ids: kept passages in rank order; records: conflict -> (approved, sides).
    Selected passages and the conflicts they touch; None if a conflict is not approved, has a single side or one
    without kept passage, or if all sides together need more than `most` places."""
    place, chosen, relevant = {p: i for i, p in enumerate(ids)}, ids[:most], {}
    while True:
        new = {c: sides for c, (approved, sides) in records.items() if c not in relevant and any(p in chosen for s in sides for p in s)}
        if any(not records[c][0] or len(sides) < 2 or any(not any(p in place for p in s) for s in sides) for c, sides in new.items()):
            return None
        relevant |= new
        required = {min((p for p in s if p in place), key=place.get) for sides in relevant.values() for s in sides}
        if len(required) > most:
            return None
        others = [p for p in ids if p not in required][: most - len(required)]
        now = sorted([*required, *others], key=place.get)
        if now == chosen and not new:
            return chosen, relevant
        chosen = now


def select_evidence(candidates: DataFrame, threshold: float, most: int = 5, overlap: float = 0.8, conflicts: DataFrame | None = None) -> DataFrame:
    """(query_id, passage_id, place, logit, conflicts, error), the selection of each query. candidates: query_id,
    passage_id, source, section, text_sha, spans (array of (block, start, end)), logit, rrf. At or above the threshold,
    in the order (-logit, -rrf, id), a candidate is left out if a kept one of its source has the same text, or the same
    section and enough shared span.

    conflicts: (conflict_id, side, passage_id, approved), the registered conflicts, a row for each member. A conflict
    with a selected member brings in the best kept passage of every side, and so on until nothing changes; a query where
    that cannot be done has one row without passage, with the error CONFLICT_EVIDENCE_INCOMPLETE.

    Queries have a few dozen candidates each; the order matters, so each query is one group."""
    if threshold is None:
        raise ValueError("a threshold is needed; there is no default of zero")
    names = ["query_id", "passage_id", "place", "logit", "conflicts", "error"]

    def pick(g: pd.DataFrame, c: pd.DataFrame | None = None) -> pd.DataFrame:
        g = g[g.logit >= threshold].sort_values(["logit", "rrf", "passage_id"], ascending=[False, False, True])
        kept: list = []
        for r in g.itertuples():
            spans = [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in (r.spans if r.spans is not None else [])]
            for k, ks in kept:
                if k.source == r.source and (k.text_sha == r.text_sha or k.section == r.section and _overlap(ks, spans) >= overlap):
                    break
            else:
                kept.append((r, spans))
        records = {}
        for cid, m in c.groupby("conflict_id") if c is not None else ():
            records[cid] = (all(x is True or x == 1 for x in m.approved), [list(s.passage_id) for _, s in m.groupby("side")])
        by_id = {r.passage_id: r for r, _ in kept}
        settled = _settle(list(by_id), records, most)
        if settled is None:
            return pd.DataFrame([(kept[0][0].query_id, None, None, None, None, "CONFLICT_EVIDENCE_INCOMPLETE")], columns=names)
        chosen, relevant = settled
        own = lambda p: sorted(x for x, sides in relevant.items() if any(p in s for s in sides))
        return pd.DataFrame([(by_id[p].query_id, p, i + 1, by_id[p].logit, own(p), None) for i, p in enumerate(chosen)], columns=names)

    schema = f"query_id long, passage_id {dict(candidates.dtypes)['passage_id']}, place int, logit double, conflicts array<string>, error string"
    if conflicts is None:
        return candidates.groupBy("query_id").applyInPandas(lambda g: pick(g), schema)
    c = conflicts.select(F.col("conflict_id").cast("string").alias("conflict_id"), "side", "passage_id", "approved")
    near = candidates.select("query_id", "passage_id").join(c, "passage_id").select("query_id", "conflict_id").distinct()
    sides = near.join(c, "conflict_id").select(F.col("query_id").alias("q"), "conflict_id", "side", "passage_id", "approved")
    return candidates.groupBy("query_id").cogroup(sides.groupBy("q")).applyInPandas(lambda g, c: pick(g, c), schema)


def conflict_step(selected: DataFrame, records: DataFrame) -> DataFrame:
    """J05, one round: selected (query_id, passage_id) and the members of every record (record_id, passage_id) that has
    a selected member, each once.

    A passage that many queries select stands in many records, so a row for each query and record would be many times
    the result. The queries of a passage or record are therefore a set of bits, a row for each block of 128 query ids
    (ids that are not whole numbers, and null, have a block each), which the rounds join by `or`."""
    q = F.col("query_id")
    whole = dict(selected.dtypes)["query_id"] in ("tinyint", "smallint", "int", "bigint")
    block, bit = (F.shiftright(q.cast("long"), 7), F.coalesce(q.cast("long").bitwiseAND(127), F.lit(0)).cast("int")) if whole else (q, F.lit(0))
    masks = [F.bit_or(m).alias(m) for m in ("low", "high")]
    one = lambda least: F.when(F.col("bit").between(least, least + 63), F.expr(f"shiftleft(1L, bit - {least})")).otherwise(0)
    held = selected.select("passage_id", block.alias("block"), bit.alias("bit")).select("passage_id", "block", one(0).alias("low"), one(64).alias("high")).groupBy("passage_id", "block").agg(*masks)
    r = records.select("record_id", "passage_id")
    touched = held.join(r, "passage_id").groupBy("record_id", "block").agg(*masks)
    drawn = touched.join(r, "record_id").select("passage_id", "block", "low", "high")
    out = held.unionByName(drawn).groupBy("passage_id", "block").agg(*masks)
    bits = F.expr("filter(sequence(0, 127), i -> getbit(if(i < 64, low, high), i % 64) = 1)")
    out = out.select("block", "passage_id", F.explode(bits).alias("bit"))
    return out.select((F.shiftleft("block", 7) + F.col("bit")).cast(selected.schema["query_id"].dataType).alias("query_id") if whole else F.col("block").alias("query_id"), "passage_id")


def conflict_closure(selected: DataFrame, records: DataFrame) -> DataFrame:
    """Passages that records of conflicting sides draw in. selected: (query_id, passage_id); records: (record_id,
    passage_id). A record with a selected member brings in all its members, and so on until nothing changes.

    What a passage draws in, directly or not, is its component in the graph of records and passages, which is the same
    for every query: components() finds it once, with an error if it does not settle, and each query takes the
    components that it touches. A selected passage without records stands for itself."""
    r = records.where("record_id IS NOT NULL AND passage_id IS NOT NULL")
    mark = lambda c, t: F.concat(F.lit(f"{t}:"), F.col(c).cast("string"))
    of = components(r.select(mark("passage_id", "p").alias("u"), mark("record_id", "r").alias("v")))
    member = written(r.select("passage_id").distinct().join(of.where("startswith(node, 'p:')").select("node", "root"), mark("passage_id", "p") == F.col("node")).select("passage_id", "root"))
    now = selected.select("query_id", "passage_id").distinct()
    touched = now.join(member, "passage_id").select("query_id", "root").distinct()
    return touched.join(member, "root").select("query_id", "passage_id").unionByName(now.join(member.select("passage_id"), "passage_id", "left_anti").select("query_id", "passage_id"))


def reuse_vectors(queries: DataFrame, stored: DataFrame, identity: list[str], text: str, vector: str) -> DataFrame:
    """Queries with the stored vector where every identity field and the text's digest are equal, else null (to be
    encoded anew). stored: identity, text_sha256, vector; a text stored twice keeps one of its equal vectors."""
    s = stored.select(*identity, F.col("text_sha256").alias("_sha"), F.col(vector)).dropDuplicates([*identity, "_sha"])
    return queries.withColumn("_sha", F.sha2(text, 256)).join(s, [*identity, "_sha"], "left").drop("_sha")
