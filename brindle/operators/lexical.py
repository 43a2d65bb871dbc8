"""Inverted index and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import words
from brindle.operators.ranking import top_k
from brindle.session import spread

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term, tf): one row a document and term; term is null for a document without words, so that
    corpus statistics come from the same rows."""
    d = spread(docs.select(key, text)).select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("length", F.size("w"))
    each = d.select(key, "length", F.explode_outer("w").alias("term"))
    return each.groupBy(key, "length", "term").agg(F.count("term").alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents and their mean length in words, over all rows."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(words(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", eligible: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score) of every document that has a term of the query; queries: (query_id, terms array).

    Statistics come from all documents; only then are the eligible ones kept, so that a filter changes no score. The
    documents are read twice, once for the means and once for terms, and only the queries' terms are counted: the term
    list is joined to the documents' words before anything is shuffled. Scores are rounded to nine places, so that equal
    ones tie in whatever order they were summed."""
    docs = spread(docs.select(key, text))
    n_docs, avgdl = corpus_stats(docs, text).first()
    q = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    d = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    tf = d.join(q.select("term").distinct(), "term", "left_semi").groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if eligible is not None:
        tf = tf.join(eligible.select(key).distinct(), key, "left_semi")
    s = tf.join(df, "term")
    idf = F.ln((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avgdl or 1.0))))
    return s.select(key, "term", part.alias("part")).join(q, "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score"))


def overlap_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", eligible: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score) by the number of common terms less two (M06), of every document that shares one."""
    if eligible is not None:
        docs = docs.join(eligible.select(key).distinct(), key, "left_semi")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct("terms")).alias("term"))
    d = spread(docs.select(key, text)).select(key, F.explode(F.array_distinct(words(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    return d.join(q, "term").groupBy("query_id", key).agg((F.count("*") - 2).cast("double").alias("score"))


#: Query terms (over all queries) that are held in every task at most; more queries go through bm25().
MAX_QUERY_TERMS = 2_000_000


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", eligible: DataFrame | None = None, overlap: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query of a stated set, as bm25() and a top k; with
    overlap by the number of common terms less two (M06) instead.

    The set is held in every task as a term by query matrix, documents come in blocks, and of each block only its k
    best a query go on: the shuffle has k rows for each query and block, however many documents share common terms.
    Documents keep their order of keys within a block; ties go to the smaller key. Queries beyond MAX_QUERY_TERMS are
    scored by the join instead."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct("terms")).alias("term"))
    held = q.limit(MAX_QUERY_TERMS + 1).collect()
    if len(held) > MAX_QUERY_TERMS:
        scored = overlap_scores(docs, queries, key, text, eligible) if overlap else bm25(docs, queries, key, text, eligible)
        return top_k(scored, k, "score", key)
    spark = docs.sparkSession
    terms = {t: i for i, t in enumerate(sorted({r.term for r in held}))}
    ids = {x: i for i, x in enumerate(sorted({r.query_id for r in held}))}
    src = spread(docs.select(key, text)).select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    wanted = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, df, n, length = wanted.value, np.zeros(len(wanted.value), np.int64), 0, 0
        for b in batches:
            for w in b.column(0).to_pylist():
                n, length = n + 1, length + len(w)
                for i in {index[x] for x in w if x in index}:
                    df[i] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2]), pa.array([*df[at].tolist(), n, length])], names=["i", "n"])

    stats = {} if overlap else {r.i: r.n for r in src.select("w").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n_docs, total = stats.pop(-1, 0), stats.pop(-2, 0)
    df = np.array([stats.get(i, 0) for i in range(len(terms))], np.float64)
    idf = np.log((n_docs - df + 0.5) / (df + 0.5))
    idf = np.where(idf > 0, idf, LEAST_IDF)
    ready = spark.sparkContext.broadcast((terms, [(terms[r.term], ids[r.query_id]) for r in held], np.array(sorted(ids), np.int64), idf, total / max(n_docs, 1) or 1.0))
    kind = dict(src.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, pairs, qid, idf, avgdl = ready.value
        by_term: list[list[int]] = [[] for _ in index]
        for t, x in pairs:
            by_term[t].append(x)
        member = [np.array(x, np.int64) for x in by_term]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                s = np.zeros((b.num_rows, len(qid)))
                hit = np.zeros(s.shape, bool)
                for d, w in enumerate(b.column(1).to_pylist()):
                    tf: dict[int, int] = {}
                    for x in w:
                        i = index.get(x)
                        if i is not None:
                            tf[i] = tf.get(i, 0) + 1
                    norm = K1 * (1 - B + B * len(w) / avgdl)
                    for i, f in tf.items():
                        s[d, member[i]] += 1 if overlap else idf[i] * (f * (K1 + 1)) / (f + norm)
                        hit[d, member[i]] = True
                s = s - 2 if overlap else np.round(s, 9)
                keys = b.column(0)
                order = np.argsort(np.array(keys.to_pylist(), object), kind="stable")
                rows, cols = [], []
                for x in range(len(qid)):
                    some = order[hit[order, x]]
                    best = some[np.argsort(-s[some, x], kind="stable")[:k]]
                    rows.append(best), cols.append(np.full(len(best), x))
                r = np.concatenate(rows) if rows else np.empty(0, np.int64)
                c = np.concatenate(cols) if cols else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(qid[c]), keys.take(pa.array(r)), pa.array(s[r, c])], names=["query_id", key, "score"])

    use = src if eligible is None else src.join(eligible.select(key).distinct(), key, "left_semi")
    return top_k(use.mapInArrow(score, f"query_id long, {key} {kind}, score double"), k, "score", key)
