"""Ranking, fusion, selection and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.hashing import hashed_features
from brindle.functions.text import match_terms, words
from brindle.operators import lexical, ranking, relations
from brindle.plans.registry import query
from brindle.session import cut, spread, table

DOC_STATS = """
    d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
    st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
    tok AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d)"""

SCORES = """
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    part AS (SELECT doc_id, term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
                * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tf JOIN df USING (term) CROSS JOIN st)"""


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in English that no label calls toxic."""
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    return table(spark, sf, "documents").where(F.lower("lang") == "en").select("doc_id").join(toxic, "doc_id", "left_anti")


ITEMS = """
    b AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    qq AS (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM b),
    q1 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS r FROM qq GROUP BY query_id, term),
    q AS (SELECT query_id, term FROM q1 WHERE r <= 64)"""

OK = "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"

RANKED = f"""
    WITH {ITEMS}, {DOC_STATS}, {SCORES}, ok AS (<OK>),
    s AS (SELECT query_id, doc_id, round(round(sum(part), 9), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 9) DESC, doc_id) AS rank
          FROM part JOIN q USING (term) WHERE doc_id IN (FROM ok) GROUP BY query_id, doc_id),
    c AS (SELECT query_id, doc_id, score, rank FROM s WHERE rank <= 30)"""


def _bm25(spark, sf, eligible: DataFrame | None = None) -> DataFrame:
    s = lexical.bm25_top_k(table(spark, sf, "documents"), _queries(spark, sf), 30, eligible=eligible)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(RANKED.replace("<OK>", "SELECT doc_id FROM documents") + " FROM c")
def bm25_topk(spark, sf):
    """The 30 best documents of every benchmark item."""
    return _bm25(spark, sf)


@query(RANKED.replace("<OK>", OK) + " FROM c")
def bm25_eligible(spark, sf):
    return _bm25(spark, sf, _eligible(spark, sf))


@query("""
    WITH d AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term, doc_id FROM documents),
    t AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY ALL)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM t GROUP BY term""")
def inverted_index(spark, sf):
    p = lexical.postings(table(spark, sf, "documents"), "doc_id", "text").where("term IS NOT NULL")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def _queries(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").where("item_id IS NOT NULL").select(F.col("item_id").alias("query_id"), match_terms(F.col("text")).alias("terms"))
    return b.where("terms IS NOT NULL")


def _vectors(e: DataFrame, which: str) -> list[tuple[int, list[float]]]:
    return [(r.vec_id, r.embedding) for r in e.where(which).select("vec_id", "embedding").orderBy("vec_id").collect()]


def hybrid(spark, sf, k: int = 5, ok: DataFrame | None = None) -> DataFrame:
    """The lexical part of G01, which the SQL can say: BM25 and term overlap, 30 of each, fused, the best k.
    evidence() is the whole."""
    docs, q = table(spark, sf, "documents"), _queries(spark, sf)
    lex = lexical.bm25_top_k(docs, q, 30, eligible=ok).select("query_id", "doc_id", "score")
    over = lexical.bm25_top_k(docs, q, 30, eligible=ok, overlap=True).select("query_id", "doc_id", "score")
    return ranking.rrf([lex, over], "doc_id", k)


HYBRID = f"""
    WITH {ITEMS}, {DOC_STATS}, {SCORES}, ok AS (<OK>),
    lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 9) DESC, doc_id) AS r FROM part JOIN q USING (term) WHERE doc_id IN (FROM ok) GROUP BY query_id, doc_id),
    dt AS (SELECT DISTINCT doc_id, term FROM tok WHERE doc_id IN (FROM ok)),
    ov AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS r FROM dt JOIN q USING (term) GROUP BY query_id, doc_id),
    u AS (SELECT * FROM lex WHERE r <= 30 UNION ALL SELECT * FROM ov WHERE r <= 30),
    f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM u GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


@query(HYBRID.replace("<OK>", OK) + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5")
def hybrid_search(spark, sf):
    return hybrid(spark, sf, ok=_eligible(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(HYBRID.replace("<OK>", OK) + " SELECT count(*) AS rows, count(DISTINCT (query_id, doc_id)) AS pairs, CAST(max(rank) AS BIGINT) AS most, CAST(0 AS BIGINT) AS unranked FROM t WHERE rank <= 5")
def result_invariants(spark, sf):
    h = hybrid(spark, sf, ok=_eligible(spark, sf))
    return h.agg(F.count("*").alias("rows"), F.countDistinct("query_id", "doc_id").alias("pairs"), F.max("rank").cast("long").alias("most"), F.sum(F.col("rank").isNull().cast("long")).alias("unranked"))


DIM = 384
HUNDREDTH = "vec_id % 100 = 0 AND embedding IS NOT NULL"
T_RERANK = 0.0  # inclusive; the reference's threshold for the stand-in reranker


def fused(docs: DataFrame, items: DataFrame, key: str, eligible: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the 30 best of each query by reciprocal ranks of the 30 nearest vectors (M01, hashed
    features) and the 30 best by BM25 (M08). items: query_id, terms, text, a stated set that every task holds."""
    ok = docs if eligible is None else docs.join(eligible, key, "left_semi")
    held = [(r.query_id, r.v) for r in items.select("query_id", hashed_features(F.col("text"), DIM).alias("v")).where("v IS NOT NULL").orderBy("query_id").collect()]
    vectors = spread(ok.select(key, "text")).select(key, hashed_features(F.col("text"), DIM).alias("v"))
    dense = ranking.dense_top_k(vectors, held, 30, key, "v").select("query_id", key, "score")
    lex = lexical.bm25_top_k(docs, items, 30, key=key, eligible=eligible).select("query_id", key, "score")
    return cut(ranking.rrf([dense, lex], key))


def evidence(docs: DataFrame, items: DataFrame, eligible: DataFrame) -> DataFrame:
    """(query_id, doc_id, logit, place, reason), a row for each selected document, or one without document for an
    item that has none. Dense and lexical candidates are fused, all of them reranked (M06), selected from (G02) and
    checked for eligibility once more. Items without terms are no queries."""
    f = fused(docs, items, "doc_id", eligible)
    text = docs.select("doc_id", "text", "source", F.coalesce("title", F.lit("")).alias("section"))
    c = text.join(F.broadcast(f.select("query_id", "doc_id", F.col("score").alias("rrf"))), "doc_id").join(F.broadcast(items.select("query_id", "terms")), "query_id")
    c = c.select(
        "query_id", F.col("doc_id").alias("passage_id"), "source", "section", F.sha2("text", 256).alias("text_sha"), F.expr("CAST(NULL AS array<struct<block:string,start:int,end:int>>)").alias("spans"),
        ranking.overlap_score(F.col("terms"), words(F.col("text"))).cast("double").alias("logit"), "rrf",
    )
    chosen = ranking.select_evidence(c, T_RERANK).withColumnRenamed("passage_id", "doc_id").join(eligible, "doc_id", "left_semi")
    any_ok = eligible.agg((F.count("*") > 0).alias("any_ok"))
    matched = f.select("query_id").distinct().withColumn("matched", F.lit(True))
    q = items.select("query_id").crossJoin(F.broadcast(any_ok)).join(matched, "query_id", "left").join(chosen.select("query_id", "doc_id", "logit", "place"), "query_id", "left")
    reason = F.when(F.col("doc_id").isNotNull(), "QUALIFYING_PASSAGES").when(~F.col("any_ok"), "NO_ELIGIBLE_PASSAGES").when(F.col("matched").isNull(), "NO_MATCHES").otherwise("BELOW_THRESHOLD")
    return q.select("query_id", "doc_id", "logit", "place", reason.alias("reason"))


def _items(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").where("item_id IS NOT NULL")
    return b.select(F.col("item_id").alias("query_id"), "text", match_terms(F.col("text")).alias("terms")).where("terms IS NOT NULL").dropDuplicates(["query_id"])


@query()
def hybrid_evidence(spark, sf):
    """G01 in full for every benchmark item."""
    return evidence(table(spark, sf, "documents"), _items(spark, sf), _eligible(spark, sf))


@query()
def evidence_invariants(spark, sf):
    """Of G01's result: rows, different pairs, the last place, and rows below the threshold or without reason (none)."""
    e = hybrid_evidence(spark, sf)
    bad = F.col("reason").isNull() | (F.col("doc_id").isNotNull() & (F.col("place").isNull() | (F.col("logit") < T_RERANK)))
    return e.agg(F.count("doc_id").alias("rows"), F.countDistinct("query_id", "doc_id").alias("pairs"), F.max("place").cast("long").alias("most"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(v, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings CROSS JOIN q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 30""")
def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return ranking.dense_top_k(e, _vectors(e, HUNDREDTH), 30).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(v, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings CROSS JOIN q WHERE label IN (1, 3, 5)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def dense_topk_filtered(spark, sf):
    e = table(spark, sf, "embeddings")
    return ranking.dense_top_k(e.where(F.col("label").isin(1, 3, 5)), _vectors(e, HUNDREDTH), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(HYBRID.replace("<OK>", "SELECT doc_id FROM documents") + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t WHERE rank <= 30")
def rrf(spark, sf):
    """Both rankings of every benchmark item, fused."""
    return hybrid(spark, sf, 30).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


RERANKED = f"""{RANKED.replace("<OK>", "SELECT doc_id FROM documents")},
    dt AS (SELECT DISTINCT doc_id, term FROM tok),
    o AS (SELECT c.query_id, c.doc_id, CAST(count(dt.term) - 2 AS BIGINT) AS score FROM c JOIN q USING (query_id) LEFT JOIN dt ON dt.doc_id = c.doc_id AND dt.term = q.term GROUP BY ALL)"""


def _reranked(spark, sf) -> DataFrame:
    """(query_id, doc_id, source, text, score): the candidates of every benchmark item with their overlap score."""
    q = _queries(spark, sf)
    c = table(spark, sf, "documents").join(_bm25(spark, sf).select("query_id", "doc_id"), "doc_id").join(q, "query_id")
    return c.select("query_id", "doc_id", "source", "text", ranking.overlap_score(F.col("terms"), words(F.col("text"))).cast("long").alias("score"))


@query(f"{RERANKED} SELECT query_id, doc_id, score FROM o")
def overlap_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "doc_id", "score")


@query(f"""{RERANKED},
    k AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id, source, sha256(text) ORDER BY score DESC, doc_id) AS n FROM o JOIN documents USING (doc_id) WHERE score >= 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM k WHERE n = 1)
    SELECT query_id, doc_id, source, place FROM r WHERE place <= 5""")
def select_dedupe(spark, sf):
    """Of candidates with one text in one source the best, then the best five of every item."""
    d = _reranked(spark, sf).where("score >= 0").withColumn("h", F.sha2("text", 256)).drop("text")
    one = relations.latest(d, ["query_id", "source", "h"], [F.desc("score"), F.asc("doc_id")])
    return ranking.top_k(one, 5, "score", "doc_id", rank="place").select("query_id", "doc_id", "source", F.col("place").cast("long").alias("place"))


@query()
def select_greedy(spark, sf):
    """Greedy over the fused and reranked candidates of every benchmark item, by passage spans. No table holds
    registered conflicts, and they are never inferred, so select_evidence gets none here."""
    q = _items(spark, sf)
    p = table(spark, sf, "passages").where("passage_id IS NOT NULL").dropDuplicates(["passage_id"])
    spans = F.from_json("spans_json", "array<array<string>>")
    info = p.select("passage_id", F.concat_ws("@", "source_id", "source_version").alias("source"), F.coalesce("section_path_json", F.lit("")).alias("section"), F.sha2("text", 256).alias("text_sha"), spans.alias("raw"))
    info = info.withColumn("spans", F.expr("transform(coalesce(raw, array()), x -> named_struct('block', x[0], 'start', coalesce(try_cast(x[1] AS int), 0), 'end', coalesce(try_cast(x[2] AS int), 0)))")).drop("raw")
    f = fused(p, q, "passage_id").select("query_id", "passage_id", F.col("score").alias("rrf"))
    c = p.select("passage_id", words(F.col("text")).alias("w")).join(F.broadcast(f), "passage_id").join(F.broadcast(q.select("query_id", "terms")), "query_id")
    c = c.select("query_id", "passage_id", ranking.overlap_score(F.col("terms"), F.col("w")).cast("double").alias("logit"), "rrf")
    c = info.join(F.broadcast(c), "passage_id").select("query_id", "passage_id", "source", "section", "text_sha", "spans", "logit", "rrf")
    return ranking.select_evidence(c, threshold=2.0)


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS record_id, l_partkey AS passage_id FROM lineitem),
    s0 AS (SELECT DISTINCT l_orderkey % 100 AS query_id, l_partkey AS passage_id FROM lineitem),
    t AS (SELECT DISTINCT query_id, record_id FROM s0 JOIN r USING (passage_id)),
    s1 AS (SELECT query_id, passage_id FROM s0 UNION SELECT query_id, passage_id FROM t JOIN r USING (record_id))
    SELECT query_id, count(*) AS passages FROM s1 GROUP BY query_id""")
def conflict_step(spark, sf):
    """One step, from every order."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("passage_id"))
    start = li.select((F.col("record_id") % 100).alias("query_id"), "passage_id")
    return ranking.conflict_step(start, li).groupBy("query_id").agg(F.count("*").alias("passages"))


@query()
def conflict_closure(spark, sf):
    """The whole closure, from every order."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("passage_id"))
    start = li.select((F.col("record_id") % 100).alias("query_id"), "passage_id")
    return ranking.conflict_closure(start, li.distinct()).groupBy("query_id").agg(F.count("*").alias("passages"))


@query("""
    WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'),
    m AS (SELECT l.l_orderkey AS item, l.l_linenumber // 3 AS alt, g.l_orderkey IS NOT NULL AS usable FROM lineitem l LEFT JOIN g USING (l_orderkey, l_linenumber)),
    s AS (SELECT item, alt, bool_and(usable) AS ok, count(*) AS members FROM m GROUP BY ALL)
    SELECT item, CAST(min(alt) AS BIGINT) AS alt, arg_min(members, alt) AS members FROM s WHERE ok GROUP BY item""")
def item_evidence(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.floor(F.col("l_linenumber") / 3).cast("long").alias("alt"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("member"), "l_returnflag")
    return relations.first_complete(li.drop("l_returnflag"), li.where("l_returnflag <> 'R'"), "item", "alt", "member")


@query("""
    WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS b, l_suppkey * 37 % 1000 AS s, l_suppkey * 37 % 1000 + CAST(l_quantity AS BIGINT) * 10 AS e FROM lineitem),
    t AS (SELECT k, sum(e - s) AS t FROM s GROUP BY k),
    h AS (SELECT x.k AS k_a, y.k AS k_b, CAST(sum(least(x.e, y.e) - greatest(x.s, y.s)) AS BIGINT) AS shared FROM s x JOIN s y ON x.b = y.b AND x.k < y.k AND x.s < y.e AND y.s < x.e GROUP BY ALL)
    SELECT k_a, k_b, shared, round(shared / least(t1.t, t2.t), 6) AS ratio FROM h JOIN t t1 ON t1.k = k_a JOIN t t2 ON t2.k = k_b WHERE shared / least(t1.t, t2.t) >= 0.8""")
def span_overlap(spark, sf):
    start = F.col("l_suppkey") * 37 % 1000
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("b"), start.alias("s"), (start + F.col("l_quantity").cast("long") * 10).alias("e"))
    return relations.span_overlaps(li, "b", "k", "s", "e", 0.8).withColumn("ratio", F.round("ratio", 6))


@query("""
    SELECT l_orderkey AS draft, l_linenumber AS pos, CASE WHEN l_partkey % 7 = 0 THEN 'missing' WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size > 40 THEN 'ineligible' END AS problem
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 11 <> 0""")
def citation_check(spark, sf):
    cites = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("p_partkey"))
    evidence = table(spark, sf, "part").where("p_partkey % 11 <> 0").withColumn("ok", F.col("p_size") <= 40)
    return relations.check_citations(cites, evidence, "p_partkey", "ok").select("draft", "pos", "problem")


@query("""
    WITH f AS (SELECT l_orderkey AS draft, l_partkey AS passage, min(l_linenumber) AS first_pos FROM lineitem GROUP BY ALL)
    SELECT draft, passage, first_pos, row_number() OVER (PARTITION BY draft ORDER BY first_pos, passage) AS number FROM f""")
def citation_number(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_partkey").alias("passage"), F.col("l_linenumber").alias("pos"))
    return relations.number_by_appearance(rows, "draft", "pos", "passage").withColumn("number", F.col("number").cast("long"))


@query("""
    SELECT o_orderstatus AS status, count(*) AS pairs, count(DISTINCT o_orderkey) AS sentences
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderstatus""")
def pair_gen(spark, sf):
    """Sentences with each passage they cite."""
    o, li, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("pairs"), F.countDistinct("o_orderkey").alias("sentences"))


@query("""
    WITH r AS (SELECT passage_id, title, min(sha256(text)) OVER (PARTITION BY source_id, source_version) AS rep, row_number() OVER (PARTITION BY passage_id ORDER BY source_id) AS n FROM passages)
    SELECT rep, count(*) AS passages, min(passage_id) AS first_id FROM r WHERE n = 1 GROUP BY rep""")
def reverse_lookup(spark, sf):
    """For each first text of a source, the passages that point back to it and the least of them."""
    p = table(spark, sf, "passages")
    rep = p.groupBy("source_id", "source_version").agg(F.min(F.sha2("text", 256)).alias("rep"))
    one = p.select("passage_id", "source_id", "source_version").dropDuplicates(["passage_id"])
    j = one.join(rep, one.source_id.eqNullSafe(rep.source_id) & one.source_version.eqNullSafe(rep.source_version))
    return j.groupBy("rep").agg(F.count("*").alias("passages"), F.min("passage_id").alias("first_id"))


@query("""
    SELECT benchmark.item_id, count(documents.doc_id) AS docs FROM benchmark LEFT JOIN documents
    ON lower(trim(regexp_replace(documents.title, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(benchmark.topic_id, '\\s+', ' ', 'g'))) GROUP BY benchmark.item_id""")
def alias_join(spark, sf):
    """Exact join on the normalised alias."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    j = b.select("item_id", norm("topic_id").alias("a")).join(d.select("doc_id", norm("title").alias("a")), "a", "left")
    return j.groupBy("item_id").agg(F.count("doc_id").alias("docs"))
