"""Evaluation measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import metrics, vector
from brindle.operators import ranking
from brindle.plans.registry import query
from brindle.session import table

#: A derived probability and label over documents and labels: deterministic, for the measures' sake.
SCORED = """
    s AS (SELECT l.doc_id, l.toxic::BIGINT AS y, ((l.doc_id * 7919) % 1000) / 1000::DOUBLE AS p, d.source, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL)"""


def _scored(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels").where("toxic IS NOT NULL")
    d = table(spark, sf, "documents").select("doc_id", "source")
    return lab.join(d, "doc_id").select("doc_id", F.col("toxic").cast("long").alias("y"), ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("p"), "source", "quality")


WILSON = "greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0)"
WILSON_HI = "least((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1)"


@query(f"""
    WITH {SCORED}, g AS (SELECT source, count(*)::DOUBLE AS n, sum(y) / count(*)::DOUBLE AS p, 1.959963984540054 AS z FROM s GROUP BY source)
    SELECT source, CAST(n AS BIGINT) AS n, round({WILSON}, 6) AS low, round({WILSON_HI}, 6) AS high FROM g""")
def wilson(spark, sf):
    g = _scored(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    lo, hi = metrics.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("source", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query(f"""
    WITH {SCORED}, g AS (SELECT quality, count(*)::DOUBLE AS n, count(*) FILTER (p >= 0.5) AS k, count(*) FILTER (p >= 0.5) / count(*)::DOUBLE AS p, 1.96 AS z FROM s WHERE y = 1 GROUP BY quality)
    SELECT quality::BIGINT AS quality, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(p, 4) AS recall, round({WILSON}, 4) AS low, round({WILSON_HI}, 4) AS high FROM g""")
def recall_report(spark, sf):
    """A06"""
    g = _scored(spark, sf).where("y = 1").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.5).alias("k"))
    lo, hi = metrics.wilson(F.col("k").cast("double"), F.col("n").cast("double"), 1.96)
    return g.select(F.col("quality").cast("long").alias("quality"), "n", "k", F.round(F.col("k") / F.col("n"), 4).alias("recall"), F.round(lo, 4).alias("low"), F.round(hi, 4).alias("high"))


@query("SELECT source, count(*) AS n, round(1 - pow(0.05, 1::DOUBLE / count(*)), 6) AS bound FROM documents GROUP BY source")
def zero_miss(spark, sf):
    """A10"""
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", "n", F.round(metrics.zero_miss_bound(F.col("n")), 6).alias("bound"))


BIN_SQL = " + ".join(f"(p >= {e!r}::DOUBLE)::BIGINT" for e in metrics.EDGES)


@query(f"""
    WITH {SCORED}, b AS (SELECT {BIN_SQL} AS bin, count(*) AS n, avg(p) AS c, avg(y::DOUBLE) AS a FROM s GROUP BY 1)
    SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS share, round(abs(c - a) * n / (SELECT sum(n) FROM b), 6) AS error FROM b""")
def ece(spark, sf):
    c = metrics.calibration(_scored(spark, sf), "p", "y")
    return c.select("bin", "n", *(F.round(x, 6).alias(x) for x in ("confidence", "share", "error")))


@query(f"WITH {SCORED} SELECT source, round(avg((p - y) ** 2), 6) AS brier FROM s GROUP BY source")
def brier(spark, sf):
    return _scored(spark, sf).groupBy("source").agg(F.round(metrics.brier(F.col("p"), F.col("y")), 6).alias("brier"))


@query("""
    WITH s AS (SELECT quality::BIGINT AS t, (1 + (doc_id * 31) % 5)::BIGINT AS g FROM labels WHERE quality IS NOT NULL),
    l AS (SELECT DISTINCT t AS label FROM s UNION SELECT DISTINCT g FROM s),
    c AS (SELECT label, count(*) FILTER (t = label AND g = label) AS h, count(*) FILTER (t = label) AS t, count(*) FILTER (g = label) AS g FROM l CROSS JOIN s GROUP BY label)
    SELECT label, round(coalesce(h / nullif(g, 0), 0), 6) AS precision, round(coalesce(h / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(t + g, 0), 0), 6) AS f1 FROM c""")
def macro_f1(spark, sf):
    s = table(spark, sf, "labels").where("quality IS NOT NULL").select(F.col("quality").cast("long").alias("t"), (1 + (F.col("doc_id") * 31) % 5).cast("long").alias("g"))
    c = metrics.class_scores(s, "t", "g")
    return c.select("label", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"""
    WITH {SCORED} SELECT source, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, CAST(count(*) FILTER (y = 1 AND p < 0.5) AS BIGINT) AS misses,
      round(coalesce(count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (p >= 0.5), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (y = 0 AND p >= 0.5) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS false_refusal FROM s GROUP BY source""")
def risk_report(spark, sf):
    """A19"""
    y, hit = F.col("y") == 1, F.col("p") >= 0.5
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0)), 6)
    return _scored(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.round(metrics.brier(F.col("p"), F.col("y")), 6).alias("brier"), F.count_if(y & ~hit).alias("misses"), share(y & hit, hit).alias("precision"), share(~y & hit, ~y).alias("false_refusal")
    )


GRID = "SELECT (i + 2) / 100::DOUBLE AS t FROM range(97) r(i)"


def _swept(spark, sf) -> DataFrame:
    """Counts for each threshold of the grid. The scores are first counted by value, so that what meets the grid is no
    more than the distinct values."""
    h = _scored(spark, sf).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = spark.range(97).select(((F.col("id") + 2) / 100.0).alias("t"))
    hit = F.col("p") >= F.col("t")
    return h.join(F.broadcast(grid)).groupBy("t").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@query(f"""
    WITH {SCORED}, g AS ({GRID})
    SELECT t, CAST(count(*) FILTER (y = 1 AND p >= t) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND p >= t) AS BIGINT) AS fp, round(count(*) FILTER (y = 1 AND p >= t) / count(*) FILTER (y = 1), 6) AS recall FROM g CROSS JOIN s GROUP BY t""")
def threshold_sweep(spark, sf):
    return _swept(spark, sf).select("t", "tp", "fp", F.round(F.col("tp") / F.col("pos"), 6).alias("recall"))


@query(f"""
    WITH {SCORED}, g AS ({GRID}), r AS (SELECT t, count(*) FILTER (y = 1 AND p >= t) / count(*) FILTER (y = 1) AS recall FROM g CROSS JOIN s GROUP BY t)
    SELECT max(t) AS block, max(t) / 2 AS uncertain FROM r WHERE recall >= 0.8""")
def choose_threshold(spark, sf):
    """The highest threshold that keeps the recall."""
    return _swept(spark, sf).where(F.col("tp") / F.col("pos") >= 0.8).agg(F.max("t").alias("block"), (F.max("t") / 2).alias("uncertain"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS v, label AS l FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, l, vec_id, label, list_sum(list_transform(list_zip(v, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings CROSS JOIN q WHERE vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s),
    k AS (SELECT query_id, count(*) FILTER (label = l) AS hits FROM r WHERE rank <= 5 GROUP BY query_id)
    SELECT count(*) AS queries, round(avg((hits > 0)::BIGINT), 6) AS hit_at_5, round(avg(hits / 5), 6) AS precision_at_5 FROM k""")
def retrieval_eval(spark, sf):
    """Queries are the vectors whose id is divisible by 100, against all."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("l"))
    held = [(r.query_id, r.q) for r in q.collect()]  # the stated query set
    s = ranking.dense_top_k(e, held, 6).where("vec_id <> query_id").drop("rank")  # six, as one may be the query itself
    top = ranking.top_k(s, 5, "score", "vec_id").join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "l"), "query_id")
    h = top.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("l")).alias("hits"))
    return h.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("long")), 6).alias("hit_at_5"), F.round(F.avg(F.col("hits") / 5), 6).alias("precision_at_5"))


@query()
def group_bootstrap(spark, sf, rounds: int = 2000):
    """Whole groups drawn with replacement, a percentile interval of the mean. Draws come from hashes of round and
    place, so that the result is the same on every cluster; only group totals are resampled."""
    g = table(spark, sf, "events").where("value IS NOT NULL").groupBy("event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    g = g.agg(F.array_sort(F.collect_list(F.struct("event_type", "s", "n"))).alias("gs"))  # event types are few
    draws = spark.range(rounds).crossJoin(F.broadcast(g))  # g is one row
    pick = F.transform(F.sequence(F.lit(1), F.size("gs")), lambda i: F.element_at("gs", (F.pmod(F.xxhash64("id", i), F.size("gs").cast("long")) + 1).cast("int")))
    d = draws.select(pick.alias("x")).select((F.aggregate("x", F.lit(0.0), lambda a, b: a + b["s"]) / F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b["n"])).alias("mean"))
    return d.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.count("*").alias("rounds"))


W = [round(0.05 * (i % 7) - 0.1, 2) for i in range(64)]
DOT = "list_sum(list_transform(list_zip(embedding, [" + ", ".join(map(repr, W)) + "]::DOUBLE[]), lambda p: p[1]::DOUBLE * p[2]))"


@query(f"SELECT vec_id, round(1 / (1 + exp(-1.5 * ({DOT} + 0.1) + 0.2)), 6) AS p FROM embeddings")
def calibrated_head(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vector.calibrated(F.col("embedding"), W, 0.1, -1.5, 0.2), 6).alias("p"))


@query("""
    WITH z AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS z FROM embeddings), m AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)
    SELECT vec_id, round(e[1] / list_sum(e), 6) AS a, round(e[2] / list_sum(e), 6) AS b, round(e[3] / list_sum(e), 6) AS c FROM m""")
def softmax(spark, sf):
    z = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("z"))
    s = z.select("vec_id", vector.softmax(F.col("z")).alias("s"))
    return s.select("vec_id", *(F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate("abc")))


@query("""
    SELECT vec_id, CASE WHEN abs(embedding[2]) >= 0.2 THEN 'contradicted' WHEN abs(embedding[1]) >= 0.15 THEN 'supported' WHEN abs(embedding[1]) < 0.05 THEN 'unsupported' ELSE 'uncertain' END AS label FROM embeddings""")
def pair_label(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", vector.pair_label(F.abs(F.col("embedding")[0]), F.abs(F.col("embedding")[1]), 0.15, 0.05, 0.2).alias("label"))


@query("""
    SELECT passage_id, CASE WHEN contains(lower(text), lower(string_split(heading, ' > ')[-1])) THEN 'entailed' ELSE 'neutral' END AS label FROM passages""")
def substring_nli(spark, sf):
    """Containment of the normalised text."""
    h = F.element_at(F.split("heading", " > "), -1)
    return table(spark, sf, "passages").select("passage_id", F.when(F.contains(F.lower("text"), F.lower(h)), "entailed").otherwise("neutral").alias("label"))


@query("""
    WITH g AS (SELECT doc_kind, source, avg(n_chars) / 1000 AS s FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY round(s, 9) DESC, source) AS r FROM g WHERE s >= 0.5)
    SELECT doc_kind, source, round(s, 6) AS score, r AS rank FROM r WHERE r <= 3""")
def preferred_libs(spark, sf):
    """T05"""
    g = table(spark, sf, "documents").groupBy("doc_kind", "source").agg(F.round(F.avg("n_chars") / 1000, 9).alias("score")).where("score >= 0.5")
    t = ranking.top_k(g, 3, "score", "source", "doc_kind")
    return t.select("doc_kind", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
