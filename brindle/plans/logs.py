"""Queries over logs: requests, events and orders."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from brindle.operators import events, relations
from brindle.plans.registry import query
from brindle.session import shared_folder, table
from brindle.sources import sinks


@query("""
    WITH l AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)
    SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l""")
def sessionize(spark, sf):
    return events.sessions(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "session")


@query("""
    WITH e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS ok FROM events),
    m AS (SELECT *, sum(1 - ok) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS misses FROM e),
    s AS (SELECT *, least(sum(ok) OVER (PARTITION BY user_id, event_type, misses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS streak FROM m)
    SELECT event_id, CAST(streak AS BIGINT) AS streak, ts + CASE WHEN ok = 0 THEN INTERVAL 10 MINUTES WHEN streak = 1 THEN INTERVAL 1 DAY WHEN streak = 2 THEN INTERVAL 3 DAYS ELSE INTERVAL 7 DAYS END AS due FROM s""")
def review_streak(spark, sf):
    s = events.streaks(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", F.coalesce(F.col("value") >= 50, F.lit(False)))
    return s.select("event_id", F.col("streak").cast("long").alias("streak"), "due")


@query("""
    WITH r AS (SELECT *, owner_code IS NOT NULL AND course_id IS NOT NULL AND idempotency_key IS NOT NULL AS has,
        row_number() OVER (PARTITION BY owner_code, course_id, idempotency_key ORDER BY created_at NULLS FIRST, request_id NULLS FIRST) AS n,
        first_value(body_fingerprint) OVER (PARTITION BY owner_code, course_id, idempotency_key ORDER BY created_at NULLS FIRST, request_id NULLS FIRST) AS body FROM (SELECT DISTINCT * FROM requests))
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT has OR n = 1 THEN 'first' WHEN body_fingerprint IS NOT DISTINCT FROM body THEN 'replay' ELSE 'conflict' END AS outcome FROM r) GROUP BY outcome""")
def idempotency(spark, sf):
    r = table(spark, sf, "requests").distinct()
    i = events.idempotency(r, ["owner_code", "course_id", "idempotency_key"], ["created_at", "request_id"], "body_fingerprint")
    return i.groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) >= 20 AS limited FROM events GROUP BY ALL")
def rate_limit(spark, sf):
    return events.daily_limit(table(spark, sf, "events"), "user_id", "ts", 20)


@query("""
    SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value >= 50) AS correct, round((1 + count(*) FILTER (value >= 50)) / (2 + count(*)), 6) AS indicator FROM events GROUP BY ALL""")
def practice(spark, sf):
    """A16"""
    ok = F.count(F.when(F.col("value") >= 50, 1))
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), ok.alias("correct"), F.round((1 + ok) / (2 + F.count("*")), 6).alias("indicator"))


@query("""
    WITH s AS (SELECT p_partkey, max(l_shipdate) AS seen FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_partkey)
    SELECT p_partkey AS item, coalesce(strftime(seen, '%Y-%m-%d'), '') AS due FROM s WHERE coalesce(seen, TIMESTAMP '1900-01-01') <= TIMESTAMP '1998-06-30' """)
def due_items(spark, sf):
    """Items by their due date; an item never seen is due now."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("seen"))
    j = table(spark, sf, "part").select("p_partkey").join(seen, "p_partkey", "left")
    j = j.where(F.coalesce("seen", F.lit("1900-01-01").cast("timestamp")) <= F.lit("1998-06-30").cast("timestamp"))
    return j.select(F.col("p_partkey").alias("item"), F.coalesce(F.date_format("seen", "yyyy-MM-dd"), F.lit("")).alias("due")).orderBy("due", "item")


@query()
def breaker(spark, sf):
    e = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return events.breaker(e, "user_id", "ts", "event_id", "failed")


@query("""
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_pct(spark, sf):
    """A11, T-18: linear and nearest-rank percentiles."""
    points = {"p50": (0.5, True), "p95": (0.95, True), "p99": (0.99, True), "p95_nearest": (0.95, False)}
    p = events.exact_percentiles(table(spark, sf, "events"), "event_type", "value", points)
    return p.select("event_type", *(F.round(x, 6).alias(x) for x in points))


@query("SELECT state, count(*) AS n, count(DISTINCT owner_code) AS owners FROM requests GROUP BY state")
def status_counts(spark, sf):
    return table(spark, sf, "requests").groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("owner_code").alias("owners"))


@query("""
    SELECT event_type, round(median(value), 6) AS median, round(avg(value), 4) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type""")
def throughput(spark, sf):
    """A15"""
    e = table(spark, sf, "events")
    middle = events.exact_percentiles(e, "event_type", "value", {"median": (0.5, True)}).select("event_type", F.round("median", 6).alias("median"))
    rest = e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 6).alias("most"))
    return rest.alias("r").join(middle.alias("m"), F.expr("r.event_type <=> m.event_type"), "left").select("r.event_type", "median", "mean", "most")


@query("""
    WITH s AS (SELECT o_custkey AS case_id, o_orderstatus AS status, o_orderkey AS run, (SELECT 1) AS one FROM orders),
    c AS (SELECT l_orderkey AS run, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS cites, count(*) AS sentences FROM lineitem GROUP BY l_orderkey)
    SELECT case_id, count(*) AS runs, count(DISTINCT status) AS statuses, count(DISTINCT cites) AS cite_sets, min(sentences) AS least, max(sentences) AS most FROM s JOIN c USING (run) GROUP BY case_id HAVING count(*) > 1""")
def consistency(spark, sf):
    """Runs of one case, compared."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("cites"), F.count("*").alias("sentences"))
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("run"))
    g = s.join(c, "run").groupBy("case_id")
    return g.agg(F.count("*").alias("runs"), F.countDistinct("status").alias("statuses"), F.countDistinct("cites").alias("cite_sets"), F.min("sentences").alias("least"), F.max("sentences").alias("most")).where("runs > 1")


@query("SELECT event_id, event_type, CAST(ts AS DATE) AS day, left(sha256('owner:' || user_id), 16) AS owner FROM events")
def audit_project(spark, sf):
    """The allowed columns only, the owner as a pseudonym."""
    allowed = ["event_id", "event_type", "day", "owner"]
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("owner", F.left(F.sha2(F.concat(F.lit("owner:"), F.col("user_id").cast("string")), 256), F.lit(16)))
    return e.select(*allowed)


@query("""
    SELECT owner_code, course_id, epoch_us(max(created_at)) AS last_us, arg_max(state, (created_at, request_id)) AS state FROM requests WHERE created_at IS NOT NULL AND owner_code IS NOT NULL AND course_id IS NOT NULL AND request_id IS NOT NULL AND state IS NOT NULL GROUP BY ALL""")
def upsert_state(spark, sf):
    """The last state of each owner and course."""
    r = table(spark, sf, "requests").where("created_at IS NOT NULL AND owner_code IS NOT NULL AND course_id IS NOT NULL AND request_id IS NOT NULL AND state IS NOT NULL")
    last = lambda x: relations.latest(x, ["owner_code", "course_id"], [F.desc("created_at"), F.desc("request_id"), F.desc("state")])
    before = F.col("created_at") < F.lit("2025-01-01").cast("timestamp")
    state = sinks.upsert(last(r.where(before)), last(r.where(~before)), ["owner_code", "course_id"])
    return state.select("owner_code", "course_id", F.unix_micros("created_at").alias("last_us"), "state")


@query("SELECT count(*) AS kept, (SELECT count(*) FROM requests) - count(*) AS removed FROM requests WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' OR created_at IS NULL")
def retention(spark, sf):
    """Rows that a purge keeps and removes."""
    out = f"{shared_folder(spark)}/kept-{uuid4().hex}"
    removed = sinks.purge(table(spark, sf, "requests"), "created_at", F.lit("2025-01-01").cast("timestamp"), out)
    return spark.read.parquet(out).agg(F.count("*").alias("kept"), F.lit(removed).cast("long").alias("removed"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
    SELECT o_custkey, count(*) AS orders, CAST(count(prev) AS BIGINT) AS repeats, CAST(min(date_diff('day', prev, o_orderdate)) AS BIGINT) AS least_days FROM o GROUP BY o_custkey""")
def repeat_gap(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("prev", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count("prev").alias("repeats"), F.min(F.datediff("o_orderdate", "prev")).cast("long").alias("least_days"))


@query("""
    WITH r AS (SELECT l_orderkey AS draft, l_linenumber AS pos, l_quantity > 25 AS supported, l_discount >= 0.09 AS contradicted, l_tax < 0.07 AS visible FROM lineitem),
    s AS (SELECT draft, pos, CASE WHEN bool_or(contradicted) THEN 'reject' WHEN count(*) FILTER (supported) >= 1 THEN 'accept' ELSE 'unsupported' END AS verdict, bool_or(visible) AS visible FROM r GROUP BY draft, pos)
    SELECT draft, count(*) AS sentences, count(*) FILTER (verdict <> 'accept') AS failed,
      CASE WHEN count(*) FILTER (verdict <> 'accept') >= 2 OR count(*) FILTER (verdict <> 'accept' AND NOT visible) > 0 THEN 'refuse' WHEN count(*) FILTER (verdict <> 'accept') = 1 THEN CASE WHEN arg_max(verdict, pos) <> 'accept' THEN 'trim' ELSE 'refuse' END
           ELSE 'deliver' END AS answer FROM s GROUP BY draft""")
def answer_decision(spark, sf):
    """G08-G10 as aggregates: pairs to sentences (any contradiction rejects), sentences to the answer (a single failed
    last sentence is trimmed), W12."""
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") > 25).alias("sup"), (F.col("l_discount") >= 0.09).alias("con"), (F.col("l_tax") < 0.07).alias("vis"))
    s = r.groupBy("draft", "pos").agg(F.when(F.bool_or("con"), "reject").when(F.bool_or("sup"), "accept").otherwise("unsupported").alias("verdict"), F.bool_or("vis").alias("vis"))
    bad = F.col("verdict") != "accept"
    failed, hidden, last = F.count_if(bad), F.count_if(bad & ~F.col("vis")), F.max_by("verdict", "pos")
    answer = F.when((failed >= 2) | (hidden > 0), "refuse").when(failed == 1, F.when(last != "accept", "trim").otherwise("refuse")).otherwise("deliver")
    return s.groupBy("draft").agg(F.count("*").alias("sentences"), failed.alias("failed"), answer.alias("answer"))


@query("""
    WITH d AS (SELECT l_orderkey AS draft, list_sort(list(DISTINCT l_suppkey)) AS used, count(*) AS n, count(DISTINCT l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey)
    SELECT draft, array_to_string(used, ',') AS used, array_to_string(list_filter([CASE WHEN n > 5 THEN 'too_many' END, CASE WHEN ids < n THEN 'duplicate_id' END], lambda x: x IS NOT NULL), ',') AS problems FROM d""")
def draft_contract(spark, sf):
    """limits, unique ids, the sorted distinct union of what is cited."""
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("draft")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("used"), F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("ids"))
    p = relations.reasons((F.col("n") > 5, "too_many"), (F.col("ids") < F.col("n"), "duplicate_id"))
    return d.select("draft", F.array_join(F.col("used").cast("array<string>"), ",").alias("used"), F.array_join(p, ",").alias("problems"))


@query("""
    SELECT l_orderkey AS draft, string_agg(l_shipmode_text || ' [' || l_linenumber || ']', ' ' ORDER BY l_linenumber, l_partkey, l_shipmode_text) AS payload
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS l_shipmode_text FROM lineitem) GROUP BY l_orderkey""")
def payload(spark, sf):
    """Sentences in their order with citation marks, as one text."""
    x = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus", F.lit(" ["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("t"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("draft")).agg(F.array_sort(F.collect_list(x)).alias("s"))
    return g.select("draft", F.array_join(F.transform("s", lambda y: y["t"]), " ").alias("payload"))
