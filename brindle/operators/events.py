"""Sessions, streaks, idempotency, rate limits and other analytics of logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds of a time stamp with or without zone (times are UTC throughout)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, user: str, ts: str, key: str, minutes: int = 30) -> DataFrame:
    """W13, T-5: a new session begins when the gap is the time to live or more (a session window would join an event
    exactly at the gap)."""
    w = Window.partitionBy(user).orderBy(ts, key)
    new = F.coalesce((micros(ts) - F.lag(micros(ts)).over(w) >= minutes * 60_000_000).cast("int"), F.lit(1))
    e = events.withColumn("new", new)
    return e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def streaks(events: DataFrame, group: list[str], ts: str, key: str, correct: Column, cap: int = 3) -> DataFrame:
    """Correct answers in a row, at most cap, back to 0 by a miss; due in 10 minutes after a miss, else in 1, 3
    or 7 days."""
    w = Window.partitionBy(*group).orderBy(ts, key)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("ok", correct.cast("int")).withColumn("misses", F.sum(1 - F.col("ok")).over(run))
    inner = Window.partitionBy(*group, "misses").orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("streak", F.least(F.sum("ok").over(inner), F.lit(cap)).cast("int"))
    seconds = F.when(F.col("ok") == 0, 600).when(F.col("streak") == 1, 86_400).when(F.col("streak") == 2, 3 * 86_400).otherwise(7 * 86_400)
    return e.withColumn("due", F.col(ts) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).drop("ok", "misses")


def idempotency(requests: DataFrame, key: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """Each request as first, replay (same body as the first of its key) or conflict; a request without key
    is always a first."""
    has = F.lit(True)
    for k in key:
        has = has & F.col(k).isNotNull()
    w = Window.partitionBy(*key).orderBy(*order)
    n, body = F.row_number().over(w), F.first(fingerprint).over(w)
    return requests.withColumn("outcome", F.when(~has | (n == 1), "first").when(F.col(fingerprint).eqNullSafe(body), "replay").otherwise("conflict"))


def daily_limit(events: DataFrame, user: str, ts: str, most: int) -> DataFrame:
    """Users and days with their number of events and whether the limit is reached."""
    d = events.groupBy(user, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("limited", F.col("n") >= most)


def exact_percentiles(rows: DataFrame, group: str, value: str, points: dict[str, tuple[float, bool]], bins: int = 4096) -> DataFrame:
    """(group, n, one column a point) exact percentiles of groups of any size, in two passes. points: name to
    (share, linear): linear between the two nearest ranks, or the value of the nearest rank.

    The first pass counts values in equal bins between a group's ends; the ranks that are asked for fall into a few bins.
    The second counts the different values of these bins only. What goes into one window is a group's bins, then a
    bin's different values, never a group. Nulls and values that are no number are left out; a group of one value has
    it everywhere."""
    v = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf')")
    ends = v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    # groups are few (a kind, a state); adaptive execution sends their ends to every task
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("int")
    binned = v.alias("x").join(ends.alias("y"), F.expr("x.g <=> y.g")).select("x.g", "x.v", "n", "lo", "hi").select("g", "v", "n", at.alias("bin"))
    w = Window.partitionBy("g").orderBy("bin")
    counts = binned.groupBy("g", "n", "bin").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(w) - F.col("c"))
    ranks = []
    for name, (q, linear) in points.items():
        spot = (F.col("n") - 1) * F.lit(q) if linear else F.greatest(F.ceil(F.col("n") * F.lit(q)) - 1, F.lit(0))
        ranks.append(F.struct(F.lit(name).alias("name"), F.floor(spot).cast("long").alias("low"), F.ceil(spot).cast("long").alias("high"), (spot - F.floor(spot)).cast("double").alias("part")))
    wanted = ends.select("g", "n", F.explode(F.array(*ranks)).alias("p")).select("g", "n", "p.*")
    needed = wanted.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    hit = counts.alias("c").join(needed.alias("r"), F.expr("c.g <=> r.g AND r.rank >= c.before AND r.rank < c.before + c.c")).select("c.g", "c.bin", "c.before", "r.rank")
    few = hit.select("g", "bin", "before").distinct()
    inner = binned.alias("x").join(few.alias("f"), F.expr("x.g <=> f.g AND x.bin = f.bin")).groupBy("x.g", "x.bin", "f.before", "x.v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "bin").orderBy("v")
    inner = inner.select("g", "bin", "v", "c", (F.sum("c").over(w) - F.col("c") + F.col("before")).alias("first"))
    found = inner.alias("i").join(hit.alias("h"), F.expr("i.g <=> h.g AND i.bin = h.bin AND h.rank >= i.first AND h.rank < i.first + i.c")).select("i.g", "h.rank", "i.v")
    low, high = found.withColumnsRenamed({"rank": "low", "v": "a"}), found.withColumnsRenamed({"rank": "high", "v": "b"})
    got = wanted.alias("w").join(low.alias("l"), F.expr("w.g <=> l.g AND w.low = l.low")).join(high.alias("h"), F.expr("w.g <=> h.g AND w.high = h.high"))
    got = got.select("w.g", "w.n", "w.name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
    return got.groupBy(F.col("g").alias(group), "n").agg(*(F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in points))


def breaker(events: DataFrame, key: str, ts: str, order: str, failed: str, failures: int = 5, window_s: int = 60, cooldown_s: int = 30) -> DataFrame:
    """An ordered fold for each key: open after so many failures in a row within the window, closed to all calls
    for the cooldown, then one trial. Keys are services, few and bounded; a key's log is one group."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "o"])
        recent: list[int] = []
        until, opened, rejected = None, 0, 0
        for t, bad in zip(g.t.tolist(), g.bad.tolist()):
            if until is not None and t < until:
                rejected += 1
                continue
            trial, until = until is not None, None
            if not bad:
                recent = []
                continue
            recent = [x for x in recent if x > t - window_s * 1_000_000] + [t]
            if trial or len(recent) >= failures:
                until, opened, recent = t + cooldown_s * 1_000_000, opened + 1, []
        return pd.DataFrame({"key": [g.k.iloc[0]], "calls": [len(g)], "opened": [opened], "rejected": [rejected]})

    src = events.select(F.col(key).cast("string").alias("k"), micros(ts).alias("t"), F.col(order).cast("long").alias("o"), F.col(failed).cast("boolean").alias("bad")).where("k IS NOT NULL AND t IS NOT NULL")
    return src.groupBy("k").applyInPandas(fold, "key string, calls long, opened long, rejected long")
