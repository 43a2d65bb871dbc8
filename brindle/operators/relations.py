"""Relational operators behind evidence, citations, registers and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(*tests: tuple[Column, str]) -> Column:
    """the codes whose condition holds, in the order given; an empty array if none does (null counts as no)."""
    return F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in tests)), lambda x: x.isNotNull())


def active_at(now: Column, begin: Column, end: Column, review: Column) -> Column:
    """F02, T-9: half-open: from begin on, before end and before the review is due; a null bound does not bind."""
    return F.coalesce(begin <= now, F.lit(True)) & F.coalesce(now < end, F.lit(True)) & F.coalesce(now < review, F.lit(True))


def revoke(rows: DataFrame, revoked: DataFrame, key: str, version: str) -> DataFrame:
    """rows that no revocation names; a revocation without version names all versions. Two equality joins, so
    that none becomes a nested loop."""
    every = revoked.where(F.col(version).isNull()).select(key).distinct()
    one = revoked.where(F.col(version).isNotNull()).select(key, version).distinct()
    return rows.join(every, key, "left_anti").join(one, [key, version], "left_anti")


def duplicates(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Keys that occur more than once, with the number of rows and of different contents."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct(content).alias("contents")).where("copies > 1")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def first_complete(sets: DataFrame, usable: DataFrame, item: str, pos: str, member: str) -> DataFrame:
    """For each item the first alternative all of whose members are usable; sets: one row a member."""
    u = usable.select(F.col(member)).distinct().withColumn("_ok", F.lit(True))
    ok = sets.join(u, member, "left").groupBy(item, pos).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok"), F.count("*").alias("members"))
    return ok.where("ok").groupBy(item).agg(F.min(pos).alias(pos), F.min_by("members", pos).alias("members"))


def span_overlaps(spans: DataFrame, block: str, key: str, start: str, end: str, least: float) -> DataFrame:
    """(key_a, key_b, shared, ratio): pairs that share enough of the shorter one's total span within equal blocks.

    A block is cut into cells of twice the mean span and every span is put into the cells it touches, so that only
    spans near each other meet, however many a block has. A pair of spans counts in the cell in which the later one
    begins. Spans without length share nothing."""
    total = spans.groupBy(key).agg(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0))).alias("total"))
    some = spans.where(F.col(end) > F.col(start))
    width = max(float(some.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1) * 2, 1e-9)
    cell = lambda c: F.floor(c / width)
    last = F.greatest(F.ceil(F.col(end) / width) - 1, cell(F.col(start)))
    each = some.select(F.col(block).alias("b"), F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(cell(F.col(start)), last)).alias("cell"))
    a, b = each.withColumnsRenamed({"k": "ka", "s": "s1", "e": "e1"}), each.withColumnsRenamed({"k": "kb", "s": "s2", "e": "e2"})
    hit = a.join(b, ["b", "cell"]).where((F.col("ka") < F.col("kb")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (cell(F.greatest("s1", "s2")) == F.col("cell")))
    shared = hit.groupBy("ka", "kb").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared"))
    r = shared.join(total.withColumnsRenamed({key: "ka", "total": "ta"}), "ka").join(total.withColumnsRenamed({key: "kb", "total": "tb"}), "kb")
    r = r.withColumn("ratio", F.col("shared") / F.least("ta", "tb"))
    return r.where(F.col("ratio") >= least).select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"), "shared", "ratio")


def check_citations(cites: DataFrame, evidence: DataFrame, key: str, eligible: str) -> DataFrame:
    """Every citation with the reason against it: missing (nothing cited), unknown, ineligible; null if good."""
    e = evidence.select(F.col(key), F.col(eligible).alias("_e"), F.lit(True).alias("_known")).dropDuplicates([key])
    j = cites.join(e, key, "left")
    why = F.when(F.col(key).isNull(), "missing").when(F.col("_known").isNull(), "unknown").when(~F.coalesce("_e", F.lit(False)), "ineligible")
    return j.withColumn("problem", why).drop("_e", "_known")


def number_by_appearance(rows: DataFrame, group: str, pos: str, key: str) -> DataFrame:
    """Each key's number in its group by the order of first appearance, from 1."""
    first = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.min(pos).alias("first_pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy("first_pos", key)))


def review_sample(rows: DataFrame, stratum: list[str], key: str, special: Column, n_special: int = 25, n: int = 50) -> DataFrame:
    """Up to n_special special rows first, the rest round robin over the strata, n together."""
    first = rows.where(special).orderBy(key).limit(n_special).withColumn("round", F.lit(0))
    rest = rows.join(first.select(key), key, "left_anti")
    w = Window.partitionBy(*stratum).orderBy(key)
    rest = rest.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n)
    both = first.unionByName(rest.select(first.columns)) if rest.columns != first.columns else first.unionByName(rest)
    return both.orderBy("round", *stratum, key).limit(n)


def longest_prefix(rows: DataFrame, group: str, order: list[str], size: str, limit: int) -> DataFrame:
    """The rows in order while their running size is within the limit."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the given order (upsert without MERGE, first request wins, ...)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
