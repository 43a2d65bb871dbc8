"""Evaluation measures as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The edges are compared as they are: 0.3 falls in the bin below the edge 0.30000000000000004.
EDGES = [i * 0.1 for i in range(1, 10)]


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a share; null where n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def zero_miss_bound(n: Column, alpha: float = 0.05) -> Column:
    """A10: upper bound of a rate of which n trials showed no case."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), 1 / n))


def bin_of(p: Column) -> Column:
    """Bin 0 to 9 by the literal edges, open on the right."""
    out = F.lit(0)
    for e in EDGES:
        out = out + F.when(p >= e, 1).otherwise(0)
    return out


def calibration(df: DataFrame, p: str, y: str) -> DataFrame:
    """Bin, n, mean confidence, share of positives, and the bin's part of the calibration error."""
    b = df.groupBy(bin_of(F.col(p)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("share"))
    b = b.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0).cast("long") * F.col("bin"))))  # ten rows at most
    return b.select("bin", "n", "confidence", "share", (F.abs(F.col("confidence") - F.col("share")) * F.col("n") / F.col("total")).alias("error"))


def brier(p: Column, y: Column) -> Column:
    """A04"""
    return F.avg(F.pow(p - y, F.lit(2.0)))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Label, precision, recall, f1 of every label that occurs on either side; 0 where a denominator is 0."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    rows = c.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("guess_n"))
    rows = rows.unionByName(c.select(F.col("g").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("guess_n")))
    s = rows.where("label IS NOT NULL").groupBy("label").agg(F.sum("hit").alias("h"), F.sum("true_n").alias("t"), F.sum("guess_n").alias("g"))
    precision, recall = F.coalesce(F.try_divide("h", "g"), F.lit(0.0)), F.coalesce(F.try_divide("h", "t"), F.lit(0.0))
    return s.select("label", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * F.col("h"), F.col("t") + F.col("g")), F.lit(0.0)).alias("f1"))
