"""Exact and near duplicates, contamination, components and splits of record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.hashing import bucket
from brindle.functions.text import shingles, split_key
from brindle.session import cut, spread, written


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, copies, first): texts that are equal after normalisation."""
    d = df.where(F.col(text).isNotNull()).select(F.sha2(split_key(F.col(text)), 256).alias("digest"), F.col(key).alias("k"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("k").alias("first")).where("copies > 1")


def near_links(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(key_a, key_b, jaccard) between representatives of equal texts, exact, by prefix filtering: of each set only
    the rarest (1 - threshold) share of the shingles, and one more, can decide, and only those are joined."""
    base = spread(df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text))).select("k", split_key(F.col(text)).alias("t"))
    reps = base.groupBy("t").agg(F.min("k").alias("k")).select("k", shingles(F.split("t", " "), n).alias("s"))
    reps = written(reps.select("k", F.transform("s", lambda x: F.xxhash64(x)).alias("s")))  # read four times
    each = reps.select("k", F.size("s").alias("n"), F.explode("s").alias("x"))
    freq = each.groupBy("x").agg(F.count("*").alias("f"))
    w = Window.partitionBy("k").orderBy("f", "x")
    head = each.join(freq, "x").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("f > 1")
    a, b = head.select("x", F.col("k").alias("ka"), F.col("n").alias("na")), head.select("x", F.col("k").alias("kb"), F.col("n").alias("nb"))
    fits = (F.col("ka") < F.col("kb")) & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    pairs = a.join(b, "x").where(fits).select("ka", "kb").distinct()
    p = pairs.join(reps.select(F.col("k").alias("ka"), F.col("s").alias("sa")), "ka").join(reps.select(F.col("k").alias("kb"), F.col("s").alias("sb")), "kb")
    common = F.size(F.array_intersect("sa", "sb"))
    p = p.select("ka", "kb", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard"))
    return p.where(F.col("jaccard") >= threshold).select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"), "jaccard")


def contamination(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, n: int = 5) -> DataFrame:
    """(item, docs, shared): for each item in how many texts its shingles stand and how many of its shingles do."""
    i = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.explode(shingles(F.split(split_key(F.col(item_text)), " "), n)).alias("s"))
    d = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text))).select("doc", F.explode(shingles(F.split(split_key(F.col(text)), " "), n)).alias("s"))
    d = d.join(i.select("s").distinct(), "s", "left_semi")
    return d.join(i, "s").groupBy("item").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("s").alias("shared")).withColumnRenamed("item", item)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) with the least node of each component as root, by passing the least label on, with shortcuts.
    edges: (u, v). Labels are aggregated before they are shuffled, so that a node with many edges is not gathered."""
    e = cut(edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").unionByName(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    lab = cut(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select(F.col("u").alias("node"), F.col("l").alias("root")))
    for _ in range(rounds):
        seen = e.join(lab.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("r"))
        nxt = lab.join(seen, "node").select("node", F.least("root", "r").alias("root"))
        up = nxt.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = nxt.join(up, "root", "left").select("node", F.coalesce(F.least("root", "above"), "root").alias("root"))
        nxt = cut(nxt)
        if not nxt.join(lab.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count():
            return nxt
        lab = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def stratified_split(df: DataFrame, key: str, stratum: str, shares: list[tuple[str, float]], n_files: int = 64) -> DataFrame:
    """Within each stratum, in the order of the keys' hashes, cut at the rounded cumulative shares.

    The rank within a stratum comes from counts by slice of the hash and a rank within the slice, so that a stratum
    with a third of all rows is never sorted in one task."""
    d = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_s", F.conv(F.left("_h", F.lit(4)), 16, 10).cast("int") % 65536)
    d = d.withColumn("_s", F.floor(F.col("_s") / (65536 / n_files)).cast("int"))
    count = d.groupBy(stratum, "_s").agg(F.count("*").alias("_c"))
    before = count.withColumn("_b", F.sum("_c").over(Window.partitionBy(stratum).orderBy("_s")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum)))
    b = before.select(F.col(stratum).alias("_st"), F.col("_s").alias("_bs"), "_b", "_n")
    j = d.join(b, d[stratum].eqNullSafe(b["_st"]) & (d["_s"] == b["_bs"]))
    r = j.withColumn("_r", F.col("_b") + F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_h", key)))
    part, acc = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for name, s in reversed(shares):
        part = F.when(F.col("_r") <= F.round(F.col("_n") * round(acc, 9)), name).otherwise(part)
        acc -= s
    return r.withColumn("split", part).drop("_h", "_s", "_st", "_bs", "_b", "_n", "_r")


def families(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """df with the column family: rows of one group, or of equal text after normalisation, are one family, and so on from
    row to row. A row without group and text is its own family."""
    own = F.concat(F.lit("k:"), F.col(key).cast("string"))
    g, t = F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("t:"), F.sha2(split_key(F.col(text)), 256))
    d = written(df.withColumn("_node", F.coalesce(g, t, own)).withColumn("_text", t))
    of = components(d.select(F.col("_node").alias("u"), F.coalesce("_text", "_node").alias("v")).distinct())
    return d.join(of, d["_node"] == of["node"], "left").withColumn("family", F.coalesce("root", "_node")).drop("_node", "_text", "node", "root")


def group_split(df: DataFrame, key: str, group: str, text: str, stratum: str, shares: list[tuple[str, float]], n_files: int = 64) -> DataFrame:
    """Df with family and split. Families are split whole; a family's stratum is its most common one, the smaller
    of equals, and the shares are those of the families of a stratum."""
    d = written(families(df, key, group, text))
    n = d.groupBy("family", stratum).agg(F.count("*").alias("n"))
    one = n.groupBy("family").agg(F.min_by(stratum, F.struct(-F.col("n"), F.col(stratum))).alias("_stratum"))
    part = stratified_split(one, "family", "_stratum", shares, n_files).select("family", "split")
    return d.join(part, "family")


def crossing(df: DataFrame, group: str, part: str) -> DataFrame:
    """groups that stand in more than one partition."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(part).alias("partitions"), F.count("*").alias("rows")).where("partitions > 1")


def hash_split(key: Column, share: float, a: str = "development", b: str = "final") -> Column:
    """G15, H05"""
    return F.when(bucket(key) < share, a).otherwise(b)
