"""Problem 7: splits that keep related records together, by connected components.

Records that share an entity hang on that entity's node; components come from alternating large-star and small-star
steps over the edges until nothing changes. A component's identifier, its smallest record, is hashed into proportional
ranges, so the split of a record needs no count and stays when records are added to other components.

A node that a third of all records hang on is never gathered: a star step needs the least neighbour of each node only,
which is aggregated before the shuffle and joined back; for the few nodes with very many edges that join holds their
least neighbours in every task, so that their edges stay spread. The edges are cut with checkpoint() in each round.

Defined results: rows without an id take part in nothing; a null entity relates nothing; an id given twice counts once;
a partner that is no row of its own still relates those that name it; records without relations are alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut, written

SHARES = (("training", 0.8), ("development", 0.1), ("final", 0.1))
ROUNDS = 60
#: Rows of one key that a single task may join.
HOT = 400_000


def join_one(left: DataFrame, right: DataFrame, key: str, n: int, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left joined to right, which has one row a key. Keys of more than HOT rows of left (and of n / 1000, so that
    there are 1000 at most) are joined by holding their rows of right in every task: a key that a third of all rows
    carry is then spread over all tasks instead of going through one. n is a bound of left's rows; with n up to HOT
    no key can be that frequent and nothing is counted."""
    if n <= HOT and hot is None:
        return left.join(right, key, how)
    if hot is None:
        hot = [r[0] for r in left.groupBy(key).count().where(F.col("count") > max(HOT, n // 1000)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    h = F.broadcast(left.sparkSession.createDataFrame([(x,) for x in hot], f"{key} {dict(left.dtypes)[key]}"))
    held = F.broadcast(right.join(h, key, "left_semi"))
    return left.join(h, key, "left_semi").join(held, key, how).unionByName(left.join(h, key, "left_anti").join(right, key, how))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges (u, v), u <> v, one direction each, n of them. Large: every larger neighbour goes to the node's least
    neighbour. Small: every smaller or equal one does."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hot = None
    if 2 * n > HOT:
        least = cut(least)
        hot = [r.u for r in least.where(F.col("degree") > max(HOT, n // 500)).select("u").collect()]
    least = least.select("u", F.least("m", "u").alias("m") if large else F.col("m"))
    j = join_one(both, least, "u", 2 * n, hot=hot)
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node. edges: (u, v) of one type."""
    e = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, state = e.count(), None
    for _ in range(rounds):
        e = cut(_star(_star(e, True, n), False, n))  # a large step makes no more edges than it is given
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (row.n, row.s) == state:
            break
        n, state = row.n, (row.n, row.s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def relations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written cases (case_id, part, grp, mate) and the edges over them. Case nodes are "c:" + id and group nodes
    "g:" + group, so that the least node of a component is a case."""
    p = F.lower(F.trim("partition"))
    rows = written(
        df.select(
            F.col("case_id").cast("string").alias("case_id"), F.when(p.isin("training", "development", "final"), p).alias("part"),
            F.lower(F.trim("group_id")).alias("grp"), F.col("paired_with").cast("string").alias("mate"),
        ).where("case_id IS NOT NULL").distinct()
    )
    node = F.concat(F.lit("c:"), "case_id")
    by_group = rows.where("grp IS NOT NULL").select(node.alias("u"), F.concat(F.lit("g:"), "grp").alias("v"))
    by_pair = rows.where("mate IS NOT NULL").select(node.alias("u"), F.concat(F.lit("c:"), "mate").alias("v"))
    return rows, by_group.unionByName(by_pair)


def related(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Written cases, written (case_id, component) for each of them, and their number."""
    rows, edges = relations(df)
    comp = components(edges).where("startswith(node, 'c:')").select(F.expr("substring(node, 3)").alias("case_id"), F.expr("substring(component, 3)").alias("component"))
    of = written(rows.select("case_id").distinct().join(comp, "case_id", "left").select("case_id", F.coalesce("component", "case_id").alias("component")))
    return rows, of, of.count()


def share_of(component: Column, shares: tuple = SHARES) -> Column:
    """The split of a component: 52 bits of its SHA-256 as a fraction, laid into the shares' ranges."""
    u = F.conv(F.substring(F.sha2(component, 256), 1, 13), 16, 10).cast("double") / float(16**13)
    total, acc, out = sum(s for _, s in shares), 0.0, None
    for name, s in shares[:-1]:
        acc += s / total
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def _broken(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Components whose cases carry two partitions or more."""
    return rows.join(of, "case_id").groupBy("component").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("component", F.lit(True).alias("broken"))


def found(df: DataFrame) -> DataFrame:
    rows, of, n = related(df)
    return join_one(of, _broken(rows, of), "component", n).select("case_id").distinct()


def assign(df: DataFrame, shares: tuple = SHARES) -> DataFrame:
    """case_id, component, new_partition, and whether the component is parted now."""
    rows, of, n = related(df)
    j = join_one(of, _broken(rows, of), "component", n, "left")
    return j.select("case_id", "component", share_of(F.col("component"), shares).alias("new_partition"), F.coalesce("broken", F.lit(False)).alias("parted_now"))
