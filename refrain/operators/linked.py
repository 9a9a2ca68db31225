"""Connected components of a link table, by alternating star contraction.

Every round is two aggregations and two equi-joins; nothing is gathered in one place. A hot centre is
combined before its shuffle, and joined in salted parts; all other centres are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.session import cut_lineage

#: Parts that the links of one hot node are dealt to in a join, and the links from which on a node is hot.
SALTS = 16
HOT_LINKS = 100_000


def components(edges: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """From undirected links u, v (bigint): (scope, node, root) per node that is not the smallest of its component.

    Links of different ``scope`` values never join.
    """
    pair = [*scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = cut_lineage(edges.where("u <> v").select(*pair).distinct())
    state = _state(now, scope)
    while state[0]:
        then, now = state, cut_lineage(_small_star(_large_star(now, scope, state[0]), scope, state[0]))
        state = _state(now, scope)
        if state == then:
            break
    return now.select(*scope, F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame, scope: tuple[str, ...]) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*scope, "u", "v") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def _salted(edges: DataFrame, least: DataFrame, scope: tuple[str, ...], most: int) -> DataFrame:
    """edges (u, v) with the m of their u; merged, since the planner's size of ``least`` leaves out the parts.

    ``least`` has the links n of every u, none of them more than ``most``. Hot ones are few: a hot-th of all links.
    """
    if most <= HOT_LINKS:
        return edges.join(least.drop("n").hint("merge"), [*scope, "u"])
    hot = least.filter(F.col("n") > HOT_LINKS).select(*scope, "u", F.lit(True).alias("hot"))
    last = F.when(F.col("n") > HOT_LINKS, SALTS - 1).otherwise(0)
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("n")
    part = F.when(F.col("hot"), F.pmod(F.hash("v"), F.lit(SALTS))).otherwise(0)
    dealt = edges.join(F.broadcast(hot), [*scope, "u"], "left").withColumn("part", part).drop("hot")
    return dealt.join(parts.hint("merge"), [*scope, "u", "part"])


def _large_star(edges: DataFrame, scope: tuple[str, ...], most: int) -> DataFrame:
    both = edges.unionByName(edges.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(*scope, "u", F.least("u", "m").alias("m"), "n")
    return _salted(both.where("v > u"), least, scope, most).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scope: tuple[str, ...], most: int) -> DataFrame:
    least = edges.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _salted(edges, least, scope, most).where("v > m").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select(*scope, "u", F.col("m").alias("v")).unionByName(moved).distinct()
