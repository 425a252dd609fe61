"""Connected components by alternating large and small stars, entirely as joins and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_dir

MAX_ROUNDS = 50


def _large_star(edges: DataFrame, used: list) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    used.append(least)
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame, used: list) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    used += [edges, least]
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (its first two columns) the least node it is connected with.

    Nulls, loops and repeated edges are ignored; no edges give an empty table. A node's neighbours are never gathered:
    each round is a minimum per node and a join with it. The minima are written first, so that the join is of two tables:
    small ones are broadcast, and a node with very many edges is split by Spark's adaptive execution.
    """
    a, b = edges.columns[:2]
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        used = [now]
        following = cut(_small_star(cut(_large_star(now, used)), used))
        again = _mark(following)
        for table in used:
            drop_dir(now.sparkSession, table)
        now, mark, before = following, again, mark
        if again == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
