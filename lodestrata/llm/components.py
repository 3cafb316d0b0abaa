"""Connected components of an edge table, in DataFrame operations only.

Alternating large-star and small-star rounds: every node links its larger neighbours, then itself and its smaller
ones, to the least node around it, until the edges are stars whose centres are the components' least nodes. Each
round is two aggregates and joins; the edges of a hub are dealt over several tasks. A round's edges are written to the
shared folder, and those of the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session
from .session import drop, join_dealt, table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, _n: the rows that a has). `most` rows at most: only if one node may have many, are they counted."""
    if most <= session.HOT_ROWS:
        return rows.join(least.drop("_n"), "a")
    least = table(least, "least")
    return join_dealt(rows, least.drop("_n"), ["a"], least.select("a", "_n"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
    return _with_least(near, least, most).where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    near = _with_least(down, least, most).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the least node it reaches. Nulls and self-links are left out."""
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, size = None, now.count()
    for _ in range(most_rounds):
        before, now = now, table(_small_star(_large_star(now, 2 * size), 2 * size), "edges")
        drop(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, size = seen, seen[0]
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
