"""Connected components by alternating large-star and small-star over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.shared import Scope, discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first())


def connected_components(edges: DataFrame, scope: Scope | None = None, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; the component is its least node.

    Self links and repeated edges are harmless, null ends are left out, an empty table gives an empty result.
    Each round is a table in the shared folder, the last one in ``scope``; only a count and two checksums reach the driver.
    A hub's links meet in a join that adaptive execution can split, and in minima that are pre-aggregated.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = written(_small_star(_large_star(now)), "edges")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    if scope is not None:
        scope.tables.append(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
