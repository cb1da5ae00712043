"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component.

    Each round joins every edge to the least neighbour of its ends; a hub with very
    many edges meets one row there, which an adaptive join can split. Rounds are
    staged, so a lost executor costs one round at most. An empty input gives no rows.
    """
    now = stage(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while (after := _print_of(now)) != before:
        before = after
        now = stage(_small_star(_large_star(now).distinct()).distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
