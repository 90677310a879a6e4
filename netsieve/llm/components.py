"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.session import drop_table, stage_table


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node that is not the least of its component; `root` is the least.

    `links` has two columns of one ordered type; loops and nulls are left out, repeats count once. The number of rounds
    grows with the logarithm of the longest path. Every round is written to the shared folder, so lost executors cost
    one round at most; it goes when the next is written. Hubs are joined, never collected.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    current = stage_table(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    mark = None
    for _ in range(max_rounds):
        before, current = current, stage_table(_small_star(_large_star(current)), "links")
        drop_table(before)
        now = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components are not complete after {max_rounds} rounds")
