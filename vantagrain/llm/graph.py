"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import written


def components(links: DataFrame) -> DataFrame:
    """Components of the undirected graph with links ``(u, v)`` (bigint).

    Returns ``(node, root)`` for every node that has a link, root being the
    smallest node of the component.  Alternates large-star and small-star
    rounds: each is one pre-aggregated minimum per node and one join on the
    node, so a node with very many links is split by adaptive skew joins and no
    neighbour list is ever built.  Every round is written to the shared folder;
    two numbers per round reach the driver.  Links of a node with itself are
    ignored; an empty table gives an empty result.
    """
    links = links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    # stored with u > v: u hangs below v
    state = written(_down(links), "links")
    seen = _mark(state)
    while seen[0]:
        after = written(_small_star(_large_star(state)), "links")
        mark = _mark(after)
        state = after
        if mark == seen:
            break
        seen = mark
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = state.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return roots.union(tops).distinct()


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum; equal marks mean that nothing changed."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node hangs below the node's least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, hang below the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u > v").distinct()
