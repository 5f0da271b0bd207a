"""Connected components of an edge table, as rounds of joins and groupings; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour greater than a node points to the least of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The lesser neighbours of a node point to the least of them, and so does the node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached, for every node that has an edge to another node.

    `edges` has columns u and v of one orderable type. Edges may repeat, run either way or join a node with itself (no
    effect); rows with a null end are left out. No edges: no rows. Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while True:
        now = stored(_small_star(_large_star(now)))
        if (then := mark(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = then
