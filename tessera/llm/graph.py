"""Connected components of edges between integer ids, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for each id of an edge (a, b). Ends when every id is linked to its least one.

    Alternates large and small stars; each round's edges are written to the shared folder, and the count and hash sum of
    the edges tell when nothing changes. A join on a node with very many links is split by adaptive execution.
    """
    now = write_table(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    state = None
    while True:
        after = write_table(_small_star(_large_star(now)), "edges")
        told = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_tables(now)
        now = after
        if (told.n, told.h) == state:
            break
        state = (told.n, told.h)
    down = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return down.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
