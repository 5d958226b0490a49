"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import durable

#: Rounds double the reach at least; no graph that fits a cluster needs as many.
MOST_ROUNDS = 60
#: Rows that a task is given at least: the tables of small graphs are written in few files.
LEAST_ROWS = 100_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df, written, in no more files than `rows` rows of it need."""
    return durable(df.coalesce(max(8, rows // LEAST_ROWS)))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links each node's larger (or, small star, its smaller) neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = compact(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
    # least was written, so that the join can deal a hub's rows to several tasks
    linked = both.join(least, "u")
    moved = linked.where((F.col("v") > F.col("u")) if large else (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return compact(moved.where(F.col("a") != F.col("b")).distinct(), rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b), both long, the smallest node of its component.

    Self-links, repeated and reversed edges change nothing; null ends are left out. No edges, no rows. Nothing but
    a count and a checksum a round comes to the driver; every round is written to the checkpoint folder.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    given = durable(edges.where("a <> b").select(larger, smaller).distinct())
    rows = 2 * given.count()  # no round makes more of them
    now, before = given.coalesce(max(8, rows // LEAST_ROWS)), None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = _star(_star(now, True, rows), False, rows)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
