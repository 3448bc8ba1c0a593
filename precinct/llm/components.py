"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.tables import staged

MAX_ROUNDS = 60


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Link neighbours of every node to the smallest of them.

    The large star does so for neighbours above the node, seen from both ends of each edge;
    the small star for the node itself and its neighbours below.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    # Staged, so that the join has a shuffle of its own on either side and can be split.
    smallest = staged(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "smallest"
    )
    linked = both.join(smallest, "a")
    if large:
        linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            smallest.select("a", F.col("least").alias("b"))
        )
    return linked.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Every node of the edges with ``root``, the smallest node of its component.

    Rounds of a large and a small star until the edges stay the same; a graph of n nodes takes
    about log(n) squared rounds at most, and one of stars two. Each round is written to the
    shared folder. A node with very many edges is reduced by partial aggregates, and its join
    can be split, since both sides come from a shuffle.
    """
    above = F.greatest(left, right).alias("a")
    below = F.least(left, right).alias("b")
    links = staged(edges.select(above, below).where(F.col("a") != F.col("b")).distinct(), name)

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        links = staged(_star(staged(_star(links, large=True), name), large=False), name)
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
