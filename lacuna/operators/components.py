"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node with more than this part (one of HOT) of all links isn't met by a shuffle.
HOT = 100
#: Links of one written file.
FILE = 20_000


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _least(links: DataFrame) -> DataFrame:
    """`(a, m, n)`: the least partner of each node and how many it has; merged within tasks first."""
    return links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (a, b) with `m` of a.

    A node with more than 1/HOT of all links, as the root of a large component has, is one of 2 * HOT at most: those
    are broadcast, and their links stay where they are; the others meet their node by a shuffle.
    """
    hot = least.filter(F.col("n") * HOT > total).select("a", "m")
    cold = links.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.select("a", "m"), "a")
    return links.join(F.broadcast(hot), "a").unionByName(cold)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"), "n")
    return _pairs(_with_least(both.filter("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = _least(edges)
    return _pairs(_with_least(edges, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def _state(links: DataFrame) -> tuple[int, int]:
    """How many links (a, b) there are, and how many nodes keep them from being stars: those with several lesser partners, or with both lesser and larger ones."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    total, bad = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return total or 0, bad


def connected_components(edges: DataFrame, cut, max_rounds: int = 60) -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)`, root being the least node of its component.

    `cut` materialises a frame (checkpoint or written table); it is called twice a round, since
    each step reads its links several times.  Rounds grow with the
    logarithm of the longest chain, squared, and end when all links are stars, whose centers are the least of them;
    no round is made where they are from the start.  Nodes without an edge to another node aren't in the result.
    """
    now, cores = cut(_pairs(edges)), edges.sparkSession.sparkContext.defaultParallelism
    for _ in range(max_rounds):
        total, bad = _state(now)
        if not bad:
            break
        few = max(2 * cores, total // FILE)  # files: links grow fewer, and every file read again is a task
        now = cut(_small_star(cut(_large_star(now, total).coalesce(few)), total).coalesce(few))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
