"""Connected components of a graph whose edges are rows, by alternating large and small stars.

Every round replaces edges by links to smaller neighbours. Only the minimum of a node's neighbours is aggregated
(partially before the shuffle) and joined back, never a list of neighbours, so a node of very many edges is a skewed
join that Spark splits, not one task. It ends when every node either has one link, to a node without links, or none:
then each component is a star around its least node. Neither edges nor labels reach the driver; it reads whether there
is a node left to do. What a round wrote goes once the next one has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b); nodes without edges are not listed.

    Self-loops and repeated edges are allowed; an empty table gives an empty one.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _stars(now):
        before, now = now, cut(_small(_large(now).distinct()).distinct())
        release(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(down: DataFrame) -> bool:
    """Whether links from larger nodes a to smaller ones b are stars: one link from each a, and none from a b."""
    ends = down.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(down.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return each.filter("up > 1 or (up = 1 and down > 0)").isEmpty()
