"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` links -> ``(node, component)`` for every node that has a link; component = its smallest node.

    Large-star links each larger neighbour of a node to the smallest node around it; small-star does so with the
    smaller neighbours. Rounds alternate until no link changes; each is staged in the shared folder. Minima are
    pre-aggregated and joined back, so a hub's neighbours are never gathered in one task.
    """
    now = stage(_clean(edges), "links")
    mark = _mark(now)
    while mark[0]:
        small = stage(_small_star(_large_star(now)), "links")
        drop_staged(now)
        now, old, mark = small, mark, _mark(small)
        if mark == old:
            break
    # Stars around the smallest nodes: (larger, smallest).
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of links and sums of their hashes: the same for the same set of links."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))).first())


def _clean(edges: DataFrame) -> DataFrame:
    """Each link once, larger node first, no loops."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Repeated links do no harm to the minima that follow.
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(moved.unionByName(least.select("a", F.col("m").alias("b"))))
