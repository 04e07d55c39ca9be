"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node hang on the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("top"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("top").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("top"))
    below = down.join(least, "a")
    return below.select(F.col("b").alias("a"), F.col("top").alias("b")).union(least.select("a", F.col("top").alias("b"))).where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) gives one row (node, root) for each node that isn't the least of its component.

    Every round is written to the shared folder, so lineage stays short; rounds grow with the logarithm
    of the longest chain. The driver sees a count and a checksum only. Null ends and self-links are
    ignored, repeated links count once.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        links = cut_lineage(_small_star(_large_star(links)), "links")
