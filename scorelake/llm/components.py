"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.storage import removed, stored


def _with_least(links: DataFrame) -> DataFrame:
    """Every (node, neighbour) beside the least of the node and its neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): ``root`` is the least node reachable; only nodes with a link appear.

    ``links`` has columns a and b. Alternates the two steps of Kiveris et al. (large star, small star): in
    the first every node hangs its larger neighbours below the least node it knows, in the second its
    smaller ones. The number of links never grows, the rounds grow with the logarithm of the longest chain.
    The least neighbour is aggregated before the shuffle, so a node with many neighbours is no hot key.
    Each round is a stored table. Links of a node with itself and nulls are ignored.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links", narrow=True)
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hung = stored(large.where("a <> b"), "large-star", narrow=True)
        small = _with_least(hung.where("a > b"))
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = stored(small, "small-star", narrow=True)
        now = _state(after)
        removed(links, hung)
        links = after
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
