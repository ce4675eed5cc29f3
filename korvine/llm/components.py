"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of the nodes of `links` (a, b), by large-star and small-star.

    Each round hangs the neighbours of a node from its smallest neighbour; hubs are aggregated before the shuffle. It ends
    when a round changes nothing, after a number of rounds that is logarithmic in the longest path.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()  # u > v
    e = materialize(e)
    # a table holds each pair once: equal counts and sums mean that nothing changed
    check = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = check(e)
    while True:
        # large star: every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: every smaller neighbour of a node, and itself, goes to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small)
        e, now = new, check(new)
        done, before = now == before, now
        if done:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
