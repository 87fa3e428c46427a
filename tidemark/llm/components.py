"""Connected components over an edge table, by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node of its component.

    Each round links every node's neighbours to the least of them (first the greater neighbours, then
    the lesser ones), which halves path lengths at least.  A hub's neighbours stay separate rows; only
    the least of them is aggregated.  Each round's edges are stored, so lineage stays short and a lost
    executor costs one round.  No edges give no rows.
    """
    pairs = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, "edges")
        if after.select("a").intersect(after.select(F.col("b").alias("a"))).isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            drop_stored(pairs)
            pairs = after
            break
        drop_stored(pairs)
        pairs = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = stored(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
    drop_stored(pairs)
    return out
