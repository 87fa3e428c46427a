"""Graph operators over edge tables: projection, components, similarity, PageRank, communities, structure."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .community import local_moves, spanning

#: Components of at most so many nodes are broadcast to their edges.
BROADCAST_NODES = 200_000

_roots: set[str] = set()


def _root(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir; it is removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    root = f"{base.rstrip('/')}/tidemark-graph-{spark.sparkContext.applicationId}"
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots.add(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, its lineage cut."""
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes the files of frames that were cut and are read no more, and the shuffles that no plan holds any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def co_occurrence(links: DataFrame, item: str, member: str) -> DataFrame:
    """(a, b, weight): pairs of members (a < b) with the number of distinct items they share.

    Members of an item are paired within it; items are of bounded size (companies of an event).
    """
    one = links.select(item, member).where(F.col(item).isNotNull() & F.col(member).isNotNull()).distinct()
    left, right = one.select(item, F.col(member).alias("a")), one.select(item, F.col(member).alias("b"))
    return left.join(right, item).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): component is the least node that edges (a, b) lead to; isolates are their own.

    Labels of neighbours, then labels of labels, until nothing changes; every round is stored.
    """
    near = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        least = near.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(least, labels["node"] == least["a"], "left").select("node", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = cut(step.join(hop, "to", "left").select("node", F.least("to", "further").alias("component"), "was"))
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def similarity(links: DataFrame, item: str, member: str, top_k: int = 24, cutoff: float = 1e-12) -> DataFrame:
    """(a, b, similarity): Jaccard of members' item sets, each member's top_k kept (ties by neighbour), pairs once, descending."""
    pairs = co_occurrence(links, item, member)
    size = links.select(item, member).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    scored = pairs.join(size.select(F.col(member).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(member).alias("b"), F.col("n").alias("nb")), "b")
    scored = scored.withColumn("weight", F.col("weight") / (F.col("na") + F.col("nb") - F.col("weight"))).where(F.col("weight") >= cutoff)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("weight").desc(), "b"))
    top = both_ways(scored).withColumn("_n", rank).where(F.col("_n") <= top_k)
    return top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("similarity"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = 1e-7) -> DataFrame:
    """(node, score): weighted PageRank, not normalised; isolates keep 1 - damping.  Stops early below tolerance, if given."""
    ways = both_ways(edges)
    out = ways.groupBy("a").agg(F.sum("weight").alias("total"))
    moves = cut(ways.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")))
    every = nodes.select("node").distinct()
    scores = every.withColumn("score", F.lit(1.0 - damping))
    for i in range(rounds):
        given = moves.join(scores.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        after = every.join(given.withColumnRenamed("b", "node"), "node", "left").select("node", (F.lit(1.0 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if tolerance is not None or i % 5 == 4:
            after = cut(after)
        if tolerance is not None and after.join(scores.withColumnRenamed("score", "was"), "node").where(F.abs(F.col("score") - F.col("was")) > tolerance).isEmpty():
            return after
        scores = after
    return scores


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, strength, isolate): distinct neighbours and their weights; self-loops and weights of 0 or less do not count."""
    ways = both_ways(edges.where("a <> b AND weight > 0"))
    own = ways.groupBy("a").agg(F.countDistinct("b").alias("degree"), F.sum("weight").alias("strength"))
    out = nodes.select("node").distinct().join(own.withColumnRenamed("a", "node"), "node", "left")
    return out.select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(F.col("strength").cast("double"), F.lit(0.0)).alias("strength"), F.col("degree").isNull().alias("isolate"))


def relabel(groups: DataFrame, prefix: str, key: str = "component") -> DataFrame:
    """(node, label, size): groups by size descending, then members, are PREFIX01, PREFIX02 and so on.

    Groups are numbered in one ordering; there are as many rows there as groups.
    """
    sized = groups.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    label = F.row_number().over(W.orderBy(F.col("size").desc(), "first"))
    digits = F.col("number").cast("string")
    named = sized.withColumn("number", label).withColumn("label", F.concat(F.lit(prefix), F.when(F.length(digits) >= 2, digits).otherwise(F.lpad(digits, 2, "0"))))
    return groups.join(named.select(key, "label", "size"), key).select("node", "label", "size")


def membership(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(label, size, members): the members' names joined by ' | ' in order of node, larger groups first."""
    rows = groups.join(names, "node")
    listed = F.array_sort(F.collect_list(F.struct("node", "name")))
    return rows.groupBy("label", "size").agg(listed.alias("_m")).select("label", "size", F.array_join(F.transform("_m", lambda m: m["name"]), " | ").alias("members")).orderBy(F.col("size").desc(), "label")


def threshold_study(nodes: DataFrame, edges: DataFrame, thresholds: list[int]) -> DataFrame:
    """For each threshold: edges of at least that weight, density, components, largest one, isolates."""
    out = None
    total = nodes.select("node").distinct()
    for t in thresholds:
        some = edges.where(F.col("weight") >= t)
        sizes = components(total, some).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        row = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"), F.sum((F.col("size") == 1).cast("long")).alias("isolates"), F.sum("size").alias("n"))
        row = row.join(some.agg(F.count(F.lit(1)).alias("n_edges"))).select(F.lit(t).alias("threshold"), "n_edges", F.round(F.try_divide(F.col("n_edges").cast("double"), F.col("n") * (F.col("n") - 1) / 2), 6).alias("density"), "n_components", "largest", "isolates")
        out = row if out is None else out.unionByName(row)
    return out


def edge_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that edges (a, b, weight) of positive weight connect.

    Tasks first keep of their edges what connects their nodes, twice; the rounds run on what is left.
    """
    rows = edges.where("a <> b AND weight > 0").select("a", "b")
    every = cut(rows.mapInArrow(spanning(), rows.schema))
    few = cut(every.mapInArrow(spanning(), rows.schema))
    forget(edges.sparkSession, every)
    ends = few.select(F.col("a").alias("node")).unionByName(few.select(F.col("b").alias("node"))).distinct()
    return components(ends, few)


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 10, passes: int = 10, tolerance: float = 1e-4, weighted: bool = True, parts: DataFrame | None = None) -> DataFrame:
    """(node, community, modularity): greedy modularity by levels, nodes in order, ties to the least community.

    Local moves stay within a connected component, so each component is settled by one task and gives what
    every level makes of it; the level at which the whole graph gains less than `tolerance` is chosen from
    their sums.  A task holds its nodes in memory, its edges in temporary files.  `edges` are read a few
    times; `parts` are their components, if known.
    """
    spark, kind = nodes.sparkSession, dict(nodes.dtypes)["node"]
    rows = edges.where("a <> b AND weight > 0").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.col("weight").cast("double").alias("weight"))
    if not weighted:
        rows = rows.withColumn("weight", F.lit(1.0))
    sums = rows.agg(F.sum("weight").alias("total"), F.max(F.col("weight") % 1 != 0).alias("broken")).first()
    total = 2 * (sums.total or 0.0)
    parts = edge_components(edges) if parts is None else parts
    parts = parts.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    small = parts.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    named = rows.join((F.broadcast(parts) if small else parts).withColumnRenamed("node", "a"), "a")
    dealt = named.select("component", "a", "b", *["weight"] * weighted).repartition("component")
    move = local_moves(levels, passes, total, not sums.broken and total < 1 << 31, weighted)
    found = cut(dealt.mapInArrow(move, f"node {kind}, level int, community {kind}, share double, last boolean"))
    forget(spark)
    at = lambda k: (F.col("level") == k) | (F.col("last") & (F.col("level") < k))
    sums = found.agg(*[F.sum(F.when(at(k), F.col("share"))).alias(f"q{k}") for k in range(levels)]).first()
    quality, level = -1.0, 0
    for level, now in enumerate(sums):
        if now is None or now - quality < tolerance:
            quality = max(quality, now if now is not None else quality)
            break
        quality = now
    chosen = found.where(at(level)).select("node", "community")
    every = nodes.select("node").distinct().unionByName(parts.select("node")).distinct()
    return every.join(chosen, "node", "left").select("node", F.coalesce("community", "node").alias("community"), F.lit(max(quality, 0.0)).alias("modularity"))


def modularity(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (node, community)."""
    ways = both_ways(edges.where("a <> b AND weight > 0"))
    of = groups.select("node", "community")
    named = ways.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    parts = named.groupBy("ca").agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    total = parts.agg(F.sum("d").alias("m2"))
    return parts.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2)).alias("modularity"))


def changed_communities(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, changed): whether the set of nodes that share its community differs between two partitions."""
    def sets(x: DataFrame, name: str) -> DataFrame:
        key = x.groupBy("community").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), "|"), 256).alias(name))
        return x.join(key, "community").select("node", name)

    return sets(a, "x").join(sets(b, "y"), "node").select("node", (F.col("x") != F.col("y")).alias("changed"))
