"""Connected components of a link table, distributed.

Cases: links with a null end, and links of a node with itself, connect nothing (and name no node of the answer); repeated links count once; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept_at, stored

#: Rows of a key from which it may be hot, however small the table.
FEW = 64


def hot(keys: DataFrame, name: str, rows: int) -> DataFrame:
    """The keys that have more than a quarter of a partition's mean share of so many rows: four times as many as partitions at the very most, whatever
    the table, and thus fit to be broadcast. Counts are summed per task before they move."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.groupBy(name).agg(F.count("*").alias("rows")).where(F.col("rows") > max(FEW, rows // (4 * parts))).select(name)


def join_on_hot_key(left: DataFrame, right: DataFrame, name: str, hot_keys: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right on a key that right has once. Rows of hot keys stay where they are and get right's few rows for them by broadcast; only the others are shuffled."""
    few = F.broadcast(hot_keys)
    theirs = F.broadcast(hot_keys.join(right.join(few, name, "left_semi"), name, how))  # a row for a hot key
    return left.join(theirs, name).unionByName(left.join(few, name, "left_anti").join(right, name, how))


def star_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, as of components(), by alternating large-star and small-star.

    Large-star hangs each node's larger neighbours on the least node around it, small-star its smaller ones; both keep components as they are, and together they end, after a number of rounds that
    grows with the logarithm of the nodes, in stars around least nodes. Edges are written to the shared checkpoint folder each round; those of a node that very many have stay where they are.
    """
    edges = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("low < high")
    edges, was = stored(edges.distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
        hubs = stored(hot(edges, "low", now[0]))
        # Edges go from the smaller node: these are each node's larger neighbours.
        around = edges.union(edges.select("high", "low")).toDF("low", "near").groupBy("low").agg(F.least(F.min("near"), F.col("low")).alias("center"))
        large = stored(join_on_hot_key(edges, around, "low", hubs).select(F.col("center").alias("low"), "high").distinct())
        forget(hubs, edges)
        hubs = stored(hot(large, "high", now[0]))
        below = large.groupBy("high").agg(F.min("low").alias("center"))
        met = join_on_hot_key(large, below, "high", hubs)
        edges = stored(met.select(F.col("center").alias("low"), "high").union(met.where("low > center").select("center", "low")).distinct())
        forget(hubs, large)
    return kept_at(edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select("low", "low").distinct()), edges)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node of a link.

    Each round every node takes the least label among itself and its neighbours, then the label of that label (pointer jumping), so the
    rounds grow with the logarithm of a path's length. Labels are written to the shared checkpoint folder each round. Nodes, links and labels stay distributed, and
    neither a node with very many links nor a label that very many nodes share meets its rows in one task.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(links.union(links.select("v", "u")).distinct())
    hubs = stored(hot(both, "v", both.count()))
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")))
    nodes = labels.count()
    while True:
        around = join_on_hot_key(both, labels.select(F.col("node").alias("v"), "component"), "v", hubs).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = stored(labels.join(around, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was")))
        # Labels that have a lower label themselves: none where every label is its component's least node.
        used = lower.select("next").distinct()
        jump = stored(lower.where("next < node").select(F.col("node").alias("next"), F.col("next").alias("far")).join(used, "next", "left_semi"))
        done = [labels, lower, jump]
        if jump.isEmpty():
            new = lower.select("node", F.col("next").alias("component"), "was")
        else:
            shared = stored(hot(lower, "next", nodes))
            done.append(shared)
            new = join_on_hot_key(lower, jump, "next", shared, "left").select("node", F.coalesce("far", "next").alias("component"), "was")
        new = stored(new)
        forget(*done)
        if new.where("component <> was").isEmpty():
            forget(both, hubs)
            return kept_at(new.select("node", "component"), new)
        labels = new
