"""Version chains and the link graph.

Cases: ids of facts are unique; pointers and link ends that are null, or name a fact that isn't there, lead nowhere; repeated links are answered each (a neighbourhood and its hops
count a fact once); ties go to the smaller id; empty tables give empty tables; other columns are kept by links_of and neighbours, and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lifecycle import preview
from tessera.operators.similar import near
from tessera.sources.tables import written

#: Facts up to which those that a hop starts from are broadcast.
FEW = 1_000_000


def directed(links: DataFrame) -> DataFrame:
    """Every way a link can be walked: from, to, out (along it), both ways for a bidirectional one."""
    there = links.select("*", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    back = links.where("bidirectional").select("*", F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"))
    return there.unionByName(back)


def links_of(links: DataFrame, ids: DataFrame, direction: str = "both", types: tuple[str, ...] = ()) -> DataFrame:
    """ids: fact_id. Links of each, with fact_id and the other end: outbound along a link (or either way on a bidirectional one), inbound against it, both for any touch."""
    if types:
        links = links.where(F.col("link_type").isin(*types))
    out = links.select("*", F.col("source_id").alias("fact_id"), F.col("target_id").alias("other_id"))
    into = links.select("*", F.col("target_id").alias("fact_id"), F.col("source_id").alias("other_id"))
    sides = {"outbound": out.unionByName(into.where("bidirectional")), "inbound": into.unionByName(out.where("bidirectional")), "both": out.unionByName(into.where("source_id <> target_id"))}
    return sides[direction].join(ids.select("fact_id").distinct(), "fact_id", "left_semi")


def neighbours(links: DataFrame, facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with the other fact's subject and the beginning of its content; null where the fact is gone."""
    other = facts.select(F.col("id").alias("other_id"), F.col("subject").alias("other_subject"), preview(F.col("content")).alias("preview"))
    return links_of(links, ids).join(other, "other_id", "left")


def degrees(links: DataFrame) -> DataFrame:
    end = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = links.select(F.explode(F.array(end("source_id", 1, 0), end("target_id", 0, 1))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbourhood(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id and least hops of every fact within reach of the seeds (id), along links.

    Links are read once and written by their ends; each hop then reads them as they lie, beside the facts last reached, as long as those are few (FEW).
    """
    edges = written(directed(links).select("from_id", "to_id").where("from_id is not null and to_id is not null"))
    reached = written(seeds.select("id", F.lit(0).alias("hops")).distinct())
    edge = reached.select("id")
    for k in range(1, hops + 1):
        few = edge.count() <= FEW
        near_ = edges.join(F.broadcast(edge) if few else edge, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
        edge = written(near_.join(reached, "id", "left_anti"))
        reached = reached.unionByName(edge.select("id", F.lit(k).alias("hops")))
    return reached


def predecessors(facts: DataFrame) -> DataFrame:
    """id, up (the fact before, or itself), far (1 or 0). Several old facts may name one successor: its predecessor is the smallest."""
    old = facts.select(F.col("superseded_by").alias("id"), F.col("id").alias("old")).where("id is not null").groupBy("id").agg(F.min("old").alias("old"))
    return facts.select("id").join(old, "id", "left").select("id", F.coalesce("old", "id").alias("up"), F.col("old").isNotNull().cast("long").alias("far"))


def doubled(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, root, position of the facts that pointers lead back to a first one, and id of those on cycles. Pointers are doubled, a join a round."""
    before = -1
    while True:
        above = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        step = written(step.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("far2") > 0).alias("open")))
        still = step.where("open").count()
        if still in (0, before):  # every round ends some chain; if none, only cycles are left
            return step.where("not open").select("id", F.col("up").alias("root"), F.col("far").alias("position")), step.where("open").select("id")
        before, step = still, step.drop("open")


def chain_positions(facts: DataFrame) -> DataFrame:
    """id, root, position of every fact, for all chains at once.

    The longest chain of n facts takes log2(n) rounds of one join; a pointer to a fact that isn't there ends a chain. Facts on a cycle, which have no first, are left out.
    """
    return doubled(predecessors(facts))[0]


def places_in_chains(facts: DataFrame) -> DataFrame:
    """id, root, position, turns of every fact: as chain_positions, and facts on a cycle by their place after its smallest id, with the cycle's length (null elsewhere)."""
    step = written(predecessors(facts))
    straight, turning = doubled(step)
    straight = straight.withColumn("turns", F.lit(None).cast("long"))
    ring = written(turning.join(step, "id").select("id", "up"))
    if ring.isEmpty():
        return straight
    low = ring.withColumn("low", F.least("id", "up"))
    while True:  # the least id among more and more predecessors, until none of them changes
        above = low.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        low = written(low.join(above, "up").select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        if low.where("moved").isEmpty():
            break
        low = low.drop("moved")
    cut = ring.join(low.select("id", "low"), "id").select("id", F.when(F.col("id") == F.col("low"), F.col("id")).otherwise(F.col("up")).alias("up"), (F.col("id") != F.col("low")).cast("long").alias("far"))
    placed = doubled(cut)[0]
    return straight.unionByName(placed.join(placed.groupBy("root").agg(F.count("*").alias("turns")), "root").select("id", "root", "position", "turns"))


def history(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """start, id, position, chain_length: the chain through each start id, oldest first.

    A chain goes back to the smallest predecessor each time, and forward along superseded_by; it ends where a fact comes again, isn't there, or has no successor. Places of all
    facts come from pointer doubling, so a long chain costs no more than its rows. Forward from a fact that isn't its successor's smallest predecessor, a chain
    goes on in that successor's: a round for each such change. A start that isn't there has no rows; repeated starts count once; null ids and other columns are ignored.
    """
    pos = written(places_in_chains(facts.where("id is not null")))
    after = facts.select("id", F.col("superseded_by").alias("next"))
    tails = pos.where("turns is null").groupBy("root").agg((F.max("position") + 1).alias("length"), F.max_by("id", "position").alias("id"))
    lands = pos.select(F.col("id").alias("next"), F.col("root").alias("to"), F.col("position").alias("at"), "turns")
    tails = written(tails.join(after, "id", "left").join(lands, "next", "left").select("root", "length", "to", "at", "turns"))
    lengths = tails.select(F.col("root").alias("to"), F.col("length").alias("to_length"))

    starts = ids.select(F.col("id").alias("start")).distinct().join(pos, F.col("start") == F.col("id")).select("start", "root", "position", "turns")
    # A part of a chain: places low to high of a root's, the first of them at offset; of a cycle (turns) all places, from low on.
    straight = starts.where("turns is null").join(tails.select("root", "length"), "root")
    zero = F.lit(0).cast("long")
    parts = straight.select("start", "root", zero.alias("low"), F.col("length").alias("high"), zero.alias("offset"), F.lit(None).cast("long").alias("turns"))
    round_ = starts.where("turns is not null").select("start", "root", F.pmod(F.col("position") + 1, F.col("turns")).alias("low"), F.col("turns").alias("high"), zero.alias("offset"), "turns")
    parts = written(parts.unionByName(round_))
    front = straight.select("start", "root", F.col("length").alias("offset"))
    seen = written(straight.select("start", F.col("root").alias("to"), zero.alias("since")))
    while True:
        hops = front.join(tails.where("to is not null").select("root", "to", "at", "turns"), "root").drop("root")
        hops = hops.join(seen, ["start", "to"], "left").join(lengths, "to", "left").where("since is null or at < since")
        hops = written(hops.withColumn("high", F.coalesce("turns", "since", "to_length")))
        if hops.isEmpty():
            break
        parts = parts.unionByName(hops.select("start", F.col("to").alias("root"), F.col("at").alias("low"), "high", "offset", "turns"))
        front = hops.where("turns is null and since is null").select("start", F.col("to").alias("root"), (F.col("offset") + F.col("high") - F.col("at")).alias("offset"))
        seen = written(seen.unionByName(hops.where("turns is null").select("start", "to", F.col("at").alias("since"))).groupBy("start", "to").agg(F.min("since").alias("since")))
    n = F.coalesce("turns", F.col("high") - F.col("low"))
    whole = parts.groupBy("start").agg(F.sum(n).cast("int").alias("chain_length"))
    rows = parts.join(pos.select("id", "root", "position"), "root").where("turns is not null or (position >= low and position < high)")
    place = F.col("offset") + F.when(F.col("turns").isNotNull(), F.pmod(F.col("position") - F.col("low"), F.col("turns"))).otherwise(F.col("position") - F.col("low"))
    return rows.select("start", "id", place.cast("int").alias("position")).join(whole, "start").select("start", "id", "position", "chain_length")


def auto_links(new: DataFrame, facts: DataFrame, threshold: float = 0.6, most: int = 3) -> DataFrame:
    """source_id, target_id, score: each new fact's nearest active facts of the same subject, from a similarity on; ties go to the smaller id. Pairs come from similar.near, so a hot subject meets in blocks."""
    from pyspark.sql import Window

    a = new.select(F.col("id").alias("source_id"), "subject", F.col("embedding").alias("v"))
    b = facts.where("superseded_by is null").select(F.col("id").alias("target_id"), "subject", F.col("embedding").alias("w"))
    found = near(a, b, "source_id", "target_id", threshold, most).select("source_id", "target_id", "score")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    return found.withColumn("k", place).where(F.col("k") <= most).drop("k")
