"""Writes as functions from snapshots to snapshots: (table, change) -> table. A change is a table, however many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.meta import patched
from tessera.functions.text import cut_bytes
from tessera.schemas import MAX_CONTENT


def checked(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose content fits, and the others."""
    good = F.length("content") <= MAX_CONTENT
    return new.where(good), new.where(~F.coalesce(good, F.lit(False)))


def insert(facts: DataFrame, new: DataFrame, namespace: str, user_id: int, now) -> DataFrame:
    """facts with new rows (id given by the caller): the namespace is stamped, the owner and the time are defaults."""
    have = new.columns
    rows = new
    for name, kind in facts.dtypes:
        if name == "namespace":
            value = F.lit(namespace)
        elif name == "user_id":
            value = F.coalesce("user_id", F.lit(user_id)) if "user_id" in have else F.lit(user_id)
        elif name == "created_at":
            value = F.coalesce("created_at", F.lit(now).cast("timestamp")) if "created_at" in have else F.lit(now)
        elif name in ("kind", "subsystem"):
            value = F.coalesce(name, F.lit("")) if name in have else F.lit("")
        elif name in ("confirmed_count", "use_count"):
            value = F.coalesce(name, F.lit(0)) if name in have else F.lit(0)
        else:
            value = F.col(name) if name in have else F.lit(None)
        rows = rows.withColumn(name, value.cast(kind))
    return facts.unionByName(checked(rows.select(facts.columns))[0])


def with_ids(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Dense ids from start + 1 by the order's hash-free sort: for batches of a caller's size, not for bulk loads."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("long") + start)


def supersede(facts: DataFrame, pairs: DataFrame, now) -> DataFrame:
    """pairs: old_id, new_id. An old fact is replaced once, and only by a fact that exists."""
    real = pairs.join(facts.select(F.col("id").alias("new_id")), "new_id", "left_semi").groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("_new"))
    free = F.col("superseded_by").isNull() & F.col("_new").isNotNull()
    out = facts.join(real, "id", "left").withColumn("superseded_at", F.when(free, F.lit(now).cast("timestamp")).otherwise(F.col("superseded_at")))
    return out.withColumn("superseded_by", F.coalesce("superseded_by", "_new")).select(facts.columns)


def _bump(facts: DataFrame, ids: DataFrame, count: str, stamp: str, now) -> DataFrame:
    hits = ids.groupBy("id").agg(F.lit(1).alias("_hit"))
    out = facts.join(hits, "id", "left")
    changes = {count: F.coalesce(count, F.lit(0)) + F.coalesce("_hit", F.lit(0))}
    if stamp in facts.columns:
        changes[stamp] = F.when(F.col("_hit").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col(stamp))
    return out.withColumns(changes).select(facts.columns)


def confirm(facts: DataFrame, ids: DataFrame, now) -> DataFrame:
    return _bump(facts, ids, "confirmed_count", "last_confirmed_at", now)


def touch(facts: DataFrame, ids: DataFrame, now) -> DataFrame:
    """One more use of each id; ids that aren't there do nothing."""
    return _bump(facts, ids, "use_count", "last_used_at", now)


def delete(facts: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids; a link goes with either of its ends."""
    gone = ids.select("id").distinct()
    left = links.join(gone, F.col("source_id") == F.col("id"), "left_anti") if "id" not in links.columns else links.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return facts.join(gone, "id", "left_anti"), left.select(links.columns)


def patch_metadata(facts: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id, patch (JSON object); a value sets its key, null deletes it."""
    out = facts.join(patches.select("id", F.col("patch").alias("_patch")), "id", "left")
    return out.withColumn("metadata", F.when(F.col("_patch").isNotNull(), patched(F.col("metadata"), F.col("_patch"))).otherwise(F.col("metadata"))).select(facts.columns)


def set_embedding(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors: id, vector. Clears a quarantine."""
    out = facts.join(vectors.select("id", F.col("vector").alias("_v")), "id", "left")
    for c in ("embed_failed_at", "embed_error"):
        if c in facts.columns:
            out = out.withColumn(c, F.when(F.col("_v").isNull(), F.col(c)))
    return out.withColumn("embedding", F.coalesce("_v", "embedding")).select(facts.columns)


def mark_embed_failed(facts: DataFrame, failures: DataFrame, now) -> DataFrame:
    """failures: id, error."""
    out = facts.join(failures.select("id", F.col("error").alias("_e")), "id", "left")
    return out.withColumn("embed_failed_at", F.when(F.col("_e").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("embed_failed_at"))).withColumn("embed_error", F.coalesce("_e", "embed_error")).select(facts.columns)


def pending(facts: DataFrame, limit: int = 100) -> DataFrame:
    """Facts without a vector and not quarantined, by id."""
    quarantined = F.col("embed_failed_at").isNotNull() if "embed_failed_at" in facts.columns else F.lit(False)
    return facts.where(F.col("embedding").isNull() & ~quarantined).orderBy("id").limit(limit)


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table plus the first new row (by order) of each key that it hasn't."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = new.withColumn("_place", place).where("_place = 1").select(table.columns)
    return table.unionByName(first.join(table.select(keys), keys, "left_anti").select(table.columns))


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Defaults: type reference, one way, no label."""
    values = {"link_type": F.lit("reference"), "bidirectional": F.lit(False), "label": F.lit("")}
    for name, kind in links.dtypes:
        value = F.col(name) if name in new.columns else F.lit(None)
        new = new.withColumn(name, F.coalesce(value, values[name]).cast(kind) if name in values else value.cast(kind))
    return links.unionByName(new.select(links.columns))


def owned_links(new: DataFrame, facts: DataFrame, namespace: str, user_id: int | None = None) -> DataFrame:
    """new links (id, source_id, target_id, other columns) with user_id and error: both ends must be facts of the namespace and of one owner, the given one if there is one.

    A fact of somebody else fails just as one that isn't there. Of several owners of both ends (facts that repeat an id) the smallest counts; a null owner is one too. Each end is looked
    up in turn: nothing is gathered by link.
    """
    there = facts.where(F.col("namespace") == namespace)
    there = there if user_id is None else there.where(F.col("user_id") == user_id)
    owners = there.groupBy("id").agg(F.collect_set(F.struct(F.col("user_id").alias("owner"))).alias("of"))
    out = new.drop("user_id", "error")
    for end, name in (("source_id", "_from"), ("target_id", "_to")):
        out = out.join(owners.select(F.col("id").alias(f"{name}_id"), F.col("of").alias(name)), F.col(end) == F.col(f"{name}_id"), "left").drop(f"{name}_id")
    both = F.when(F.col("id").isNotNull(), F.array_intersect("_from", "_to"))
    good = F.coalesce(F.size(both) > 0, F.lit(False))
    owner = F.array_min(F.transform(both, lambda o: o["owner"]))
    return out.withColumn("user_id", F.when(good, owner)).withColumn("error", F.when(~good, "fact not found")).drop("_from", "_to")


def update_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, label, metadata. An empty label keeps the old one; empty metadata becomes null."""
    c = changes.select("id", F.col("label").alias("_label"), F.col("metadata").alias("_meta"), F.lit(True).alias("_hit"))
    out = links.join(c, "id", "left").withColumn("label", F.coalesce(F.nullif("_label", F.lit("")), F.col("label")))
    return out.withColumn("metadata", F.when(F.col("_hit"), F.nullif("_meta", F.lit(""))).otherwise(F.col("metadata"))).select(links.columns)


def delete_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select("id"), "id", "left_anti")


def consume_hints(hints: DataFrame, ids: DataFrame, now) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return hints.join(hit, "id", "left").withColumn("consumed_at", F.when(F.col("_hit") & F.col("consumed_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("consumed_at"))).select(hints.columns)


def history_by_subject(facts: DataFrame, subject: Column | None = None) -> DataFrame:
    """id, subject, position, chain_length: all facts of a subject, replaced ones too, in order of creation."""
    rows = facts if subject is None else facts.where(F.col("subject") == subject)
    w = Window.partitionBy("subject")
    return rows.select("id", "subject", (F.row_number().over(w.orderBy("created_at", "id")) - 1).alias("position"), F.count("*").over(w).cast("int").alias("chain_length"))


def preview(text: Column, limit: int = 100) -> Column:
    return cut_bytes(text, limit, "...")
