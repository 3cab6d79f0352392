"""Export and import of facts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = 1
#: Users up to which their names are broadcast.
FEW_USERS = 1_000_000


def export_facts(facts: DataFrame, users: DataFrame) -> DataFrame:
    """All facts, replaced ones too, with their owner's name (empty if unknown) and without vectors. Written by id ranges: sort only what is read back in order."""
    # Dealt by user, all facts of one would meet in one task: names go to the facts instead, as long as they are few.
    names = users.select(F.col("id").alias("user_id"), F.col("name").alias("owner"))
    names = F.broadcast(names) if users.count() <= FEW_USERS else names
    rows = facts.drop("embedding", "embed_failed_at", "embed_error").join(names, "user_id", "left")
    return rows.withColumn("owner", F.coalesce("owner", F.lit(""))).withColumn("version", F.lit(VERSION))


def write_export(facts: DataFrame, users: DataFrame, path: str) -> None:
    export_facts(facts, users).write.json(path)


def import_facts(target: DataFrame, export: DataFrame, owner: int, start: int, skip_duplicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(facts to add, map of old to new ids). Ids are dealt anew, dense within each partition's share; chains are restored with their times, use and confirmation counts are not.

    A row of another version is an error. Duplicates (content, subject and namespace, active) of target, and their pointers, are left out.
    """
    wrong = export.where(F.col("version") != VERSION).limit(1).count()
    if wrong:
        raise ValueError(f"only version {VERSION} can be read")
    rows = export.withColumnRenamed("id", "old_id")
    if skip_duplicates:
        rows = rows.join(target.where("superseded_by is null").select("content", "subject", "namespace"), ["content", "subject", "namespace"], "left_anti")
    ids = dense_ids(rows.select("old_id"), "old_id", start)
    chain = ids.select(F.col("old_id").alias("superseded_by"), F.col("id").alias("_next"))
    out = rows.join(ids, "old_id").join(chain, "superseded_by", "left")
    out = out.withColumn("superseded_at", F.when(F.col("_next").isNotNull(), F.col("superseded_at"))).withColumn("superseded_by", F.col("_next"))
    out = out.withColumns({"user_id": F.lit(owner).cast("long"), "use_count": F.lit(0), "confirmed_count": F.lit(0)})
    return out.select([c for c in target.columns if c in out.columns]), ids


def dense_ids(keys: DataFrame, key: str, start: int, width: int = 1 << 20) -> DataFrame:
    """key, id: start + 1, start + 2, ... in order of the key, without one task for all rows.

    Keys fall into ranges of width; counts of ranges (few) are summed up in order, and rows are numbered within their range.
    """
    spans = keys.select(key, F.floor(F.col(key) / width).alias("_span"))
    sizes = spans.groupBy("_span").agg(F.count("*").alias("n"))
    before = sizes.select("_span", (F.sum("n").over(Window.orderBy("_span")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy(key))
    return spans.withColumn("_place", place).join(before, "_span").select(key, (F.col("_before") + F.col("_place") + start).cast("long").alias("id"))


def backfill_kind(facts: DataFrame) -> DataFrame:
    """Old rows keep their kind in metadata: it moves to the column where that is empty."""
    from tessera.functions.meta import meta_text

    return facts.withColumn("kind", F.when(F.coalesce("kind", F.lit("")) == "", F.coalesce(meta_text(F.col("metadata"), "kind"), F.lit(""))).otherwise(F.col("kind")))


def backfill_owner(facts: DataFrame, owner: int, name: str) -> DataFrame:
    """Rows without an owner get one; a subject that only named the owner is emptied, but for identity and preference facts."""
    marks = (F.col("subject") == name) & ~F.col("category").isin("identity", "preference")
    return facts.withColumn("user_id", F.coalesce("user_id", F.lit(owner).cast("long"))).withColumn("subject", F.when(marks, "").otherwise(F.col("subject")))
