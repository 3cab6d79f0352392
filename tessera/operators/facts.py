"""Scoping, filters and point reads of facts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.meta import MetaFilter, meta_filter


@dataclass(frozen=True)
class Scope:
    """Whose facts a query sees: one namespace, a list, or all; one user, or all for a service."""

    namespace: str | None = None
    namespaces: tuple[str, ...] = ()
    every_namespace: bool = False
    user_id: int | None = None


@dataclass(frozen=True)
class Options:
    """Filters of a listing; an empty string is no filter."""

    subject: str = ""
    category: str = ""
    kind: str = ""
    subsystem: str = ""
    only_active: bool = True
    ids: tuple[int, ...] = ()
    metadata: tuple[MetaFilter, ...] = field(default=())
    created_from: object = None
    created_to: object = None
    limit: int = 0


def scope(facts: DataFrame, s: Scope, listing: bool = False) -> DataFrame:
    """Applied before anything else. A listing never spans all namespaces."""
    if not (s.every_namespace and not listing):
        names = s.namespaces or ((s.namespace,) if s.namespace is not None else ())
        if names:
            facts = facts.where(F.col("namespace").isin(*names))
    return facts if s.user_id is None else facts.where(F.col("user_id") == s.user_id)


def predicate(o: Options) -> Column:
    out = F.lit(True)
    for name in ("subject", "category", "kind", "subsystem"):
        if value := getattr(o, name):
            out &= F.col(name) == value
    if o.only_active:
        out &= F.col("superseded_by").isNull()
    if o.ids:
        out &= F.col("id").isin(*o.ids)
    for f in o.metadata:
        out &= meta_filter(F.col("metadata"), f)
    if o.created_from is not None:
        out &= F.col("created_at") >= F.lit(o.created_from)
    if o.created_to is not None:
        out &= F.col("created_at") <= F.lit(o.created_to)
    return out


def list_facts(facts: DataFrame, o: Options = Options(), s: Scope = Scope()) -> DataFrame:
    found = scope(facts, s, listing=True).where(predicate(o)).orderBy("id")
    return found.limit(o.limit) if o.limit > 0 else found


def get(facts: DataFrame, fact_id: int) -> DataFrame:
    return facts.where(F.col("id") == fact_id)


def by_subject(facts: DataFrame, subject: str, only_active: bool = True) -> DataFrame:
    return list_facts(facts, Options(subject=subject, only_active=only_active))


def exists(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (content, subject, namespace, other columns) that some fact equals exactly."""
    return probes.join(facts.select("content", "subject", "namespace"), ["content", "subject", "namespace"], "left_semi")


def absent(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked ids (id) that no fact has, once each: what a read, a confirmation or a deletion reports as not found."""
    return ids.select("id").where("id is not null").distinct().join(facts.select("id"), "id", "left_anti")


def active_count(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_by is null").agg(F.count("*").alias("n"))


def list_subsystems(facts: DataFrame, subject: str = "") -> DataFrame:
    return facts.where(predicate(Options(subject=subject))).where("subsystem <> ''").select("subsystem").distinct().orderBy("subsystem")


def status(facts: DataFrame, cap: int = 20) -> DataFrame:
    """Counts of active facts by subject (the first cap, then the rest as one), category and non-empty kind, in one pass over facts.

    dimension, key, n, position; ordered by count, then key.
    """
    active = facts.where("superseded_by is null")
    sets = active.groupingSets([["subject"], ["category"], ["kind"]], "subject", "category", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    rows = sets.select(F.when(F.col("g") == 3, "subject").when(F.col("g") == 5, "category").otherwise("kind").alias("dimension"), F.coalesce("subject", "category", "kind").alias("key"), "n")
    rows = rows.where("dimension <> 'kind' or key <> ''")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key"))
    rows = rows.withColumn("position", place)
    shown = (F.col("dimension") != "subject") | (F.col("position") <= cap)
    rest = rows.where(~shown).groupBy("dimension").agg(F.concat(F.lit("+"), F.count("*").cast("string"), F.lit(" more")).alias("key"), F.sum("n").alias("n")).withColumn("position", F.lit(cap + 1))
    return rows.where(shown).unionByName(rest)
