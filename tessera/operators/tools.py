"""What agents call: a search with its own defaults that notes the use of what it returns, and a store that may replace a fact.

Cases: a blank query finds nothing; null texts count as empty; repeated ids of queries or items are the caller's error; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import extract, lifecycle, search
from tessera.operators.facts import Options, Scope, predicate, scope
from tessera.sources.tables import written

DEFAULT, MOST = 10, 50
#: Notes fade; preferences and identity don't.
NOTE_HALF_LIFE_S = 30 * 86400


def tool_search(facts: DataFrame, queries: DataFrame, limit: int = 0, filters: Options = Options(), s: Scope = Scope(), now="2025-01-01", o: search.SearchOptions = search.SearchOptions(), scorer=None, kept=None) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, id, score, use_count; facts with the use of the found ones counted).

    limit: DEFAULT if not positive, MOST at most. Scope and filters come before ranking and statistics. Without vectors (of queries, or of facts), the search is lexical.
    kept: postings of the facts that scope and filters leave, or of more, whose statistics hold then.
    """
    own = scope(facts, s).where(predicate(filters))
    o = replace(o, max_results=min(MOST, limit if limit > 0 else DEFAULT), category_half_life_s={"note": NOTE_HALF_LIFE_S})
    lexical = "vector" not in queries.columns or "embedding" not in facts.columns
    found = written(search.search(own, queries.where(F.trim("text") != ""), o, now, lexical_only=lexical, scorer=scorer, kept=kept))
    used = lifecycle.touch(facts, found.select("id").distinct(), now)
    shown = found.join(facts.select("id", "use_count"), "id").select("query_id", "rank", "id", F.col("combined").alias("score"), (F.col("use_count") + 1).alias("use_count"))
    return shown, used


def tool_store(facts: DataFrame, items: DataFrame, namespace: str, user_id: int, now) -> tuple[DataFrame, DataFrame]:
    """(facts with what was stored, a report). items: item, id (of the new fact), content, subject, category, and supersedes (an old fact's id, or null).

    Report: item, status (error, duplicate, stored), error, superseded, warning: a replacement that fails (no such fact, or already replaced) leaves the new fact stored.
    """
    planned = written(extract.store_batch(facts.where(F.col("namespace") == namespace), items, limit=2**31 - 1).select("item", "status", "error"))
    stored = items.join(planned.where("status = 'stored'").select("item"), "item", "left_semi")
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("note"))
    new = stored.select("id", F.trim("content").alias("content"), F.trim("subject").alias("subject"), category.alias("category"))
    pairs = stored.where("supersedes is not null").select(F.col("supersedes").alias("old_id"), F.col("id").alias("new_id"))
    after = written(lifecycle.supersede(lifecycle.insert(facts, new, namespace, user_id, now), pairs, now))
    done = after.select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id")).join(pairs, ["old_id", "new_id"], "left_semi")
    done = done.join(facts.where("superseded_by is null").select(F.col("id").alias("old_id")), "old_id", "left_semi")
    report = planned.join(items.select("item", "id", "supersedes"), "item").join(done.select(F.col("new_id").alias("id"), F.col("old_id").alias("superseded")), "id", "left")
    failed = (F.col("status") == "stored") & F.col("supersedes").isNotNull() & F.col("superseded").isNull()
    return after, report.select("item", "status", "error", "superseded", F.when(failed, F.concat(F.lit("fact "), F.col("supersedes").cast("string"), F.lit(" was not replaced"))).alias("warning"))
