"""Context assembly, curation, agent routing, file triggers and tasks.

Cases: null texts, files, globs and domains match nothing; facts and tasks that repeat an id are answered each; ties go to the smaller id; a task without words, or an empty
table, gets no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.meta import meta_text, patched
from tessera.operators import search
from tessera.operators.matches import matches

TERMINAL = ("completed", "cancelled")
STATES = ("pending", "in_progress", *TERMINAL)


def get_context(facts: DataFrame, tasks: DataFrame, limit: int = 20, subject: str = "") -> DataFrame:
    """task_id, tier, id, score for each task (query_id, text): what a search finds, the invariants and failure modes of the subsystems that it touches,
    triggers whose text shares a word with the task. A fact shows once, in the first of these tiers: invariant, failure_mode, trigger, relevant."""
    live = facts.where("superseded_by is null")
    live = live.where(F.col("subject") == subject) if subject else live
    limit = min(50, limit if limit > 0 else 20)
    found = search.search(live, tasks, search.SearchOptions(max_results=limit), lexical_only="vector" not in tasks.columns).select("query_id", "id", F.col("combined").alias("score"))
    touched = found.join(live.select("id", "subsystem"), "id").where("subsystem <> ''").select("query_id", "subsystem").distinct()
    rules = live.where(F.col("kind").isin("invariant", "failure_mode")).join(touched, "subsystem").select("query_id", "id", F.when(F.col("kind") == "invariant", 0).otherwise(1).alias("tier"), F.lit(0.0).alias("score"))
    fired = matches(live.where("kind = 'trigger'").select("id", "content"), tasks.select("query_id", F.col("text").alias("task")), key="query_id").select("query_id", "id", F.lit(2).alias("tier"), F.lit(0.0).alias("score"))
    every = rules.unionByName(fired).unionByName(found.select("query_id", "id", F.lit(3).alias("tier"), "score"))
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("tier", "score")).alias("x"))
    names = F.array(*map(F.lit, ("invariant", "failure_mode", "trigger", "relevant")))
    return first.select(F.col("query_id").alias("task_id"), names[F.col("x.tier")].alias("tier"), "id", F.col("x.score").alias("score"))


def curate(candidates: DataFrame, most: int = 5, chosen: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The first candidates (rank, id, columns in by), or, with a chooser's answer (columns in by, and ids in its order, as an array), those of its ids that are candidates.

    by: what tells tasks apart; without it, all rows are one task's, few by nature. An id that a chooser names twice counts once, and one that is no candidate not at all.
    """
    if chosen is None:
        return candidates.where(F.col("rank") <= most)
    order = chosen.select(*by, F.posexplode("ids").alias("at", "id")).groupBy(*by, "id").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    return candidates.join(order, [*by, "id"]).withColumn("rank", place).drop("at").where(F.col("rank") <= most)


def suggest_agents(facts: DataFrame, tasks: DataFrame, most: int = 5) -> DataFrame:
    """task_id, rank, id, agent, score, confidence. Routing facts are those of the subsystem agent-routing; 3 for each of their domains in the task, 1 for each task word in their text."""
    routing = facts.where("superseded_by is null and subsystem = 'agent-routing'").withColumn("agent", meta_text(F.col("metadata"), "agent_name")).where("agent <> ''")
    domains = F.coalesce(F.from_json(F.get_json_object("metadata", "$.domains"), "array<string>"), F.array().cast("array<string>"))
    return scored_agents(routing.withColumn("domains", domains), tasks, most)


def scored_agents(routing: DataFrame, tasks: DataFrame, most: int = 5) -> DataFrame:
    """routing: id, agent, domains, content; tasks: task_id, task."""
    rows = matches(routing.select("id", "agent", "domains", "content"), tasks.select("task_id", "task"), most)
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "id")
    # The limit comes before the best score is looked up, which is among the first: so each task cuts its rows before they are shuffled.
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("best", F.max("score").over(Window.partitionBy("task_id")))
    share = F.col("score") / F.col("best")
    return rows.select("task_id", "rank", "id", "agent", "score", F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low").alias("confidence"))


def file_triggers(triggers: DataFrame, files: DataFrame) -> DataFrame:
    """file, trigger id of triggers whose glob (signal) matches a file. Each distinct glob becomes one regular expression, whatever their number."""
    found = paths.glob_matches(files.select("file"), "file", triggers, "signal")
    return found.join(triggers.select("id", "signal"), "signal").select("file", "id")


def new_tasks(requests: DataFrame) -> DataFrame:
    """Facts of kind task, pending, shown on the task surface. requests: content, subject, priority, due."""
    meta = F.to_json(F.struct(F.lit("task").alias("surface"), F.lit("pending").alias("status"), F.nullif("priority", F.lit("")).alias("priority"), F.nullif("due", F.lit("")).alias("due")))
    return requests.select("content", "subject", F.lit("note").alias("category"), F.lit("task").alias("kind"), meta.alias("metadata"))


def update_tasks(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, status, note. A terminal status takes the task off its surface; an unknown status changes nothing here, and is listed by unknown_states."""
    gone = F.when(F.col("status").isin(*TERMINAL), F.lit(',"surface":null')).otherwise(F.lit(""))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(',"note":'), F.to_json(F.struct(F.col("note").alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("note").alias("n")))) - 6))).otherwise(F.lit(""))
    patch = F.concat(F.lit('{"status":"'), F.col("status"), F.lit('"'), gone, note, F.lit("}"))
    c = changes.where(F.col("status").isin(*STATES)).select("id", patch.alias("_patch"))
    return facts.join(c, "id", "left").withColumn("metadata", F.when(F.col("_patch").isNotNull(), patched(F.col("metadata"), F.col("_patch"))).otherwise(F.col("metadata"))).select(facts.columns)


def unknown_states(changes: DataFrame) -> DataFrame:
    """id, status of changes that are refused."""
    return changes.where(~F.coalesce(F.col("status").isin(*STATES), F.lit(False))).select("id", "status")


def list_tasks(facts: DataFrame, status: str = "pending") -> DataFrame:
    rows = facts.where("kind = 'task' and superseded_by is null").withColumn("status", meta_text(F.col("metadata"), "status"))
    return rows.where(F.col("status") == status).orderBy("id") if status else rows.orderBy("id")


def task_rows(tasks: DataFrame) -> DataFrame:
    """id, text: a task as one line, all of it as it's stored; null for a null id. What its metadata doesn't have, or has null, is empty; a due date is shown only where there is one."""
    of = lambda key: F.coalesce(meta_text(F.col("metadata"), key), F.lit(""))
    due = F.when(of("due") != "", F.concat(F.lit(", due="), of("due"))).otherwise(F.lit(""))
    content = F.coalesce("content", F.lit(""))
    return tasks.select("id", F.concat(F.lit("[id="), F.col("id").cast("string"), F.lit("] ["), of("status"), F.lit("] "), content, F.lit(" (scope="), of("scope"), F.lit(", priority="), of("priority"), due, F.lit(")\n")).alias("text"))


def allows(scopes: Column, want: str) -> Column:
    """Whether a token's scopes grant one: admin grants read and write, no scopes grant read and write, ingest is only granted by name."""
    named = F.array_contains(scopes, want)
    return named | ((F.array_contains(scopes, "admin") | (F.size(scopes) == 0)) & F.lit(want in ("read", "write")))
