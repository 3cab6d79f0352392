"""Sessions: transcripts, turns, hints, injections, feedback, and what is made of them.

Cases: null contents are left out of texts (and a session of only such has none); turns that share a number come by their text; ratings and injections that repeat a row count each,
but where a key says first or distinct; sessions without rows have no row; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cut_bytes

TURN_BYTES, CORPUS_BYTES = 16 * 1024, 120 * 1024
RECENT_FILES, IDLE_SECONDS = 20, 3600


def parse_transcript(lines: DataFrame, line: str = "value", session: str = "session_id", order: str = "line_no") -> DataFrame:
    """session_id, uuid, turn_index, role, content of a transcript in JSON Lines: user and assistant entries with text.

    Content is a string (of a user), or the text items of an array, a line each; entries without text and broken lines are left out.
    """
    v = F.try_parse_json(line)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    items = get("$.message.content", "array<variant>")
    texts = F.filter(F.transform(items, lambda i: F.when(F.try_variant_get(i, "$.type", "string") == "text", F.try_variant_get(i, "$.text", "string"))), lambda t: t.isNotNull() & (t != ""))
    kind = F.schema_of_variant(get("$.message.content", "variant"))
    content = F.when(kind == "STRING", F.when(get("$.type", "string") == "user", get("$.message.content", "string"))).otherwise(F.array_join(texts, "\n"))
    rows = lines.select(session, order, get("$.type", "string").alias("role"), get("$.uuid", "string").alias("uuid"), content.alias("content"))
    rows = rows.where("role in ('user', 'assistant') and content <> ''")
    index = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    return rows.select(F.col(session).alias("session_id"), "uuid", index.alias("turn_index"), "role", "content")


def hook_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """session_id and cwd as far as the payload has them, and the payload itself."""
    return payloads.select(F.get_json_object(payload, "$.session_id").alias("session_id"), F.get_json_object(payload, "$.cwd").alias("cwd"), F.col(payload).alias("payload"))


def turns_of(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.where(F.col("session_id") == session_id).orderBy("turn_index")


def newest(turns: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))


def _joined(rows: DataFrame, text: str, newest_first: bool, between: str, name: str) -> DataFrame:
    got = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", text)), asc=not newest_first).alias("x"))
    return got.select("session_id", F.array_join(F.transform("x", lambda t: t[text]), between).alias(name))


def search_query(turns: DataFrame, last: int = 3, most: int = 200) -> DataFrame:
    """session_id, query: the last user turns, newest first, cut to bytes."""
    users = turns.where("role = 'user'").withColumn("k", newest(turns)).where(F.col("k") <= last)
    return _joined(users.select("session_id", "turn_index", cut_bytes(F.col("content"), most).alias("t")), "t", True, " ", "query")


def snippet(turns: DataFrame, last: int = 3, most: int = 500) -> DataFrame:
    """session_id, snippet: the last turns in order, each [role]: text, cut to bytes."""
    rows = turns.withColumn("k", newest(turns)).where(F.col("k") <= last)
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), cut_bytes(F.col("content"), most, "…"))
    return _joined(rows.select("session_id", "turn_index", line.alias("t")), "t", False, "\n", "snippet")


def corpus_text(turns: DataFrame, turn_bytes: int = TURN_BYTES, total: int = CORPUS_BYTES) -> DataFrame:
    """session_id, text: turns from the newest back while they fit, then in order. The first that doesn't fit ends it, so a running sum decides."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), cut_bytes(F.col("content"), turn_bytes, "…"))
    rows = turns.select("session_id", "turn_index", line.alias("t"))
    back = Window.partitionBy("session_id").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.octet_length("t") + 5).over(back)).where(F.col("used") <= total)
    return _joined(rows, "t", False, "\n---\n", "text")


def feedback_stats(feedback: DataFrame, ref_type: str = "fact") -> DataFrame:
    return feedback.where(F.col("ref_type") == ref_type).groupBy("ref_id").agg(F.avg("score").alias("avg"), F.count("*").alias("n"))


def feedback_average(feedback: DataFrame, refs: DataFrame, ref_type: str = "fact") -> DataFrame:
    """ref_id, avg of each asked reference; 0 without ratings."""
    return refs.select("ref_id").distinct().join(feedback_stats(feedback, ref_type), "ref_id", "left").select("ref_id", F.coalesce("avg", F.lit(0.0)).alias("avg"))


def record_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """One rating for each reference and session: the first stays. Scores other than 1 and -1 are refused."""
    from tessera.operators.lifecycle import insert_if_absent

    return insert_if_absent(feedback, new.where("score in (-1, 1)"), ["ref_type", "ref_id", "session_id"], ["score"])


def pending_hints(hints: DataFrame, session_id: str = "", cwd: str = "") -> DataFrame:
    """Unconsumed hints of the session or of the directory, best first."""
    mine = (F.col("session_id") == session_id) | ((F.col("cwd") == cwd) if cwd else F.lit(False))
    return hints.where("consumed_at is null").where(mine).orderBy(F.desc(F.col("relevance") * F.col("desirability")), "id")


def hint_record(results: DataFrame, session: str = "session_id") -> DataFrame:
    """session_id, retrieved_ids (by rank), candidate_scores, relevance (mean vector score, 0 for none) of search results (session, rank, id, combined, vec)."""
    rows = results.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "combined"))).alias("x"), F.coalesce(F.avg("vec"), F.lit(0.0)).alias("relevance"))
    return rows.select(session, F.transform("x", lambda r: r["id"]).alias("retrieved_ids"), F.map_from_entries(F.transform("x", lambda r: F.struct(r["id"], r["combined"]))).alias("candidate_scores"), "relevance")


def desirability(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(3.0), value))


def worth_a_hint(value: Column, n_results: Column) -> Column:
    return ~((desirability(value) < 0.5) & (n_results == 0))


def hint_injections(hints: DataFrame, injections: DataFrame) -> DataFrame:
    """Hints that were shown: their injection names them by id, as text."""
    return hints.join(injections.where("ref_type = 'hint'").select(F.col("ref_id").cast("long").alias("id"), F.col("session_id").alias("shown_in"), "rank"), "id")


def injected_facts(injections: DataFrame, session_id: str) -> DataFrame:
    return injections.where((F.col("session_id") == session_id) & (F.col("ref_type") == "fact")).orderBy("rank")


def unrated_sessions(injections: DataFrame, turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sessions that were shown facts and have turns, but no rating."""
    shown = injections.where("ref_type = 'fact'").select("session_id").distinct()
    return shown.join(turns.select("session_id"), "session_id", "left_semi").join(feedback.select("session_id"), "session_id", "left_anti")


def backfill(injections: DataFrame, turns: DataFrame, feedback: DataFrame, facts: DataFrame, rater) -> DataFrame:
    """Ratings of each shown fact of unrated sessions by a plug-in: rater(content, snippet) -> score; anything but -1 counts as 1."""
    open_ = unrated_sessions(injections, turns, feedback)
    shown = injections.where("ref_type = 'fact'").join(open_, "session_id").join(snippet(turns), "session_id")
    rows = shown.join(facts.select(F.col("id").cast("string").alias("ref_id"), "content"), "ref_id")
    score = rater(F.col("content"), F.col("snippet"))
    return rows.select("ref_id", F.lit("fact").alias("ref_type"), "session_id", F.when(score == -1, -1).otherwise(1).alias("score"), F.lit("backfill").alias("reason"))


def summary_route(scope: Column, project: Column, persona: Column) -> Column:
    """subject, category, scope of a session summary; an unknown scope counts as the project's."""
    who = F.when(F.coalesce(persona, F.lit("")) == "", F.lit("user")).otherwise(persona)
    one = lambda s, c, name: F.struct(s.alias("subject"), F.lit(c).alias("category"), F.lit(name).alias("scope"))
    return F.when(scope == "general", one(F.lit("general"), "note", "general")).when(scope == "user", one(who, "identity", "user")).when(scope == "preference", one(who, "preference", "preference")).otherwise(one(project, "project", "project"))


def summary_text(lead: Column, decisions: Column, outcomes: Column) -> Column:
    """A lead, then bulleted decisions and outcomes, blank entries dropped; empty if all are."""
    def bullets(title: str, items: Column) -> Column:
        kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
        return F.when(F.size(kept) > 0, F.concat(F.lit(title + ":\n- "), F.array_join(kept, "\n- ")))

    return F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce(lead, F.lit(""))), F.lit("")), bullets("Decisions", decisions), bullets("Outcomes", outcomes))


def recent_files(touches: DataFrame, most: int = RECENT_FILES) -> DataFrame:
    """session_id, files: the files last touched, oldest first, in each session's last unbroken stretch (no pause of IDLE_SECONDS).

    touches: session_id, file, ts.
    """
    w = Window.partitionBy("session_id").orderBy("ts")
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = F.coalesce(seconds - F.lag(seconds).over(w) >= IDLE_SECONDS, F.lit(False)).cast("int")
    rows = touches.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(w))
    rows = rows.withColumn("last", F.max("stretch").over(Window.partitionBy("session_id"))).where("stretch = last")
    latest = rows.groupBy("session_id", "file").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), "file"))
    latest = latest.withColumn("k", place).where(F.col("k") <= most)
    return latest.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "file"))).alias("x")).select("session_id", F.transform("x", lambda t: t["file"]).alias("files"))
