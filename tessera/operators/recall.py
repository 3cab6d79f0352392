"""Per-prompt recall: which facts to show for a prompt, one plan for any number of requests.

requests: request_id, prompt, session_id, cwd, result_limit, budget, and project (the name that cwd stands for, or empty). Steps:
keywords by inverse document frequency, a lexical search for each, the vector arm over the whole prompt, triggers by working directory, rules that drop and weigh,
feedback, an optional second stage, facts already seen out, cut by score, count and characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.meta import meta_text
from tessera.functions.text import candidate_words, cut_bytes
from tessera.operators import search
from tessera.sources.tables import written


@dataclass(frozen=True)
class RecallOptions:
    """Fixed values of the recall rules."""

    max_keywords: int = 5
    idf_floor: float = 0.5
    idf_fraction: float = 0.15
    min_ratio: float = 0.3
    min_score: float = 0.35
    fact_chars: int = 300
    both_weight: float = 0.5
    vector_weight: float = 1.5
    trigger_score: float = 2.0
    rerank_pool: int = 16
    rerank_bytes: int = 1500
    rerank_weight: float = 0.7
    rerank_mode: str = "off"
    rerank_threshold: float = 0.0


DEFAULTS = {"result_limit": (5, 20), "budget": (2000, None)}


def with_defaults(requests: DataFrame) -> DataFrame:
    for name, (default, most) in DEFAULTS.items():
        value = F.coalesce(F.when(F.col(name) > 0, F.col(name)), F.lit(default)) if name in requests.columns else F.lit(default)
        requests = requests.withColumn(name, F.least(value, F.lit(most)) if most else value)
    for name in ("session_id", "cwd", "project"):
        requests = requests.withColumn(name, F.coalesce(name, F.lit("")) if name in requests.columns else F.lit(""))
    return requests


def keywords(requests: DataFrame, counts: DataFrame | None, o: RecallOptions = RecallOptions()) -> DataFrame:
    """request_id, word, place. counts: word, df, docs of the population; without it, or with an empty one, the longest words."""
    words = requests.select("request_id", F.posexplode(candidate_words(F.col("prompt"))).alias("at", "word"))
    if counts is None:
        scored = words.withColumn("idf", F.octet_length("word").cast("double")).withColumn("good", F.lit(True))
    else:
        scored = words.join(counts, "word")
        least = F.greatest(o.idf_fraction * F.log(F.col("docs").cast("double")), F.lit(o.idf_floor))
        usable = F.col("docs") > 0
        idf = F.log(F.col("docs") / (F.col("df") + 1))
        scored = scored.withColumn("idf", F.when(usable, idf).otherwise(F.octet_length("word").cast("double"))).withColumn("good", ~usable | (F.col("idf") >= least))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("idf"), "at"))
    return scored.where("good").withColumn("place", place).where(F.col("place") <= o.max_keywords).select("request_id", "word", "place", "idf")


def keyword_hits(facts: DataFrame, requests: DataFrame, words: DataFrame, found: DataFrame | None = None, kept=None) -> DataFrame:
    """request_id, id, lexical (sum over keywords of the normalised, boosted score), hits. found: places of the words, if a scan has them; kept: postings, which take their place."""
    # Each keyword is a query; a word shared by requests is searched once.
    limits = words.join(requests.select("request_id", "result_limit"), "request_id").groupBy("word").agg(F.max("result_limit").alias("most"))
    queries = limits.select(F.xxhash64("word").alias("query_id"), F.col("word").alias("text"), "word", "most")
    # Twice as many as wanted are fetched, and twice that goes into the merge: a word's facts never meet, but for as many as a request may have.
    fetch = 4 * DEFAULTS["result_limit"][1]
    scored = search.bm25(facts, queries.select("query_id", "text"), found=found) if kept is None else kept.bm25(queries, fetch, 4 * F.col("most"), within=facts)
    scored = scored.join(queries.select("query_id", "word", "most"), "query_id")
    best = search.first_of(scored, ("word",), [F.desc("score"), F.col("id")], 4 * F.col("most"), fetch).withColumnRenamed("place", "first").drop("most")
    mine = best.join(words, "word").join(requests.select("request_id", "result_limit"), "request_id")
    mine = mine.where(F.col("first") <= 4 * F.col("result_limit"))
    top = F.max("score").over(Window.partitionBy("request_id", "word"))
    mine = mine.withColumn("norm", F.when(top > 0, F.col("score") / top).otherwise(F.col("score"))).join(facts.select("id", "confirmed_count"), "id")
    mine = mine.withColumn("combined", F.col("norm") + F.least(0.05 * F.coalesce("confirmed_count", F.lit(0)), F.lit(0.15)))
    place = F.row_number().over(Window.partitionBy("request_id", "word").orderBy(F.desc("combined"), "id"))
    mine = mine.withColumn("k", place).where(F.col("k") <= 2 * F.col("result_limit"))
    return mine.groupBy("request_id", "id").agg(F.sum("combined").alias("lexical"), F.count("*").alias("hits"))


def trigger_loads(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, id of facts that triggers on the working directory load."""
    rules = facts.where("kind = 'trigger' and superseded_by is null").where(meta_text(F.col("metadata"), "signal_type") == "cwd_pattern")
    rules = rules.select(
        meta_text(F.col("metadata"), "signal").alias("signal"), F.coalesce(meta_text(F.col("metadata"), "load_subsystem"), F.lit("")).alias("load_subsystem"),
        F.coalesce(meta_text(F.col("metadata"), "load_subject"), F.lit("")).alias("load_subject"), F.from_json(F.get_json_object("metadata", "$.load_kinds"), "array<string>").alias("load_kinds"),
    ).where("signal <> '' and (load_subsystem <> '' or load_subject <> '')")
    found = paths.glob_matches(requests.where("cwd <> ''").select("request_id", "cwd"), "cwd", rules, "signal")
    wanted = found.join(rules, "signal").drop("cwd")
    live = facts.where("superseded_by is null").select("id", "subject", "subsystem", "kind")
    loads = (F.col("load_subsystem").isin("") | (F.col("load_subsystem") == F.col("subsystem"))) & ((F.col("load_subject") == "") | (F.col("load_subject") == F.col("subject")))
    return live.join(wanted, loads).where(F.coalesce(F.size("load_kinds"), F.lit(0)).isin(0, -1) | F.array_contains("load_kinds", F.col("kind"))).select("request_id", "id").distinct()


def suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def project_match(subject: Column, project: Column) -> Column:
    return (F.lower(subject) == F.lower(project)) | (F.lower(F.element_at(F.split(subject, "/"), -1)) == F.lower(project))


def weighed(rows: DataFrame) -> DataFrame:
    """Drops drafts, session noise, triggers, code patterns and other projects' summaries; multiplies score by the rules. rows: facts' columns, request's, score, hits, recent (files)."""
    meta = F.col("metadata")
    surface, quality = F.coalesce(meta_text(meta, "surface"), F.lit("")), F.coalesce(meta_text(meta, "quality"), F.lit(""))
    known, own = F.col("project") != "", project_match(F.col("subject"), F.col("project"))
    drop = quality.startswith("local:") | (F.col("subject") == "session-activity") | (F.col("kind") == "trigger") | ((F.col("kind") == "pattern") & (surface != "project")) | ((F.col("kind") == "summary") & known & ~own)
    symbol = F.col("subject").startswith("file:") | F.col("subject").startswith("sym:") | (surface == "symbol")
    folder, cwd = paths.clean(F.coalesce(meta_text(meta, "project_path"), F.lit(""))), paths.clean(F.col("cwd"))
    inside = (surface == "project") & (F.coalesce(meta_text(meta, "project_path"), F.lit("")) != "") & (F.col("cwd") != "") & ((cwd == folder) | cwd.startswith(F.concat(folder, F.lit("/"))))
    haystack = F.lower(F.concat_ws(" ", "content", "subject"))
    file_hit = F.exists(F.coalesce("recent", F.array().cast("array<string>")), lambda f: F.contains(haystack, F.lower(paths.basename(f))))
    factor = F.when(F.col("kind") == "decision", 1.5).when(F.col("kind").isin("convention", "invariant"), 1.3).otherwise(1.0)
    factor = factor * F.when(symbol, 0.2).otherwise(1.0)
    factor = factor * F.when(known & own & ~symbol, 2.5).when(known & ~own & ~F.col("category").isin("project", "preference"), 0.3).otherwise(1.0)
    factor = factor * F.when(inside, 4.0).otherwise(1.0) * F.when(file_hit, 1.3).otherwise(1.0)
    factor = factor * F.when(F.col("hits") > 1, 1 + 0.2 * (F.col("hits") - 1)).otherwise(1.0)
    return rows.where(~drop).withColumn("score", F.col("score") * factor)


def feedback_factor(avg: Column, n: Column) -> Column:
    """Two to the power of the mean rating, weighed by how many ratings there are."""
    return F.when(n > 0, F.pow(F.lit(2.0), avg * (0.4 + 0.6 * F.least(n, F.lit(5)) / 5.0))).otherwise(1.0)


def fact_block(row_id: Column, subject: Column, category: Column, created: Column, content: Column) -> Column:
    return F.concat(F.lit("[id="), row_id.cast("string"), F.lit("] "), subject, F.lit(" | "), category, F.lit(" | "), F.date_format(F.to_utc_timestamp(created, F.current_timezone()), "yyyy-MM-dd"), F.lit("\n  "), content, F.lit("\n"))


def recall(facts: DataFrame, requests: DataFrame, counts: DataFrame | None = None, feedback: DataFrame | None = None, seen: DataFrame | None = None, recent: DataFrame | None = None, o: RecallOptions = RecallOptions(), scorer=None, kept=None) -> DataFrame:
    """request_id, rank, id, score, block. facts: scoped; embedding only needed where requests have a vector. kept: postings (sources.postings) of the facts not superseded, read instead of their texts.

    feedback: ref_id, ref_type, score; seen: session_id, id; recent: session_id, files (array). Blocks of a request in order of rank make its context.
    """
    live = facts.where("superseded_by is null")
    requests = with_defaults(requests)
    # One scan finds where the terms of all candidate words stand; counts, keywords and hits follow from that.
    candidates = requests.select(F.explode(candidate_words(F.col("prompt"))).alias("word")).distinct()
    asked = search.query_terms(candidates.select(F.xxhash64("word").alias("query_id"), F.col("word").alias("text")))
    found = None if kept is not None else written(search.places(live, asked.select("term").unionByName(candidates.select(F.col("word").alias("term")))))
    if counts is None:
        counts = search.term_doc_counts(None, candidates, found=found) if kept is None else kept.term_doc_counts(candidates)
    words = written(keywords(requests, counts, o))
    rows = keyword_hits(live, requests, words, found, kept)
    if "vector" in requests.columns and "embedding" in facts.columns:
        asked = requests.join(words.select("request_id"), "request_id", "left_semi")
        near = search.nearest(live, asked.select(F.col("request_id").alias("query_id"), "vector")).withColumnRenamed("query_id", "request_id")
        near = near.join(requests.select("request_id", "result_limit"), "request_id")
        near = search.first_of(near, ("request_id",), [F.desc("score"), F.col("id")], 2 * F.col("result_limit"), 2 * DEFAULTS["result_limit"][1]).select("request_id", "id", F.col("score").alias("vec"))
        rows = rows.join(near, ["request_id", "id"], "full_outer")
    else:
        rows = rows.withColumn("vec", F.lit(None).cast("double"))
    score = F.when(F.col("lexical").isNotNull(), F.col("lexical") + o.both_weight * F.coalesce("vec", F.lit(0.0))).otherwise(o.vector_weight * F.col("vec"))
    rows = rows.select("request_id", "id", score.alias("score"), F.coalesce("hits", F.lit(0)).alias("hits"))
    loads = trigger_loads(facts, requests).join(words.select("request_id"), "request_id", "left_semi").join(rows.select("request_id", "id"), ["request_id", "id"], "left_anti")
    rows = rows.unionByName(loads.select("request_id", "id", F.lit(o.trigger_score).alias("score"), F.lit(0).cast("long").alias("hits")))
    rows = rows.join(live.drop("embedding"), "id").join(requests.select("request_id", "session_id", "cwd", "project", "result_limit", "budget", "prompt"), "request_id")
    rows = rows.join(recent.select("session_id", F.col("files").alias("recent")), "session_id", "left") if recent is not None else rows.withColumn("recent", F.lit(None).cast("array<string>"))
    rows = weighed(rows)
    if feedback is not None:
        stats = feedback.where("ref_type = 'fact'").groupBy(F.col("ref_id").cast("long").alias("id")).agg(F.avg("score").alias("avg"), F.count("*").alias("n"))
        rows = rows.join(stats, "id", "left").withColumn("score", F.col("score") * feedback_factor(F.col("avg"), F.coalesce("n", F.lit(0))))
    if o.rerank_mode != "off" and scorer is not None:
        w = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= o.rerank_pool)
        best = F.max("score").over(Window.partitionBy("request_id"))
        second = scorer(F.col("prompt"), cut_bytes(F.col("content"), o.rerank_bytes))
        rows = rows.withColumn("rerank", second).withColumn("score", search.fuse_score(o.rerank_mode, o.rerank_weight, F.col("rerank"), F.when(best > 0, F.col("score") / best).otherwise(F.col("score"))))
        rows = rows.where(F.col("rerank") >= o.rerank_threshold) if o.rerank_threshold > 0 else rows
    if seen is not None:
        rows = rows.join(seen.select("session_id", "id"), ["session_id", "id"], "left_anti")
    return selected(rows, o)


def selected(rows: DataFrame, o: RecallOptions = RecallOptions()) -> DataFrame:
    """The cut: by share of the best and absolute score, by count, and by characters; the first block that doesn't fit ends it."""
    by = Window.partitionBy("request_id")
    w = by.orderBy(F.desc("score"), "id")
    short = cut_bytes(F.col("content"), o.fact_chars, "...")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("score").over(by))
    rows = rows.where((F.col("score") >= o.min_ratio * F.col("best")) & (F.col("score") >= o.min_score) & (F.col("rank") <= F.col("result_limit")))
    rows = rows.withColumn("block", fact_block(F.col("id"), F.col("subject"), F.col("category"), F.col("created_at"), short))
    used = F.sum(F.octet_length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= budget").select("request_id", "rank", "id", "score", "block")


def contexts(recalled: DataFrame, facts: DataFrame, o: RecallOptions = RecallOptions()) -> DataFrame:
    """request_id, text: what is put before a prompt, the facts of a request in order of rank, a blank line between. Requests without facts have no row."""
    line = F.concat(F.lit("[id="), F.col("id").cast("string"), F.lit("] "), "subject", F.lit(" | "), "category", F.lit("\n  "), cut_bytes(F.col("content"), o.fact_chars, "..."), F.lit("\n"))
    rows = recalled.select("request_id", "rank", "id").join(facts.select("id", "subject", "category", "content"), "id").select("request_id", "rank", line.alias("line"))
    got = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))  # as many as a request's limit
    return got.select("request_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def recorded(recalled: DataFrame, requests: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(injections, seen): session_id, ref_id, ref_type, rank (from 0) of what was shown, and session_id, id of all that a session has seen. Requests without a session leave no trace."""
    shown = recalled.join(requests.where("session_id <> ''").select("request_id", "session_id"), "request_id")
    injected = shown.select("session_id", F.col("id").cast("string").alias("ref_id"), F.lit("fact").alias("ref_type"), (F.col("rank") - 1).alias("rank"))
    now_seen = shown.select("session_id", "id")
    return injected, (now_seen if seen is None else now_seen.unionByName(seen.select("session_id", "id"))).distinct()
