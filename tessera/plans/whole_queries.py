"""Queries of writes, links, sessions, context and recall whose rows are those of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.meta import conflicts
from tessera.functions.text import candidate_words
from tessera.operators import context, extract, graph, lifecycle, recall, search, sessions
from tessera.operators import facts as facts_ops
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import with_
from tessera.plans.search_queries import TERMS
from tessera.plans.store_queries import RECALL
from tessera.schemas import MAX_CONTENT

CASES: dict[str, tuple] = {}


def case(sql: str | None):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


@case(
    with_(
        "facts",
        items="""SELECT doc_id AS item, trim(CASE WHEN doc_id % 6 = 0 THEN '  ' WHEN doc_id % 6 = 1 THEN 'same' ELSE coalesce(text, '') END, ' ') AS content, CASE WHEN doc_id % 11 = 4 THEN '' WHEN doc_id % 2 = 0 THEN source ELSE lang END AS subject
              FROM documents""",
        checked=f"""SELECT *, CASE WHEN content = '' THEN 'content is required' WHEN subject = '' THEN 'subject is required' WHEN length(content) > {MAX_CONTENT} THEN 'content is too long' END AS error
              FROM items""",
        placed="SELECT *, row_number() OVER (PARTITION BY content, subject ORDER BY (error IS NULL) DESC, item) AS k FROM checked",
        there="SELECT DISTINCT content, subject, true AS there FROM facts WHERE superseded_by IS NULL",
    )
    + """SELECT item, CASE WHEN error IS NOT NULL THEN 'error' WHEN k > 1 OR there THEN 'duplicate' ELSE 'stored' END AS status, error
          FROM placed
          LEFT
          JOIN there USING (content, subject)"""
)
def store_batch_statuses(spark, sf):
    d = fx.table(spark, sf, "documents")
    i = F.col("doc_id")
    content = F.when(i % 6 == 0, "  ").when(i % 6 == 1, "same").otherwise(F.col("text"))
    items = d.select(i.alias("item"), content.alias("content"), F.when(i % 11 == 4, "").when(i % 2 == 0, F.col("source")).otherwise(F.col("lang")).alias("subject"), F.lit("").alias("category"))
    return extract.store_batch(fx.facts(spark, sf), items, limit=2**31 - 1)


@case(with_("facts") + f"SELECT id, content, subject FROM facts UNION ALL SELECT doc_id + 1000000000, text, 'new' FROM documents WHERE {MAX_CONTENT} >= length(text)")
def insert_checks_length(spark, sf):
    """Stored facts stay, however long; of new ones only those within the limit come in."""
    new = fx.table(spark, sf, "documents").select((F.col("doc_id") + 10**9).alias("id"), F.col("text").alias("content"), F.lit("new").alias("subject"), F.lit("note").alias("category"))
    return lifecycle.insert(fx.facts(spark, sf), new, "mine", 7, "2025-01-01").select("id", "content", "subject")


@case(with_("facts") + """SELECT a.id AS a, b.id AS b, (a.id % 4 = 1 AND b.id % 4 IN (1, 2, 3) AND (b.id % 4 = 2 OR a.id % 10 <> b.id % 10)) OR (a.id % 4 = 2 AND (b.id % 4 IN (1, 3) OR (b.id % 4 = 2 AND a.id % 20 <> b.id % 20))) OR (a.id % 4 = 3 AND (b.id % 4 = 2 OR (b.id % 4 IN (1, 3) AND a.id % 10 <> b.id % 10) OR (b.id % 4 = 3 AND (a.id % 3 = 0) <> (b.id % 3 = 0)))) AS conflict
      FROM facts a
      JOIN facts b ON b.id = a.superseded_by""")
def metadata_conflicts(spark, sf):
    """Every fact and the one that replaces it."""
    f = fx.facts(spark, sf)
    pairs = f.select(F.col("id").alias("a"), F.col("superseded_by").alias("b"), F.col("metadata").alias("m")).join(f.select(F.col("id").alias("b"), F.col("metadata").alias("o")), "b")
    return pairs.select("a", "b", conflicts(F.col("m"), F.col("o")).alias("conflict"))


@case(with_("facts") + "SELECT text AS probe, doc_id AS n FROM documents p WHERE EXISTS (SELECT 1 FROM facts f WHERE f.content = p.text AND f.subject = p.source AND f.namespace = 'ns0')")
def exists_exact(spark, sf):
    probes = fx.table(spark, sf, "documents").select(F.col("text").alias("content"), F.col("source").alias("subject"), F.lit("ns0").alias("namespace"), F.col("doc_id").alias("n"))
    return facts_ops.exists(fx.facts(spark, sf), probes).select(F.col("content").alias("probe"), "n")


@case("""WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT 100000 + l_partkey AS fact_id, l_suppkey AS other_id, s_name AS other_subject, left(s_name, 100) AS preview
      FROM l
      JOIN supplier ON s_suppkey = l_suppkey""")
def link_previews(spark, sf):
    people = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("subject"), F.col("s_name").alias("content"))
    links = fx.links(spark, sf)
    return graph.neighbours(links, people, links.select(F.col("target_id").alias("fact_id"))).select("fact_id", "other_id", "other_subject", "preview")


@case("SELECT event_type AS session_id, CAST(user_id AS VARCHAR) AS cwd, count(*) AS n FROM events GROUP BY ALL")
def hook_payloads(spark, sf):
    e = fx.table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_type").alias("session_id"), F.col("user_id").cast("string").alias("cwd"))).alias("payload"))
    return sessions.hook_rows(e).groupBy("session_id", "cwd").agg(F.count("*").alias("n"))


def injections(spark, sf):
    return fx.table(spark, sf, "orders").select((F.col("o_custkey") % 120).cast("string").alias("session_id"), F.col("o_orderkey").cast("string").alias("ref_id"), F.lit("fact").alias("ref_type"), (F.col("o_orderkey") % 10).cast("int").alias("rank"))


@case("""SELECT DISTINCT CAST(o_custkey % 120 AS VARCHAR) AS session_id
      FROM orders
      WHERE CAST(o_custkey % 120 AS VARCHAR) IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations) AND CAST(o_custkey % 120 AS VARCHAR) NOT IN (SELECT CAST(doc_id % 50 AS VARCHAR) FROM labels)""")
def unrated_sessions(spark, sf):
    return sessions.unrated_sessions(injections(spark, sf), fx.turns(spark, sf), fx.feedback(spark, sf))


@case("SELECT CAST(o_orderkey AS VARCHAR) AS ref_id, CAST(o_orderkey % 10 AS INTEGER) AS rank FROM orders WHERE o_custkey % 120 = 17")
def injected_facts(spark, sf):
    return sessions.injected_facts(injections(spark, sf), "17").select("ref_id", "rank")


@case(
    with_(
        g="SELECT user_id, event_type, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600 THEN 1 ELSE 0 END AS gap FROM events",
        s="SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS stretch FROM g",
        l="SELECT * FROM s QUALIFY stretch = max(stretch) OVER (PARTITION BY user_id)",
    )
    + "SELECT user_id, string_agg(event_type, ',' ORDER BY t, event_type) AS files FROM (SELECT user_id, event_type, max(ts) AS t FROM l GROUP BY ALL) GROUP BY user_id"
)
def recent_files(spark, sf):
    touches = fx.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("file"), "ts")
    return sessions.recent_files(touches).select(F.col("session_id").alias("user_id"), F.array_join("files", ",").alias("files"))


@case(
    with_(
        "facts",
        tasks="SELECT item_id AS task_id, text AS task FROM benchmark",
        r="SELECT id, category || 'er' AS agent, [category, 'there'] AS domains, content FROM facts WHERE superseded_by IS NULL",
        s="""SELECT task_id, id, agent, 3 * len(list_filter(domains, lambda d: contains(lower(task), d))) + len(list_filter(regexp_split_to_array(trim(lower(task)), '\\s+'), lambda w: strlen(w) >= 3 AND contains(lower(content), w))) AS score
              FROM r, tasks""",
        p="SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS rank, score / max(score) OVER (PARTITION BY task_id) AS share FROM s WHERE score > 0",
    )
    + """SELECT task_id, CAST(rank AS INTEGER) AS rank, id, agent, CAST(score AS INTEGER) AS score, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
          FROM p
          WHERE rank <= 5"""
)
def agent_suggestions(spark, sf):
    f = fx.facts(spark, sf).where("superseded_by is null").select("id", F.concat("category", F.lit("er")).alias("agent"), F.array(F.col("category"), F.lit("there")).alias("domains"), "content")
    return context.scored_agents(f, fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task")))


@case(with_("facts", **RECALL) + "SELECT item_id AS request_id, word, round(idf, 6) AS idf FROM kw")
def recall_keywords(spark, sf):
    req = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("prompt"))
    live = fx.facts(spark, sf).where("superseded_by is null")
    counts = search.term_doc_counts(live, req.select(F.explode(candidate_words(F.col("prompt"))).alias("word")))
    return recall.keywords(req, counts).select("request_id", "word", F.round("idf", 6).alias("idf"))


@case(
    with_("facts", words="SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^A-Za-z]+'))) AS word FROM benchmark", terms=f"SELECT DISTINCT id, unnest({TERMS.format("content || ' ' || subject || ' ' || category")}) AS word FROM facts WHERE superseded_by IS NULL")
    + "SELECT w.word, count(id) AS df, (SELECT count(*) FROM facts WHERE superseded_by IS NULL) AS docs FROM words w LEFT JOIN terms USING (word) WHERE w.word <> '' GROUP BY 1"
)
def term_document_counts(spark, sf):
    w = fx.table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).select(F.lower("word").alias("word")).where("word <> ''").distinct()
    return search.term_doc_counts(fx.facts(spark, sf).where("superseded_by is null"), w)
