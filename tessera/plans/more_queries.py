"""Queries of kept postings, snapshots, tools, owned links, documents, recall with all its arms, hints, answers and incremental sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import chunking, corpus, extract, lifecycle, recall, search, sessions, tools
from tessera.operators import facts as facts_ops
from tessera.operators.facts import Scope
from tessera.plans import fixtures as fx
from tessera.plans import search_queries, store_queries
from tessera.plans.fixtures import VIEWS, with_
from tessera.plans.search_queries import NEAREST, TERMS, VECTOR_QUERIES, bm25_views, query_table
from tessera.plans.store_queries import PROMPTS, RECALL, drained
from tessera.plans.whole_queries import injections
from tessera.sources.postings import Postings
from tessera.sources.tables import Snapshots, shared_folder, written
from tessera.streaming import jobs

CASES: dict[str, tuple] = {}


def case(sql: str | None):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


# ---- tables and postings


@case(with_("facts", **bm25_views("superseded_by IS NULL AND id % 11 <> 5")) + "SELECT query_id, id, round(score, 6) AS score FROM lexical")
def kept_postings(spark, sf):
    """An index of an older state, brought up to date with what changed and went, then asked."""
    live = fx.facts(spark, sf).where("superseded_by is null")
    kept = Postings(spark, folder(spark))
    kept.build(live.withColumn("content", F.when(F.col("id") % 10 == 3, F.lit("an older text")).otherwise(F.col("content"))))
    kept.update(live.where("id % 10 = 3 and id % 11 <> 5"), live.where("id % 11 = 5").select("id"))
    queries = query_table(spark)
    return search.bm25(None, queries, found=written(kept.places(search.query_terms(queries)))).select("query_id", "id", F.round("score", 6).alias("score"))


@case(search_queries.CASES["bm25_top"][1])
def kept_search_top(spark, sf):
    """The best documents of each query from an index in three segments, an old state and two updates, by blocks that can reach the result."""
    live = fx.facts(spark, sf).where("superseded_by is null")
    kept = Postings(spark, folder(spark))
    kept.build(live.where("id % 13 <> 2").withColumn("content", F.when(F.col("id") % 10 == 3, F.lit("an older text")).otherwise(F.col("content"))))
    kept.update(live.where("id % 10 = 3 and id % 13 <> 2"))
    kept.update(live.where("id % 13 = 2"))
    return kept.bm25(query_table(spark), 20).select("query_id", "id", F.round("score", 6).alias("score"))


@case(store_queries.CASES["recall_for_prompts"][1])
def kept_recall(spark, sf):
    """recall_for_prompts over kept postings: counts and keyword searches without a look at the texts."""
    requests = spark.createDataFrame(PROMPTS, "request_id int, session_id string, prompt string, cwd string, project string").withColumn("budget", F.lit(1 << 20)).withColumn("result_limit", F.lit(5))
    f, kept = fx.facts(spark, sf), Postings(spark, folder(spark))
    kept.build(f.where("superseded_by is null"))
    seen = f.where("id % 17 = 0").select(F.lit("s1").alias("session_id"), "id")
    got = recall.recall(f, requests, feedback=fx.feedback(spark, sf), seen=seen, kept=kept)
    return got.select("request_id", "rank", "id", F.round("score", 6).alias("score"))


@case(
    with_("facts")
    + """SELECT 1 AS version, namespace, count(*) AS facts, 25 AS nations FROM facts WHERE id % 2 = 0 GROUP BY namespace
    UNION ALL SELECT 2, namespace, count(*), 25 FROM facts GROUP BY namespace"""
)
def snapshot_commits(spark, sf):
    """A commit of two tables, then one of one: each version is read whole."""
    f, tables = fx.facts(spark, sf), Snapshots(spark, folder(spark))
    tables.commit(facts=f.where("id % 2 = 0"), nations=fx.table(spark, sf, "nation"))
    tables.commit(facts=f)
    nations = tables.read("nations", 2).agg(F.count("*").cast("int").alias("nations"))
    rows = [tables.read("facts", v).groupBy("namespace").agg(F.count("*").alias("facts")).select(F.lit(v).alias("version"), "namespace", "facts") for v in (1, 2)]
    return rows[0].unionByName(rows[1]).crossJoin(nations)  # one row


@case(with_("facts") + "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM facts)")
def absent_ids(spark, sf):
    return facts_ops.absent(fx.facts(spark, sf), fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


# ---- tools


@case(
    with_(
        facts=VIEWS["facts"].replace("lang AS category", "CASE lang WHEN 'en' THEN 'note' ELSE lang END AS category"),
        **bm25_views("superseded_by IS NULL AND namespace = 'ns1'"),
        lex="SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20",
        scored="""SELECT query_id, f.id, use_count, (score / max(score) OVER (PARTITION BY query_id) + least(0.05 * confirmed_count, 0.15))
          * CASE category WHEN 'note' THEN pow(0.5, (epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(created_at)) / 2592000.0) ELSE 1 END AS score
          FROM lex JOIN facts f ON f.id = lex.id""",
    )
    + """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score, use_count + 1 AS use_count
          FROM scored
          QUALIFY rank <= 10"""
)
def tool_search(spark, sf):
    """The scope comes before ranking and statistics; notes fade; use is counted."""
    f = fx.facts(spark, sf).withColumn("category", F.when(F.col("category") == "en", "note").otherwise(F.col("category")))
    return tools.tool_search(f, query_table(spark), s=Scope("ns1"))[0].withColumn("score", F.round("score", 6))


@case(
    with_(
        "facts",
        items="""SELECT doc_id AS item, trim(coalesce('new ' || text, ''), ' ') AS content, coalesce(source, '') AS subject,
          CASE doc_id % 5 WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 5000000 END AS supersedes FROM documents""",
        checked="""SELECT *, CASE WHEN content = '' THEN 'content is required' WHEN subject = '' THEN 'subject is required' WHEN length(content) > 8000 THEN 'content is too long' END AS error
              FROM items""",
        placed="SELECT *, row_number() OVER (PARTITION BY content, subject ORDER BY (error IS NULL) DESC, item) AS k FROM checked",
        said="SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN k > 1 THEN 'duplicate' ELSE 'stored' END AS status FROM placed",
        done="SELECT said.*, f.id AS superseded FROM said LEFT JOIN facts f ON f.id = supersedes AND f.superseded_by IS NULL AND status = 'stored'",
    )
    + """SELECT item, status, error, superseded, CASE WHEN status = 'stored' AND supersedes IS NOT NULL AND superseded IS NULL THEN 'fact ' || CAST(supersedes AS VARCHAR) || ' was not replaced' END AS warning
          FROM done"""
)
def tool_store(spark, sf):
    """New facts, each of which may replace an old one; a replacement that fails is a warning."""
    i = F.col("doc_id")
    items = fx.table(spark, sf, "documents").select(
        i.alias("item"), (i + 10**9).alias("id"), F.concat(F.lit("new "), "text").alias("content"), F.coalesce("source", F.lit("")).alias("subject"), F.lit("").alias("category"),
        F.when(i % 5 == 0, i).when(i % 5 == 1, i + 5000000).alias("supersedes"),
    )
    return tools.tool_store(fx.facts(spark, sf), items, "ns0", 1, "2025-01-01")[1]


# ---- links and documents


@case(
    """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
    SELECT s AS source_id, 100000 + p AS target_id, CASE WHEN good THEN s % 3 END AS user_id, CASE WHEN NOT good THEN 'fact not found' END AS error
    FROM (SELECT s, p, s % 7 <> 0 AND p % 7 <> 0 AND s % 3 = p % 3 AS good FROM l)"""
)
def owned_links(spark, sf):
    """Both ends in the namespace and of one owner, or the link is refused as if an end weren't there."""
    ends = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k")).unionByName(fx.table(spark, sf, "part").select((F.col("p_partkey") + 100000).alias("id"), F.col("p_partkey").alias("k")))
    f = ends.select("id", F.when(F.col("k") % 7 == 0, "other").otherwise("ns").alias("namespace"), (F.col("k") % 3).alias("user_id"))
    return lifecycle.owned_links(fx.links(spark, sf), f, "ns").select("source_id", "target_id", "user_id", "error")


def stored_documents(spark, sf):
    f, i = fx.files(spark, sf), F.col("id")
    docs = f.select(
        "id", F.when(i % 8 == 7, "other").otherwise("ns").alias("namespace"), (i % 2).alias("user_id"), F.when(i % 3 > 0, "repo").alias("repo_url"), "path", F.sha2("content", 256).alias("file_sha256"),
        (i % 10 == 1).alias("dirty"), F.when(i % 5 == 0, "de").otherwise("en").alias("lang"), (i % 10 == 0).alias("generated"),
    )
    text = F.col("content")
    parts = F.array(F.struct(F.lit(0).alias("ordinal"), F.substring(text, 1, 400).alias("content")), F.struct(F.lit(1).alias("ordinal"), text.substr(F.lit(401), F.lit(1 << 30)).alias("content")))
    chunks = f.select(i.alias("document_id"), F.when(i % 8 == 7, "other").otherwise("ns").alias("namespace"), (i % 2).alias("user_id"), F.explode(parts).alias("c"))
    return docs, chunks.select((F.col("document_id") * 2 + F.col("c.ordinal")).alias("id"), "document_id", "namespace", "user_id", "c.*")


DOCS = {
    "docs": """SELECT id, CASE WHEN id % 8 = 7 THEN 'other' ELSE 'ns' END AS namespace, id % 2 AS user_id, CASE WHEN id % 3 > 0 THEN 'repo' END AS repo_url, path, sha256(content) AS file_sha256, id % 10 = 1 AS dirty, CASE WHEN id % 5 = 0 THEN 'de' ELSE 'en' END AS lang, id % 10 = 0 AS generated
          FROM files""",
    "parts": "SELECT id AS document_id, 0 AS ordinal, left(content, 400) AS content FROM files UNION ALL SELECT id, 1, content[401:] FROM files",
}


@case(with_("files", **DOCS) + "SELECT id, path, file_sha256, dirty FROM docs WHERE namespace = 'ns' AND repo_url IS NULL AND user_id = 0")
def manifest_view(spark, sf):
    return corpus.manifest(stored_documents(spark, sf)[0], "ns", user_id=0)


@case(with_("files", **DOCS) + "SELECT ordinal, p.content, path FROM parts p JOIN docs d ON d.id = document_id WHERE document_id = 4 AND namespace = 'ns'")
def document_with_chunks(spark, sf):
    docs, chunks = stored_documents(spark, sf)
    found = corpus.document_chunks(docs, chunks, 4, "ns").select("ordinal", "content").crossJoin(corpus.document(docs, 4, "ns").select("path"))  # one row
    return found.unionByName(corpus.document_chunks(docs, chunks, 7, "ns").select("ordinal", "content", F.lit("another scope's").alias("path")))


DOCUMENT_QUERIES = ((1, "page"), (2, "div class"), (3, "the"))


@case(
    with_(
        "files",
        **DOCS,
        facts="""SELECT document_id * 2 + ordinal AS id, p.content, '' AS subject, '' AS category, document_id, ordinal, repo_url, path
              FROM parts p
              JOIN docs d ON d.id = document_id
              WHERE NOT generated AND starts_with(path, 'src/lib') AND lang = 'en' AND repo_url = 'repo'""",
        **bm25_views("true") | {"queries": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in DOCUMENT_QUERIES) + ") q(query_id, text)"},
        placed="""SELECT query_id, f.id, score, repo_url, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, document_id, ordinal) AS place
              FROM lexical l
              JOIN facts f ON f.id = l.id""",
    )
    + "SELECT query_id, CAST(place AS INTEGER) AS place, id, false AS fallback, round(score, 6) AS score, repo_url, path FROM placed WHERE place <= 20"
)
def document_search(spark, sf):
    """Chunks joined with their documents by id, namespace and owner, under filters of path, language and repository."""
    docs, chunks = stored_documents(spark, sf)
    queries = spark.createDataFrame(DOCUMENT_QUERIES, "query_id int, text string")
    return corpus.search_documents(chunks, docs, queries, 0, prefix="src/lib", lang="en", repo="repo").withColumn("score", F.round("score", 6))


@case(with_("files", **DOCS) + "SELECT id, repo_url FROM docs WHERE path = 'src/docs/page28.md' UNION ALL SELECT id, 'none' FROM docs WHERE lang = 'de' AND repo_url = 'repo'")
def documents_by_filters(spark, sf):
    docs = stored_documents(spark, sf)[0]
    one = corpus.path_filters(docs, prefix="src/docs/", basename="page28.md")
    return one.select("id", "repo_url").unionByName(corpus.path_filters(docs, lang="de", repo="repo").select("id", F.lit("none").alias("repo_url")))


# ---- recall with every arm

ASKED = ((1, "s1", "the there hahere ndound worthless thention", "/work/src3/lib", "src3"), (2, "s2", "les pour dans eauxment menteux", "/home", ""), (3, "s1", "and of", "/work/src3", ""), (4, "s3", "", "/work/src3", ""), (5, "", "und der die wortlos", "/data/logs/today", ""))
TRIGGERS = (
    (10**9 + 1, '{"signal_type":"cwd_pattern","signal":"src3/*","load_subsystem":"sub2","load_kinds":["decision","convention"]}'),
    (10**9 + 2, '{"signal_type":"cwd_pattern","signal":"logs/**","load_subject":"src5"}'),
    (10**9 + 3, '{"signal_type":"cwd_pattern","signal":"nowhere","load_subject":"src6"}'),
    (10**9 + 4, '{"signal_type":"file","signal":"src3/*","load_subject":"src7"}'),
)
RECENT = (("s1", ["/a/und", "b/hahere"]), ("s2", ["x/pour"]))


def recall_views(pool: int) -> dict[str, str]:
    base = VIEWS["facts"].replace("source AS subject", "CASE WHEN doc_id % 13 = 5 THEN 'file:' || source ELSE source END AS subject")
    rows = ", ".join(f"({i}, '{m}')" for i, m in TRIGGERS)
    return {
        "facts": base + f"""
              UNION ALL SELECT id, 'ns0', 0, 'trigger', 'rule', 'note', 'trigger', '', metadata, NULL, NULL, 0, 0, TIMESTAMP '2024-01-01 00:00:00'
              FROM (VALUES {rows}) t(id, metadata)""",
        "req": "SELECT item_id, s AS session_id, text, cwd, project, regexp_split_to_array(text, '\\s+') AS ws FROM (VALUES " + ", ".join(f"({i}, '{s}', '{p}', '{c}', '{n}')" for i, s, p, c, n in ASKED) + ") q(item_id, s, text, cwd, project)",
        **{k: v for k, v in RECALL.items() if k != "req"},
        "h": "SELECT k.item_id, k.word, a.id, len(terms) AS n, len(list_filter(terms, lambda t: t = k.word)) AS tf FROM kw k JOIN an a ON list_contains(terms, k.word)",
        "hd": "SELECT word, count(DISTINCT id) AS hv FROM h GROUP BY word",
        "bm": """SELECT item_id, word, id, greatest(ln((d - hv + 0.5) / (hv + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m)) AS score
              FROM h
              JOIN hd USING (word), (SELECT count(*) AS d, avg(len(terms)) AS m FROM an)""",
        "b1": "SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY score DESC, id) <= 32",
        "b2": "SELECT item_id, word, b1.id, score / max(score) OVER (PARTITION BY item_id, word) + least(0.05 * confirmed_count, 0.15) AS combined FROM b1 JOIN facts f ON f.id = b1.id",
        "b3": "SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY combined DESC, id) <= 16",
        "lexarm": "SELECT item_id, id, sum(combined) AS lexical, count(*) AS hits FROM b3 GROUP BY ALL",
        "asked": "SELECT DISTINCT item_id FROM kw",
        "vecarm": """SELECT item_id, l.id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS vec
              FROM asked
              JOIN embeddings q ON q.vec_id = item_id, live l
              JOIN embeddings e ON e.vec_id = l.id
              WHERE vec > 0
              QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY vec DESC, l.id) <= 16""",
        "both_": """SELECT coalesce(a.item_id, v.item_id) AS item_id, coalesce(a.id, v.id) AS id, CASE WHEN lexical IS NOT NULL THEN lexical + 0.5 * coalesce(vec, 0) ELSE 1.5 * vec END AS s0, coalesce(hits, 0) AS hits
              FROM lexarm a
              FULL
              JOIN vecarm v ON v.item_id = a.item_id AND v.id = a.id""",
        "loads": "SELECT 1 AS item_id, id FROM live WHERE subsystem = 'sub2' AND kind IN ('decision', 'convention') UNION ALL SELECT 5, id FROM live WHERE subject = 'src5'",
        "c": """SELECT *
              FROM both_
              UNION ALL SELECT item_id, id, 2.0, 0
              FROM loads l
              WHERE item_id IN (SELECT item_id FROM asked) AND NOT EXISTS (SELECT 1 FROM both_ b WHERE b.item_id = l.item_id AND b.id = l.id)""",
        "recent": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', [{', '.join(repr(x.rsplit('/', 1)[-1]) for x in f)}])" for s, f in RECENT) + ") r(session_id, files)",
        "w": """SELECT c.item_id, f.*, hits, project, cwd, session_id, text AS prompt, lower(subject) = lower(project) OR lower(regexp_extract(subject, '[^/]*$')) = lower(project) AS own, project <> '' AS known,
          coalesce(metadata ->> '$.quality', '') AS quality, coalesce(metadata ->> '$.surface', '') AS surface, metadata ->> '$.project_path' AS pp, s0,
          subject LIKE 'file:%' OR coalesce(metadata ->> '$.surface', '') = 'symbol' AS symbol,
          len(list_filter(coalesce(files, []), lambda x: contains(lower(content || ' ' || subject), lower(x)))) > 0 AS touched
          FROM c JOIN live f USING (id) JOIN req ON req.item_id = c.item_id LEFT JOIN recent USING (session_id)""",
        "x": """SELECT *, s0 * CASE WHEN kind = 'decision' THEN 1.5 WHEN kind IN ('convention', 'invariant') THEN 1.3 ELSE 1 END * CASE WHEN symbol THEN 0.2 ELSE 1 END
          * CASE WHEN known AND own AND NOT symbol THEN 2.5 WHEN known AND NOT own AND category NOT IN ('project', 'preference') THEN 0.3 ELSE 1 END
          * CASE WHEN surface = 'project' AND cwd <> '' AND (cwd = pp OR starts_with(cwd, pp || '/')) THEN 4 ELSE 1 END * CASE WHEN touched THEN 1.3 ELSE 1 END * CASE WHEN hits > 1 THEN 1 + 0.2 * (hits - 1) ELSE 1 END AS s1
          FROM w WHERE NOT (starts_with(quality, 'local:') OR subject = 'session-activity' OR kind = 'trigger' OR (kind = 'pattern' AND surface <> 'project') OR (kind = 'summary' AND known AND NOT own))""",
        "fb": "SELECT doc_id AS id, avg(2.0 * quality - 1) AS a, count(*) AS n FROM labels GROUP BY 1",
        "y": "SELECT x.*, s1 * CASE WHEN n > 0 THEN pow(2, a * (0.4 + 0.6 * least(n, 5) / 5)) ELSE 1 END AS s2 FROM x LEFT JOIN fb USING (id)",
        "pool": f"""SELECT *, s2 / max(s2) OVER (PARTITION BY item_id) AS share, list_distinct({TERMS.format('prompt')}) AS qt
              FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s2 DESC, id) <= {pool})""",
        "second": f"SELECT *, 0.7 * (CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, list_distinct({TERMS.format('content')}))) / len(qt) END) + 0.3 * share AS score FROM pool",
        "fresh": "SELECT * FROM second WHERE NOT (session_id = 's1' AND id % 17 = 0)",
        "z": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM fresh",
        "cut": """SELECT *, sum(strlen('[id=' || CAST(id AS VARCHAR) || '] ' || subject || ' | ' || category || ' | 2024-01-01' || chr(10) || '  ' || content || chr(10))) OVER (PARTITION BY item_id ORDER BY score DESC, id) AS used
              FROM z
              WHERE rank <= 8 AND score >= 0.3 * best AND score >= 0.35""",
        "shown": "SELECT * FROM cut WHERE used <= 9000",
    }


FULL = with_(**recall_views(16))


def recalled(spark, sf):
    """Requests with vectors, triggers, recent files, ratings, facts already seen, a second stage and a budget that binds."""
    req = spark.createDataFrame([(*r, 8, 9000) for r in ASKED], "request_id int, session_id string, prompt string, cwd string, project string, result_limit int, budget int")
    vectors = fx.vectors(spark, sf)
    req = req.join(vectors.select(F.col("id").cast("int").alias("request_id"), F.col("embedding").alias("vector")), "request_id", "left")
    f = fx.facts(spark, sf).withColumn("subject", F.when(F.col("id") % 13 == 5, F.concat(F.lit("file:"), "subject")).otherwise(F.col("subject")))
    f = f.join(vectors.select("id", "embedding"), "id", "left")
    rules = spark.createDataFrame([*TRIGGERS], "id long, metadata string")
    given = {"namespace": "ns0", "content": "trigger", "subject": "rule", "category": "note", "kind": "trigger", "subsystem": "", "created_at": "2024-01-01 00:00:00", "user_id": 0, "confirmed_count": 0, "use_count": 0}
    for name, kind in f.dtypes:
        if name not in rules.columns:
            rules = rules.withColumn(name, F.lit(given.get(name)).cast(kind))
    f = f.unionByName(rules)
    seen = f.where("id % 17 = 0").select(F.lit("s1").alias("session_id"), "id")
    recent = spark.createDataFrame([*RECENT], "session_id string, files array<string>")
    o = recall.RecallOptions(rerank_mode="balanced", rerank_bytes=1 << 30, fact_chars=1 << 30)
    got = recall.recall(f, req, feedback=fx.feedback(spark, sf), seen=seen, recent=recent, o=o, scorer=search.overlap_scorer)
    return req, f, seen, o, got


@case(FULL + "SELECT item_id AS request_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM shown")
def recall_with_every_arm(spark, sf):
    return recalled(spark, sf)[-1].select("request_id", "rank", "id", F.round("score", 6).alias("score"))


@case(FULL + """SELECT item_id AS request_id, string_agg('[id=' || CAST(id AS VARCHAR) || '] ' || subject || ' | ' || category || chr(10) || '  ' || content || chr(10), chr(10) ORDER BY rank) AS text
      FROM shown
      GROUP BY item_id""")
def recall_contexts(spark, sf):
    _, f, _, o, got = recalled(spark, sf)
    return recall.contexts(got, f, o)


@case(
    FULL
    + """SELECT session_id, CAST(id AS VARCHAR) AS ref_id, 'fact' AS ref_type, CAST(rank - 1 AS INTEGER) AS rank FROM shown WHERE session_id <> ''
    UNION ALL SELECT session_id, CAST(id AS VARCHAR), 'seen', -1 FROM (SELECT session_id, id FROM shown WHERE session_id <> '' UNION SELECT 's1', id FROM facts WHERE id % 17 = 0)"""
)
def recall_records(spark, sf):
    """What recall leaves behind: injections with their rank, and what each session has seen by now."""
    req, _, seen, _, got = recalled(spark, sf)
    injected, now_seen = recall.recorded(got, req, seen)
    return injected.unionByName(now_seen.select("session_id", F.col("id").cast("string").alias("ref_id"), F.lit("seen").alias("ref_type"), F.lit(-1).alias("rank")))


# ---- hints, ratings, answers


@case(
    with_(**NEAREST, placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims WHERE score > 0")
    + """SELECT query_id AS session_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS retrieved, round(avg(score), 6) AS relevance, round(max(score), 6) AS best
          FROM placed
          WHERE rank <= 10
          GROUP BY query_id"""
)
def hint_records(spark, sf):
    v = fx.vectors(spark, sf)
    q = v.where(F.col("id").isin(*VECTOR_QUERIES)).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = search.nearest(v, q, 10)
    from pyspark.sql import Window

    ranked = near.select(F.col("query_id").alias("session_id"), "id", F.col("score").alias("vec"), F.col("score").alias("combined"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank"))
    got = sessions.hint_record(ranked)
    return got.select("session_id", F.array_join("retrieved_ids", ",").alias("retrieved"), F.round("relevance", 6).alias("relevance"), F.round(F.array_max(F.map_values("candidate_scores")), 6).alias("best"))


def hints(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_id") % 4 == 0, F.lit("2024-02-01").cast("timestamp")).alias("consumed_at"))


@case("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS consumed_at
      FROM events""")
def consumed_hints(spark, sf):
    """A hint is consumed once: one that already is keeps its time."""
    h = hints(spark, sf)
    return lifecycle.consume_hints(h, h.where("id % 3 = 0").select("id"), "2024-03-01").select("id", "consumed_at")


@case("""SELECT e.event_id AS id, CAST(o_custkey % 120 AS VARCHAR) AS shown_in, CAST(o_orderkey % 10 AS INTEGER) AS rank
      FROM events e
      JOIN orders ON o_orderkey = e.event_id
      WHERE o_orderkey % 2 = 0""")
def shown_hints(spark, sf):
    shown = injections(spark, sf).withColumn("ref_type", F.when(F.col("ref_id").cast("long") % 2 == 0, "hint").otherwise("fact"))
    return sessions.hint_injections(hints(spark, sf), shown).select("id", "shown_in", "rank")


@case(
    with_(
        "facts",
        "turns",
        inj="SELECT DISTINCT CAST(o_custkey % 120 AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS ref_id FROM orders",
        open_="SELECT DISTINCT session_id FROM inj WHERE session_id IN (SELECT session_id FROM turns) AND session_id NOT IN (SELECT CAST(doc_id % 50 AS VARCHAR) FROM labels)",
    )
    + """SELECT ref_id, session_id, CASE WHEN contains(f.content, 'the') THEN -1 ELSE 1 END AS score
          FROM inj
          JOIN open_ USING (session_id)
          JOIN facts f ON CAST(f.id AS VARCHAR) = ref_id
          WHERE f.content IS NOT NULL"""
)
def backfilled_ratings(spark, sf):
    """Facts shown in sessions that nobody rated, rated by a plug-in."""
    rater = lambda content, _: F.when(F.contains(content, F.lit("the")), -1).otherwise(7)
    f = fx.facts(spark, sf).where("content is not null")
    return sessions.backfill(injections(spark, sf), fx.turns(spark, sf), fx.feedback(spark, sf), f, rater).select("ref_id", "session_id", "score")


@case(
    """SELECT doc_id AS answer_id, 0 AS at, trim(text, ' ') AS content, CASE WHEN doc_id % 4 = 3 THEN '' ELSE coalesce(trim(source, ' '), '') END AS subject, CASE WHEN doc_id % 3 = 0 OR lang IS NULL THEN 'note' ELSE lang END AS category FROM documents WHERE doc_id % 5 <> 4 AND trim(text, ' ') <> ''
    UNION ALL SELECT doc_id, 1, 'second', 'two', 'note' FROM documents WHERE doc_id % 5 IN (0, 1, 3)"""
)
def parsed_answers(spark, sf):
    """Answers as arrays, in fences, as one object, as an object around an array, and without JSON."""
    i, d = F.col("doc_id"), fx.table(spark, sf, "documents")
    first = F.to_json(F.struct(F.col("text").alias("content"), F.when(i % 4 != 3, F.col("source")).alias("subject"), F.when(i % 3 != 0, F.col("lang")).alias("category")))
    array = F.concat(F.lit("["), first, F.lit(', 7, {"content": "second", "subject": " two "}]'))
    raw = F.when(i % 5 == 0, array).when(i % 5 == 1, F.concat(F.lit("Here it is {so far}:\n```json\n"), array, F.lit("\n```"))).when(i % 5 == 2, first).when(i % 5 == 3, F.concat(F.lit('{"n": 3, "facts": '), array, F.lit("}"))).otherwise(F.lit("nothing [ to say"))
    return extract.candidates(d.select(i.alias("answer_id"), raw.alias("raw"))).select("answer_id", F.when(F.col("subject") == "two", 1).otherwise(0).alias("at"), "content", "subject", "category")


@case(with_("files") + "SELECT path, CASE id % 4 WHEN 0 THEN 'new' ELSE 'changed' END AS why FROM files WHERE id % 4 IN (0, 2)")
def changed_page_files(spark, sf):
    """A stream of files, of which only new and changed ones pass."""
    f = fx.files(spark, sf).withColumn("sha256", F.sha2("content", 256))
    stored = f.where("id % 4 <> 0").select("path", F.when(F.col("id") % 4 == 2, "old").otherwise(F.col("sha256")).alias("sha256"))
    names = f.select("id", "path", "sha256")

    def make(s):
        return jobs.changed_files(s.select(F.col("page_id").alias("id")).join(names, "id"), stored)

    return drained(spark, sf, "pages", make).select("path", F.when(F.col("id") % 4 == 0, "new").otherwise("changed").alias("why"))


# ---- chunks of files whose cuts can be reckoned

SPAN = ("path", "strategy", "ordinal", "byte_start", "byte_end")


def repeated(n, line):
    """line(j) for j from 0 to n - 1, one after the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), line), "")).otherwise("")


def numbered_files(spark, sf, end: str, content):
    d = fx.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(end)).alias("path"), content(F.col("doc_id")).alias("content"))


@case(
    """WITH f AS (SELECT doc_id, doc_id % 97 AS n FROM documents WHERE doc_id % 97 > 0),
    w AS (SELECT doc_id, n, unnest(range(1 + greatest(0, CAST(ceil((n - 20) / 18.0) AS BIGINT)))) AS k FROM f)
    SELECT 'd' || CAST(doc_id AS VARCHAR) || '.txt' AS path, 'line-window' AS strategy, CAST(k AS INTEGER) AS ordinal, CAST(18 * k * 101 AS INTEGER) AS byte_start, CAST(least(18 * k + 20, n) * 101 - 1 AS INTEGER) AS byte_end,
      CAST(18 * k + 1 AS INTEGER) AS line_start, CAST(least(18 * k + 20, n) AS INTEGER) AS line_end FROM w"""
)
def chunk_windows(spark, sf):
    """Lines of 100 characters: a window has 20 of them, and shares two with the one before."""
    line = lambda j: F.concat(F.repeat(F.substring(F.lit("abcdefghij"), 1, 1), 99), (j % 10).cast("string"), F.lit("\n"))
    return chunking.chunk_documents(numbered_files(spark, sf, ".txt", lambda i: repeated(i % 97, line))).select(*SPAN, "line_start", "line_end")


@case(
    """WITH f AS (SELECT 'd' || CAST(doc_id AS VARCHAR) || '.md' AS path, doc_id % 23 AS m, 6 + doc_id % 5 AS q FROM documents),
    small AS (SELECT *, unnest(range(CAST(ceil(m / 4.0) AS BIGINT))) AS g FROM f),
    big AS (SELECT *, unnest(range(CAST(ceil(q / 2.0) AS BIGINT))) AS k, 12 + 110 * m AS b FROM f),
    every AS (
      SELECT path, 0 AS place, 0 AS byte_start, 10 AS byte_end, '' AS heading_path, 1 AS heading_level FROM f
      UNION ALL SELECT path, 1 + g, 12 + 440 * g, 12 + 110 * (least(4 * g + 4, m) - 1) + 108, 'T', 2 FROM small
      UNION ALL SELECT path, 1000 + k, CASE WHEN k = 0 THEN b ELSE b + 7 + 3004 * k END, b + 7 + 1502 * (least(2 * k + 2, q) - 1) + 1500, '', 1 FROM big)
    SELECT path, 'markdown' AS strategy, CAST(row_number() OVER (PARTITION BY path ORDER BY place) - 1 AS INTEGER) AS ordinal, CAST(byte_start AS INTEGER) AS byte_start, CAST(byte_end AS INTEGER) AS byte_end, heading_path, heading_level FROM every"""
)
def chunk_sections(spark, sf):
    """A title, small sections that join by fours, and a section too large for one chunk, cut between paragraphs."""
    section = lambda j: F.concat(F.lit("## S"), (j + 10).cast("string"), F.lit("\n\n"), F.repeat(F.lit("y"), 100), F.lit("\n\n"))
    paragraph = lambda j: F.concat(F.repeat(F.lit("z"), 1500), F.lit("\n\n"))
    text = lambda i: F.concat(F.lit("# T\n\nintro\n\n"), repeated(i % 23, section), F.lit("# Big\n\n"), repeated(6 + i % 5, paragraph))
    return chunking.chunk_documents(numbered_files(spark, sf, ".md", text)).select(*SPAN, "heading_path", "heading_level")


@case(
    """WITH f AS (SELECT 'd' || CAST(doc_id AS VARCHAR) || '.go' AS path, doc_id % 3 = 0 AS generated, doc_id % 7 AS n, CASE WHEN doc_id % 3 = 0 THEN 41 ELSE 0 END AS h FROM documents),
    every AS (
      SELECT path, generated, 0 AS ordinal, 0 AS byte_start, h + 9 AS byte_end, '' AS symbol, 'package_doc' AS decl_kind, 'p' AS scope_path FROM f
      UNION ALL SELECT path, generated, j + 1, h + 11 + 476 * j, h + 11 + 476 * j + 474, 'F' || CAST(j + 10 AS VARCHAR), 'func', 'p > F' || CAST(j + 10 AS VARCHAR) FROM (SELECT *, unnest(range(n)) AS j FROM f))
    SELECT path, 'go' AS strategy, CAST(ordinal AS INTEGER) AS ordinal, CAST(byte_start AS INTEGER) AS byte_start, CAST(byte_end AS INTEGER) AS byte_end, symbol, decl_kind, scope_path, generated FROM every"""
)
def chunk_declarations(spark, sf):
    """Functions large enough to stand alone, in files of which some are marked as generated."""
    one = lambda j: F.concat(F.lit("func F"), (j + 10).cast("string"), F.lit('() {\n\tcall("'), F.repeat(F.lit("w"), 450), F.lit('")\n}\n\n'))
    head = lambda i: F.when(i % 3 == 0, "// Code generated by tool. DO NOT EDIT.\n\n").otherwise("")
    text = lambda i: F.concat(head(i), F.lit("package p\n\n"), repeated(i % 7, one))
    return chunking.chunk_documents(numbered_files(spark, sf, ".go", text)).select(*SPAN, "symbol", "decl_kind", "scope_path", "generated")
