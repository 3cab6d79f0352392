"""Writes, chains, links, the document corpus, sessions, context, recall, transfer and streams over the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import chunking, context, corpus, extract, graph, ignores, lifecycle, recall, search, sessions, similar
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import with_
from tessera.plans.search_queries import STOPS, TERMS, bm25_views
from tessera.sources import transfer
from tessera.sources.tables import shared_folder, streamed
from tessera.streaming import jobs, memory, queue

CASES: dict[str, tuple] = {}


def case(sql: str | None):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


# ---- writes


@case(with_("facts") + """SELECT f.id, CASE WHEN f.superseded_by IS NOT NULL THEN f.superseded_by WHEN f.id % 9 = 1 AND EXISTS (SELECT 1 FROM facts g WHERE g.id = f.id + 10) THEN f.id + 10 END AS superseded_by, CASE WHEN f.superseded_by IS NOT NULL THEN f.superseded_at WHEN f.id % 9 = 1 AND EXISTS (SELECT 1 FROM facts g WHERE g.id = f.id + 10) THEN TIMESTAMP '2024-09-01 00:00:00' END AS superseded_at
      FROM facts f""")
def supersede_pairs(spark, sf):
    f = fx.facts(spark, sf)
    pairs = f.where("id % 9 = 1").select(F.col("id").alias("old_id"), (F.col("id") + 10).alias("new_id"))
    return lifecycle.supersede(f, pairs, "2024-09-01 00:00:00").select("id", "superseded_by", "superseded_at")


@case(with_("facts") + """SELECT id, confirmed_count + CASE WHEN id % 10 < 3 THEN 1 ELSE 0 END AS confirmed_count, use_count + CASE WHEN id IN (SELECT DISTINCT user_id FROM events) THEN 1 ELSE 0 END AS use_count
      FROM facts""")
def confirm_and_touch(spark, sf):
    f = fx.facts(spark, sf)
    f = lifecycle.confirm(f, f.where("id % 10 < 3").select("id"), "2024-09-01")
    return lifecycle.touch(f, fx.table(spark, sf, "events").select(F.col("user_id").alias("id")), "2024-09-01").select("id", "confirmed_count", "use_count")


@case(with_("facts") + """SELECT id, metadata ->> '$.chapter' AS chapter, metadata ->> '$.quality' AS quality, metadata ->> '$.surface' AS surface, CASE WHEN id % 4 <> 0 THEN 'yes' END AS seen
      FROM facts
      WHERE id % 4 <> 2
      UNION ALL SELECT id, NULL, NULL, 'project', 'yes'
      FROM facts
      WHERE id % 4 = 2""")
def patch_metadata(spark, sf):
    f = fx.facts(spark, sf)
    patches = f.where("id % 4 <> 0").select("id", F.when(F.col("id") % 4 == 2, '{"seen":"yes","chapter":null}').otherwise('{"seen":"yes"}').alias("patch"))
    m = F.col("metadata")
    return lifecycle.patch_metadata(f, patches).select("id", *[F.get_json_object(m, f"$.{k}").alias(k) for k in ("chapter", "quality", "surface", "seen")])


@case(with_("links") + "SELECT source_id, target_id FROM links WHERE source_id NOT IN (3, 7) AND target_id - 100000 NOT IN (10, 20)")
def delete_cascades(spark, sf):
    links = fx.links(spark, sf)
    ids = spark.createDataFrame([(3,), (7,), (100010,), (100020,)], "id long")
    ends = links.select(F.col("source_id").alias("id")).distinct()
    return lifecycle.delete(ends, links, ids)[1].select("source_id", "target_id")


@case(
    """SELECT conv_id, turn, role FROM (
      SELECT conv_id, turn, role, 0 AS new FROM conversations WHERE turn % 2 = 0
      UNION ALL SELECT conv_id, turn, 'again', 1 FROM conversations)
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY new) = 1"""
)
def insert_if_absent(spark, sf):
    """Turns with even numbers are there; all turns come again."""
    t = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return lifecycle.insert_if_absent(t.where("turn % 2 = 0"), t.withColumn("role", F.lit("again")), ["conv_id", "turn"], ["role"])


@case(with_("facts") + "SELECT namespace, user_id, count(*) AS n FROM (SELECT namespace, user_id FROM facts UNION ALL SELECT 'mine', 7 FROM benchmark) GROUP BY ALL")
def insert_stamps_scope(spark, sf):
    new = fx.table(spark, sf, "benchmark").select((F.col("item_id") + 10**9).alias("id"), F.col("text").alias("content"), F.lit("b").alias("subject"), F.lit("note").alias("category"), F.lit("theirs").alias("namespace"))
    return lifecycle.insert(fx.facts(spark, sf), new, "mine", 7, "2025-01-01").groupBy("namespace", "user_id").agg(F.count("*").alias("n"))


@case("SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 = 2 ORDER BY 1 LIMIT 30")
def pending_vectors(spark, sf):
    f = fx.vectors(spark, sf).withColumn("embedding", F.when(F.col("id") % 5 != 2, F.col("embedding")))
    return lifecycle.pending(f, 30).select("id")


@case("""SELECT l_suppkey AS source_id, count(*) AS n, sum(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS relabelled
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
      GROUP BY 1""")
def update_link_labels(spark, sf):
    links = fx.links(spark, sf).withColumns({"label": F.lit("old"), "metadata": F.lit("{}")})
    changes = links.select("id", F.when(F.col("target_id") % 2 == 0, "new").otherwise("").alias("label"), F.lit("").alias("metadata"))
    out = lifecycle.update_links(links, changes)
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.count(F.when((F.col("label") == "new") & F.col("metadata").isNull(), 1)).alias("relabelled"))


# ---- chains and links


@case(with_("chains") + """SELECT id, subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY created_at, id) - 1 AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY subject) AS INTEGER) AS chain_length
      FROM chains""")
def history_of_subjects(spark, sf):
    return lifecycle.history_by_subject(fx.chains(spark, sf))


STARTS = "SELECT id AS start FROM chains WHERE id % 97 = 5"


@case(with_("chains", starts=STARTS, placed="SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY created_at, id) - 1 AS position, count(*) OVER (PARTITION BY subject) AS chain_length FROM chains") + """SELECT start, p.id, CAST(p.position AS INTEGER) AS position, CAST(p.chain_length AS INTEGER) AS chain_length
      FROM starts s
      JOIN placed q ON q.id = s.start
      JOIN placed p ON p.subject = q.subject""")
def history_of_ids(spark, sf):
    c = fx.chains(spark, sf)
    return graph.history(c, c.where("id % 97 = 5").select("id"))


@case(with_("chains") + "SELECT id, first_value(id) OVER w AS root, row_number() OVER w - 1 AS position FROM chains WINDOW w AS (PARTITION BY subject ORDER BY created_at, id)")
def chain_positions(spark, sf):
    return graph.chain_positions(fx.chains(spark, sf))


IDS = "(1, 5, 9, 100004, 100008, 100013)"


def link_case(direction: str, where: str):
    sql = with_("links") + f"""SELECT fact_id, other_id, link_type
          FROM (SELECT source_id AS fact_id, target_id AS other_id, link_type, bidirectional, 1 AS outward FROM links UNION ALL SELECT target_id, source_id, link_type, bidirectional, 0 FROM links)
          WHERE fact_id IN {IDS} AND {where}"""

    def query(spark, sf):
        ids = spark.createDataFrame([(i,) for i in (1, 5, 9, 100004, 100008, 100013)], "fact_id long")
        return graph.links_of(fx.links(spark, sf), ids, direction).select("fact_id", "other_id", "link_type")

    query.__name__ = f"links_{direction}"
    return case(sql)(query)


link_case("outbound", "(outward = 1 OR bidirectional)")
link_case("inbound", "(outward = 0 OR bidirectional)")
link_case("both", "true")


@case(with_("links") + """SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree
      FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM links UNION ALL SELECT target_id, 0, 1 FROM links)
      GROUP BY id""")
def link_degrees(spark, sf):
    return graph.degrees(fx.links(spark, sf))


@case(
    with_("links", e="SELECT source_id AS a, target_id AS b FROM links UNION SELECT target_id, source_id FROM links WHERE bidirectional", h0="SELECT CAST(1 AS BIGINT) AS id, 0 AS hops UNION ALL SELECT 2, 0", h1="SELECT DISTINCT b AS id, 1 AS hops FROM h0 JOIN e ON a = id WHERE b NOT IN (SELECT id FROM h0)", h2="SELECT DISTINCT b AS id, 2 AS hops FROM h1 JOIN e ON a = id WHERE b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1)")
    + "SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2"
)
def link_neighbourhood(spark, sf):
    return graph.neighbourhood(fx.links(spark, sf), spark.createDataFrame([(1,), (2,)], "id long"), 2)


AUTO = {
    "new": "SELECT vec_id AS s, label, embedding AS v FROM embeddings WHERE vec_id % 10 = 3",
    "sims": """SELECT s AS source_id, vec_id AS target_id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score
          FROM new
          JOIN embeddings USING (label)
          WHERE vec_id <> s""",
}


@case(with_(**AUTO) + "SELECT source_id, target_id, round(score, 6) AS score FROM sims WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= 3")
def auto_links(spark, sf):
    v = fx.vectors(spark, sf).withColumns({"subject": F.col("label").cast("string"), "superseded_by": F.lit(None).cast("long")})
    return graph.auto_links(v.where("id % 10 = 3"), v, threshold=0.3).select("source_id", "target_id", F.round("score", 6).alias("score"))


@case(
    with_(
        news="SELECT vec_id AS id, label, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE vec_id % 10 = 3",
        pairs="""SELECT n.id AS new_id, e.vec_id AS old_id, list_cosine_similarity(CAST(n.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim
          FROM news n JOIN embeddings e USING (label) WHERE e.vec_id <> n.id AND (e.vec_id % 10 <> 3 OR e.vec_id < n.id) AND sim >= 0.3""",
    ).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """,
    walk AS (
      SELECT label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS old_id, CAST(NULL AS BIGINT) AS new_id FROM (SELECT DISTINCT label FROM news)
      UNION ALL
      SELECT w.label, n.k, CASE WHEN p.old_id IS NULL THEN gone ELSE list_append(gone, p.old_id) END, p.old_id, n.id
      FROM walk w JOIN news n ON n.label = w.label AND n.k = w.k + 1 LEFT JOIN pairs p ON p.new_id = n.id AND NOT list_contains(w.gone, p.old_id)
      QUALIFY row_number() OVER (PARTITION BY w.label ORDER BY p.sim DESC NULLS LAST, p.old_id) = 1)
    SELECT old_id, new_id FROM walk WHERE old_id IS NOT NULL"""
)
def auto_supersede(spark, sf):
    """What each new fact replaces depends on what earlier ones did; tests hold it against a plain loop, too."""
    v = fx.vectors(spark, sf).withColumns({"subject": F.col("label").cast("string"), "superseded_by": F.lit(None).cast("long"), "metadata": F.lit(None).cast("string")})
    return extract.replacements(v.where("id % 10 = 3").withColumn("batch_index", F.col("id").cast("int")), v.where("id % 10 <> 3"), threshold=0.3)


CLOSE = 0.3


@case(
    f"""SELECT a.vec_id AS source_id, b.vec_id AS target_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
      WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {CLOSE}"""
)
def close_pairs(spark, sf):
    """All vectors as one subject: its pairs of a similarity, by pivots and blocks."""
    v = fx.vectors(spark, sf).withColumn("subject", F.lit("one"))
    a, b = (v.select(F.col("id").alias(i), "subject", F.col("embedding").alias(w)) for i, w in (("source_id", "v"), ("target_id", "w")))
    found = similar.near(a, b, "source_id", "target_id", CLOSE).where("source_id < target_id")
    return found.select("source_id", "target_id", F.round("score", 6).alias("score"))


@case("""SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a, embeddings b
      WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 10""")
def nearest_by_cells(spark, sf):
    """Every vector whose id is divisible by 20 against all: cells that can't reach a query's tenth score are left out."""
    v = fx.vectors(spark, sf)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return similar.nearest(v.select("id", "embedding"), q, 10).select("query_id", "id", F.round("score", 6).alias("score"))


# ---- corpus

EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
ROUTED = f"({EXT} IN ('md', 'markdown', 'go') OR {EXT} IN ('{"','".join(paths.TEXT_EXTENSIONS)}'))"
REASON = f"CASE WHEN path LIKE '%/vendor/%' THEN 'excluded directory: vendor' WHEN path LIKE '%/.git/%' THEN 'excluded directory: .git' WHEN NOT {ROUTED} THEN CASE WHEN {EXT} = '' THEN 'no extension' ELSE 'unroutable extension: ' || regexp_extract(path, '\\.[^./]*$') END WHEN size > 1048576 THEN 'size ' || CAST(size AS VARCHAR) || ' exceeds cap 1048576' END"


@case(with_("files") + f"""SELECT path, {REASON} AS reason, CASE WHEN {EXT} IN ('md', 'markdown') THEN 'markdown' WHEN {EXT} = 'go' THEN 'go' WHEN {ROUTED} THEN 'line-window' END AS route
      FROM files""")
def file_routes(spark, sf):
    p = F.col("path")
    return fx.files(spark, sf).select("path", paths.skip_reason(p, F.col("size")).alias("reason"), paths.route(p).alias("route"))


@case("""SELECT l_suppkey AS source_id, CASE WHEN l_partkey % 3 = 0 THEN 'depends' ELSE 'reference' END AS link_type, count(*) AS n
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
      WHERE (100000 + l_partkey) % 5 <> 0
      GROUP BY 1, 2""")
def deleted_links(spark, sf):
    """Links go by id; ids are named twice, and some are of no link."""
    links = fx.links(spark, sf)
    ids = links.where("target_id % 5 = 0").select("id")
    left = lifecycle.delete_links(links, ids.unionByName(ids).unionByName(ids.select((-F.col("id").bitwiseXOR(F.lit(1))).alias("id")).join(links.select("id"), "id", "left_anti")))
    return left.groupBy("source_id", "link_type").agg(F.count("*").alias("n"))


@case("""SELECT o_custkey AS task, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INT AS rank
      FROM orders
      WHERE o_orderkey % 2 = 0
      QUALIFY rank <= 5""")
def curated_candidates(spark, sf):
    """A chooser's answer for each customer's orders: the even ones, newest first, one named twice, and an id that is no candidate."""
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("id"))
    candidates = o.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("id")))
    even = F.reverse(F.array_sort(F.collect_list(F.when(F.col("id") % 2 == 0, F.col("id")))))
    chosen = o.groupBy("task").agg(even.alias("e")).select("task", F.concat(F.array(F.lit(-1).cast("long")), F.col("e").cast("array<long>"), F.slice(F.col("e").cast("array<long>"), 1, 1)).alias("ids"))
    return context.curate(candidates.withColumn("id", F.col("id").cast("long")), 5, chosen, ("task",)).select("task", "id", "rank")


@case("SELECT o_orderkey AS id, o_orderkey % 6 IN (0, 1, 3) AS may_read, o_orderkey % 6 IN (0, 2, 3) AS may_write, o_orderkey % 6 IN (4, 5) AS may_ingest FROM orders")
def granted_scopes(spark, sf):
    kinds = F.array(*(F.array(*map(F.lit, k)).cast("array<string>") for k in ((), ("read",), ("write",), ("admin",), ("ingest",), ("ingest", "other"))))
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("scopes"))
    return o.select("id", *(context.allows(F.col("scopes"), w).alias(f"may_{w}") for w in ("read", "write", "ingest")))


@case("""SELECT o_orderkey AS id, '[id=' || o_orderkey || '] [' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'pending' END || '] order of ' || o_custkey || ' (scope=' || CASE WHEN o_custkey % 2 = 0 THEN 'user' ELSE '' END || ', priority=' || o_orderpriority
             || CASE WHEN o_orderkey % 3 = 0 THEN ', due=' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END || ')' || chr(10) AS text
      FROM orders""")
def task_rows(spark, sf):
    """Orders as tasks: without a status, a scope or a due date some of them."""
    o = fx.table(spark, sf, "orders")
    some = lambda condition, value: F.when(F.expr(condition), value)
    meta = F.to_json(F.struct(some("o_orderkey % 4 <> 0", F.lit("pending")).alias("status"), some("o_custkey % 2 = 0", F.lit("user")).alias("scope"), F.col("o_orderpriority").alias("priority"), some("o_orderkey % 3 = 0", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due")))
    return context.task_rows(o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("content"), meta.alias("metadata")))


#: Of all pages, and of those of each host under .net, which brings back what ends in 5.
IGNORED = ("# pages", "m.*/", "/blog.*/en/", "*5", "!*25", "*/fr/8??")
IGNORED_OF_HOST = ("de/", "!*5")
PAGE_PATH = "rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/')"
LAST = "regexp_extract(path, '([^/]*)$', 1)"


@case(f"""WITH p AS (SELECT DISTINCT {PAGE_PATH} AS path FROM pages),
      q AS (SELECT path, {LAST} AS name, regexp_extract(path, '^[^/]*', 0) LIKE '%.net' AND contains(path, '/') AS net FROM p WHERE path <> '')
      SELECT path, regexp_matches(path, '(^|/)m\\.[^/]*/') OR regexp_matches(path, '^blog\\.[^/]*/en/') OR (net AND regexp_matches(path, '^[^/]*/(.*/)?de/')) OR CASE WHEN net AND name LIKE '%5' THEN false WHEN regexp_matches(path, '^[^/]*/fr/8[^/][^/]$') THEN true WHEN name LIKE '%25' THEN false ELSE name LIKE '%5' END AS ignored
      FROM q""")
def ignored_pages(spark, sf):
    """Pages as paths, under rules of the root and of each host of one kind: negated, bound to a place, for folders only."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    pages = fx.table(spark, sf, "pages").select(path.alias("path"))
    root = spark.createDataFrame([("", n, t) for n, t in enumerate(IGNORED)], "base string, line int, pattern string")
    hosts = pages.where("contains(path, '/')").select(F.regexp_extract("path", "^[^/]*", 0).alias("base")).where("base like '%.net'").distinct()
    own = hosts.select("base", F.posexplode(F.array(*map(F.lit, IGNORED_OF_HOST))).alias("line", "pattern"))
    return ignores.decided(pages, ignores.rules(root.unionByName(own)))


def manifests(spark, sf):
    f = fx.files(spark, sf).withColumn("sha256", F.sha2("content", 256))
    stored = f.where("id % 4 <> 1").select("path", F.when(F.col("id") % 8 == 2, F.lit("00")).otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("gone/a.md", "11"), ("gone/b.go", "22")], "path string, sha256 string"))
    return f.select("path", "sha256", "size"), stored


SYNC = with_(
    "files",
    stored="SELECT path, id FROM files WHERE id % 4 <> 1 UNION ALL SELECT 'gone/a.md', NULL UNION ALL SELECT 'gone/b.go', NULL",
    synced=f"""SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'orphan' WHEN r IS NOT NULL THEN 'skip' WHEN s.path IS NOT NULL AND f.id % 8 <> 2 THEN 'unchanged' ELSE 'need' END AS action, r AS reason
          FROM (SELECT *, {REASON} AS r FROM files) f
          FULL
          JOIN stored s ON s.path = f.path""",
)


@case(SYNC + "SELECT * FROM synced")
def manifest_sync(spark, sf):
    return corpus.sync(*manifests(spark, sf))


@case(SYNC + "SELECT reason, count(*) AS n FROM synced WHERE action = 'skip' GROUP BY reason")
def manifest_skips(spark, sf):
    return corpus.skip_counts(corpus.sync(*manifests(spark, sf)))


@case("""SELECT page_id, 'https://x/r' || CASE WHEN page_id % 3 = 0 THEN ' ' ELSE '@c' || CAST(page_id AS VARCHAR) || ' ' END || url || ':L' || CAST(page_id AS VARCHAR) || '-' || CAST(page_id + 9 AS VARCHAR) AS cite
      FROM pages""")
def citations(spark, sf):
    p = fx.table(spark, sf, "pages")
    commit = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("page_id").cast("string")))
    return p.select("page_id", corpus.citation(F.lit("https://x/r"), commit, F.col("url"), F.col("page_id"), F.col("page_id") + 9).alias("cite"))


def doc_tables(spark, sf):
    f = fx.files(spark, sf)
    docs = f.select("id", F.lit("ns").alias("namespace"), F.lit(1).alias("user_id"), F.when(F.col("id") % 3 > 0, "repo").alias("repo_url"), "path")
    chunks = f.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    return docs, chunks


@case(with_("files") + """SELECT id AS document_id, count(*) AS n
      FROM (SELECT id FROM files, range(2) WHERE id % 5 <> 0 UNION ALL SELECT id + 5000 FROM files, range(3) WHERE id % 5 = 0)
      GROUP BY 1""")
def upsert_replaces(spark, sf):
    docs, chunks = doc_tables(spark, sf)
    new = docs.where("id % 5 = 0").withColumn("id", F.col("id") + 5000)
    new_chunks = new.select(F.col("id").alias("document_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("ordinal"))
    return corpus.upsert_documents(docs, chunks, new, new_chunks)[1].groupBy("document_id").agg(F.count("*").alias("n"))


@case(with_("files") + "SELECT id FROM files WHERE NOT (id % 3 = 0 AND id % 2 = 0)")
def delete_loose_documents(spark, sf):
    docs, chunks = doc_tables(spark, sf)
    gone = docs.where("id % 2 = 0").select(F.lit(None).cast("string").alias("repo_url"), "path")
    return corpus.delete_documents(docs, chunks, gone)[0].select("id")


@case(None)
def chunked_pages(spark, sf):
    """Chunks of all files by their route; tests hold spans and cuts against their rules."""
    return chunking.chunk_documents(fx.files(spark, sf))


@case(with_("files") + "SELECT 0 AS bad, count(*) AS files FROM files WHERE " + ROUTED)
def chunk_span_rules(spark, sf):
    """No chunk of any file breaks a span rule, and every routed file has chunks."""
    c = chunking.chunk_documents(fx.files(spark, sf))
    bad = corpus.span_errors(c, "path").agg(F.count("*").cast("int").alias("bad"))
    return bad.crossJoin(c.agg(F.countDistinct("path").alias("files")))


@case(with_("files") + f"""SELECT path, coalesce({REASON.replace('size', 'length(content)')}, CASE WHEN id % 5 = 1 THEN 'bad hash' WHEN id % 5 = 2 THEN 'hash does not match' WHEN id % 5 = 3 THEN 'not text' END) AS error
      FROM files""")
def upload_errors(spark, sf):
    i, body = F.col("id"), F.when(F.col("id") % 5 == 3, F.concat("content", F.lit("\0"))).otherwise(F.col("content")).cast("binary")
    sha = F.when(i % 5 == 1, "zz").when(i % 5 == 2, F.lit("0" * 64)).otherwise(F.upper(F.sha2(body, 256)))
    return corpus.upload_errors(fx.files(spark, sf).select("path", sha.alias("sha256"), body.alias("content"))).select("path", "error")


CHUNK_QUERIES = ((1, "page"), (2, "the tion"), (3, "example.com"), (4, "exampleCom"))


@case(
    with_(
        queries="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in CHUNK_QUERIES) + ") q(query_id, text)",
        facts="SELECT page_id AS id, html AS content, '' AS subject, '' AS category, NULL AS superseded_by, page_id % 10 = 0 AS generated FROM pages",
        **{k: v.replace("content || ' ' || subject || ' ' || category", "content") for k, v in bm25_views("NOT generated").items() if k != "queries"},
        lq="SELECT query_id, 'example com' AS text FROM queries WHERE query_id IN (3, 4)",
        dd=r"""SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '[/._:\-]', ' ', 'g'), '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')))), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms
              FROM facts
              WHERE NOT generated""",
        lhits="SELECT query_id, w, id, len(terms) AS n, len(list_filter(terms, lambda t: t = w)) AS tf FROM lq, unnest(['example', 'com']) u(w), dd WHERE list_contains(terms, w)",
        lidf="""SELECT query_id, w, CASE WHEN ln((d - h + 0.5) / (h + 0.5)) <= 0 THEN 1e-6 ELSE ln((d - h + 0.5) / (h + 0.5)) END AS idf
              FROM (SELECT query_id, w, count(*) AS h FROM lhits GROUP BY ALL), (SELECT count(*) AS d FROM dd)""",
        loose="""SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))) AS score
              FROM lhits
              JOIN lidf USING (query_id, w), (SELECT avg(len(terms)) AS m FROM dd)
              GROUP BY ALL
              HAVING count(*) = 2""",
        tiers="""SELECT query_id, id, 0 AS tier, score
              FROM lexical
              UNION ALL SELECT query_id, id, 1, score
              FROM loose l
              WHERE NOT EXISTS (SELECT 1 FROM lexical x WHERE x.query_id = l.query_id AND x.id = l.id)""",
        placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, id) AS place FROM tiers",
    )
    + "SELECT query_id, CAST(place AS INTEGER) AS place, id, tier, round(score, 6) AS score FROM placed WHERE place <= 12"
)
def corpus_search(spark, sf):
    p = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"), F.col("page_id").alias("document_id"), F.lit(0).alias("ordinal"), (F.col("page_id") % 10 == 0).alias("generated"))
    q = spark.createDataFrame(CHUNK_QUERIES, "query_id int, text string")
    return corpus.search_chunks(p, q, 12).select("query_id", "place", "id", "tier", F.round("score", 6).alias("score"))


# ---- sessions


@case(with_("turns") + """SELECT session_id, string_agg(left(content, 100000), ' ' ORDER BY turn_index DESC) AS query
      FROM (SELECT * FROM turns WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) <= 3)
      GROUP BY session_id""")
def session_queries(spark, sf):
    return sessions.search_query(fx.turns(spark, sf), most=100000)


@case(with_("turns") + """SELECT session_id, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY turn_index) AS snippet
      FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) <= 3)
      GROUP BY session_id""")
def session_snippets(spark, sf):
    return sessions.snippet(fx.turns(spark, sf), most=100000)


@case(with_("turns", lines="SELECT session_id, turn_index, '[' || role || ']: ' || content AS t FROM turns", used="SELECT *, sum(strlen(t) + 5) OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS u FROM lines") + "SELECT session_id, string_agg(t, chr(10) || '---' || chr(10) ORDER BY turn_index) AS text FROM used WHERE u <= 900 GROUP BY session_id")
def session_corpus(spark, sf):
    return sessions.corpus_text(fx.turns(spark, sf), turn_bytes=100000, total=900)


@case(with_("turns") + "SELECT turn_index, role, content FROM turns WHERE session_id = '2'")
def session_turns(spark, sf):
    return sessions.turns_of(fx.turns(spark, sf), "2").select("turn_index", "role", "content")


@case("""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, text AS content
      FROM conversations
      WHERE role IN ('user', 'assistant') AND text <> ''""")
def transcripts(spark, sf):
    c = fx.table(spark, sf, "conversations")
    body = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))))
    items = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")))
    line = F.coalesce(body, F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", items.alias("content")).alias("message"))))
    return sessions.parse_transcript(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line_no"), line.alias("value"))).select("session_id", "turn_index", "role", "content")


@case("SELECT CAST(doc_id AS VARCHAR) AS ref_id, avg(2.0 * quality - 1) AS avg, count(*) AS n FROM labels GROUP BY 1")
def feedback_stats(spark, sf):
    return sessions.feedback_stats(fx.feedback(spark, sf))


@case("SELECT CAST(d.doc_id AS VARCHAR) AS ref_id, coalesce(avg(2.0 * quality - 1), 0) AS avg FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def feedback_averages(spark, sf):
    return sessions.feedback_average(fx.feedback(spark, sf), fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("ref_id")))


@case("SELECT event_id AS id, value AS relevance FROM events WHERE user_id % 5 = 1 AND event_type = 'view' OR (event_type = 'click' AND user_id % 7 = 2)")
def pending_hints(spark, sf):
    e = fx.table(spark, sf, "events").where("event_type in ('view', 'click')")
    hints = e.select(F.col("event_id").alias("id"), F.when((F.col("event_type") == "view") & (F.col("user_id") % 5 == 1), "s").otherwise("other").alias("session_id"), F.when((F.col("event_type") == "click") & (F.col("user_id") % 7 == 2), "/w").otherwise("/").alias("cwd"), F.col("value").alias("relevance"), F.lit(1.0).alias("desirability"), F.lit(None).cast("timestamp").alias("consumed_at"))
    return sessions.pending_hints(hints, "s", "/w").select("id", "relevance")


@case("SELECT event_id, greatest(0, least(3, value / 100)) AS desirability, NOT (greatest(0, least(3, value / 100)) < 0.5 AND user_id % 3 = 0) AS worth FROM events")
def hint_worth(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", sessions.desirability(F.col("value") / 100).alias("desirability"), sessions.worth_a_hint(F.col("value") / 100, F.col("user_id") % 3).alias("worth"))


@case("""SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'general' WHEN n_regionkey IN (1, 2) THEN CASE WHEN n_nationkey % 2 = 0 THEN 'user' ELSE 'ann' END ELSE n_name END AS subject, CASE n_regionkey WHEN 0 THEN 'note' WHEN 1 THEN 'identity' WHEN 2 THEN 'preference' ELSE 'project' END AS category, CASE n_regionkey WHEN 0 THEN 'general' WHEN 1 THEN 'user' WHEN 2 THEN 'preference' ELSE 'project' END AS scope
      FROM nation""")
def summary_routes(spark, sf):
    scope = F.element_at(F.array(*map(F.lit, ("general", "user", "preference", "project", "odd"))), F.col("n_regionkey") + 1)
    persona = F.when(F.col("n_nationkey") % 2 == 1, "ann").otherwise("")
    return fx.table(spark, sf, "nation").select("n_name", sessions.summary_route(scope, F.col("n_name"), persona).alias("r")).select("n_name", "r.*")


@case("""SELECT r_name, 'Lead ' || r_name || CASE WHEN r_regionkey > 0 THEN chr(10) || chr(10) || 'Decisions:' || chr(10) || '- ' || array_to_string(list_transform(range(r_regionkey), lambda i: 'd' || CAST(i AS VARCHAR)), chr(10) || '- ') ELSE '' END AS text
      FROM region""")
def summary_texts(spark, sf):
    items = F.when(F.col("r_regionkey") > 0, F.transform(F.sequence(F.lit(0), F.col("r_regionkey") - 1), lambda i: F.concat(F.lit(" d"), i.cast("string"), F.lit(" ")))).otherwise(F.array(F.lit("  ")))
    return fx.table(spark, sf, "region").select("r_name", sessions.summary_text(F.concat(F.lit(" Lead "), "r_name"), items, F.array(F.lit(" "))).alias("text"))


# ---- context and recall

TASKS = ((1, "the ounty tion"), (2, "la de"), (3, "zz qq"))


@case(
    with_(
        "facts",
        **bm25_views() | {"queries": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TASKS) + ") q(query_id, text)"},
        lex="SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20",
        res="SELECT query_id, f.id, subsystem, score / max(score) OVER (PARTITION BY query_id) + least(0.05 * confirmed_count, 0.15) AS score FROM lex JOIN facts f ON f.id = lex.id",
        results="SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10",
        live="SELECT * FROM facts WHERE superseded_by IS NULL",
        tiers="""SELECT DISTINCT query_id, l.id, CASE kind WHEN 'invariant' THEN 0 ELSE 1 END AS tier, 0.0::DOUBLE AS score
              FROM live l
              JOIN results s USING (subsystem)
              WHERE kind IN ('invariant', 'failure_mode') AND subsystem <> ''
              UNION ALL SELECT query_id, l.id, 2, 0.0
              FROM live l, queries q
              WHERE kind = 'trigger' AND len(list_filter(string_split(q.text, ' '), lambda w: strlen(w) >= 3 AND contains(lower(content), w))) > 0
              UNION ALL SELECT query_id, id, 3, score
              FROM results""",
        firsts="SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY tier) = 1",
    )
    + "SELECT query_id AS task_id, ['invariant', 'failure_mode', 'trigger', 'relevant'][tier + 1] AS tier, id, round(score, 6) AS score FROM firsts"
)
def task_context(spark, sf):
    tasks = spark.createDataFrame(TASKS, "query_id int, text string")
    return context.get_context(fx.facts(spark, sf), tasks, limit=10).withColumn("score", F.round("score", 6))


@case(with_("files") + """SELECT path AS file, 1 AS id
      FROM files
      WHERE path LIKE '%.md'
      UNION ALL SELECT path, 2
      FROM files
      WHERE regexp_matches(path, '(^|/)lib/([^/]*/)*[^/]*$')
      UNION ALL SELECT path, 3
      FROM files
      WHERE regexp_matches(path, '(^|/)page1[0-9]\\.txt$')""")
def file_triggers(spark, sf):
    triggers = spark.createDataFrame([(1, "*.md"), (2, "lib/**"), (3, "page1?.txt"), (4, "none/*")], "id int, signal string")
    return context.file_triggers(triggers, fx.files(spark, sf).select(F.col("path").alias("file")))


@case("SELECT c_custkey AS id, c_mktsegment AS status, CASE WHEN c_custkey % 4 >= 2 THEN NULL ELSE 'task' END AS surface FROM customer WHERE c_custkey % 4 = 1")
def task_updates(spark, sf):
    c = fx.table(spark, sf, "customer").where("c_custkey % 4 in (1, 2)")
    tasks = c.select(F.col("c_custkey").alias("id"), F.lit("task").alias("kind"), F.lit(None).cast("long").alias("superseded_by"), F.to_json(F.struct(F.lit("task").alias("surface"), F.lit("pending").alias("status"), F.col("c_mktsegment").alias("segment"))).alias("metadata"))
    changes = tasks.where("id % 4 = 2").select("id", F.lit("completed").alias("status"), F.lit('say "done"').alias("note"))
    after = context.list_tasks(context.update_tasks(tasks, changes), "pending")
    return after.select("id", F.get_json_object("metadata", "$.segment").alias("status"), F.get_json_object("metadata", "$.surface").alias("surface"))


RECALL = {
    "req": "SELECT item_id, text, regexp_split_to_array(text, '\\s+') AS ws FROM benchmark",
    "w0": f"""SELECT item_id, pos, word
          FROM (SELECT item_id, generate_subscripts(ws, 1) AS pos, unnest(list_transform(ws, lambda w: lower(trim(w, '.,;:!?\"''()[]{{}}')))) AS word FROM req)
          WHERE strlen(word) >= 3 AND word NOT IN {STOPS}
          QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY pos) = 1""",
    "live": "SELECT * FROM facts WHERE superseded_by IS NULL",
    "an": f"SELECT id, {TERMS.format("content || ' ' || subject || ' ' || category")} AS terms FROM live",
    "dfs": "SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest(terms) AS word FROM an) GROUP BY word",
    "idfs": "SELECT item_id, pos, w0.word, ln((SELECT count(*) FROM live) / (coalesce(df, 0) + 1)) AS idf FROM w0 LEFT JOIN dfs USING (word)",
    "kw": "SELECT * FROM idfs WHERE idf >= greatest(0.15 * ln((SELECT count(*) FROM live)), 0.5) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY idf DESC, pos) <= 5",
}


PROMPTS = ((1, "s1", "the there hahere ndound worthless thention", "/work/src3/lib", "src3"), (2, "s2", "les pour dans eauxment menteux", "/home", ""), (3, "s1", "and of", "", ""))
RECALL_FULL = with_(
    "facts",
    **RECALL
    | {
        "req": "SELECT item_id, text, cwd, project, regexp_split_to_array(text, '\\s+') AS ws FROM (VALUES " + ", ".join(f"({i}, '{p}', '{c}', '{n}')" for i, _, p, c, n in PROMPTS) + ") q(item_id, text, cwd, project)",
        "h": "SELECT k.item_id, k.word, a.id, len(terms) AS n, len(list_filter(terms, lambda t: t = k.word)) AS tf FROM kw k JOIN an a ON list_contains(terms, k.word)",
        "hd": "SELECT word, count(DISTINCT id) AS hv FROM h GROUP BY word",
        "bm": """SELECT item_id, word, id, greatest(ln((d - hv + 0.5) / (hv + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m)) AS score
              FROM h
              JOIN hd USING (word), (SELECT count(*) AS d, avg(len(terms)) AS m FROM an)""",
        "b1": "SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY score DESC, id) <= 20",
        "b2": "SELECT item_id, word, b1.id, score / max(score) OVER (PARTITION BY item_id, word) + least(0.05 * confirmed_count, 0.15) AS combined FROM b1 JOIN facts f ON f.id = b1.id",
        "b3": "SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY combined DESC, id) <= 10",
        "c": "SELECT item_id, id, sum(combined) AS score, count(*) AS hits FROM b3 GROUP BY ALL",
        "w": """SELECT item_id, f.*, hits, project, cwd, lower(subject) = lower(project) AS own, project <> '' AS known, coalesce(metadata ->> '$.quality', '') AS quality, coalesce(metadata ->> '$.surface', '') AS surface, metadata ->> '$.project_path' AS pp, score AS s0
              FROM c
              JOIN facts f USING (id)
              JOIN req USING (item_id)""",
        "x": """SELECT *, s0 * CASE WHEN kind = 'decision' THEN 1.5 WHEN kind IN ('convention', 'invariant') THEN 1.3 ELSE 1 END * CASE WHEN known AND own THEN 2.5 WHEN known THEN 0.3 ELSE 1 END * CASE WHEN surface = 'project' AND cwd <> '' AND (cwd = pp OR starts_with(cwd, pp || '/')) THEN 4 ELSE 1 END * CASE WHEN hits > 1 THEN 1 + 0.2 * (hits - 1) ELSE 1 END AS s1
              FROM w
              WHERE NOT (starts_with(quality, 'local:') OR kind = 'trigger' OR (kind = 'pattern' AND surface <> 'project') OR (kind = 'summary' AND known AND NOT own))""",
        "fb": "SELECT doc_id AS id, avg(2.0 * quality - 1) AS a, count(*) AS n FROM labels GROUP BY 1",
        "y": """SELECT x.* EXCLUDE (s1), s1 * CASE WHEN n > 0 THEN pow(2, a * (0.4 + 0.6 * least(n, 5) / 5)) ELSE 1 END AS score
              FROM x
              LEFT
              JOIN fb USING (id)
              WHERE NOT (item_id IN (1, 3) AND id % 17 = 0)""",
        "z": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM y",
    },
)


@case(RECALL_FULL + "SELECT item_id AS request_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM z WHERE rank <= 5 AND score >= 0.3 * best AND score >= 0.35")
def recall_for_prompts(spark, sf):
    req = spark.createDataFrame(PROMPTS, "request_id int, session_id string, prompt string, cwd string, project string").withColumn("budget", F.lit(1 << 20)).withColumn("result_limit", F.lit(5))
    f = fx.facts(spark, sf)
    seen = f.where("id % 17 = 0").select(F.lit("s1").alias("session_id"), "id")
    got = recall.recall(f, req, feedback=fx.feedback(spark, sf), seen=seen)
    return got.select("request_id", "rank", "id", F.round("score", 6).alias("score"))


# ---- transfer


def users(spark):
    return spark.createDataFrame([(0, "ann"), (1, "bob"), (2, "cy")], "id long, name string")


@case(with_("facts") + "SELECT id, content, superseded_by, CASE user_id WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' WHEN 2 THEN 'cy' ELSE '' END AS owner FROM facts")
def export_rows(spark, sf):
    return transfer.export_facts(fx.facts(spark, sf), users(spark)).select("id", "content", "superseded_by", "owner")


@case(
    with_("facts", t="SELECT DISTINCT content, subject, namespace FROM facts WHERE id % 3 = 0 AND superseded_by IS NULL", kept="SELECT f.* FROM facts f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.content = f.content AND t.subject = f.subject AND t.namespace = f.namespace)", m="SELECT id AS old_id, 1000000 + row_number() OVER (ORDER BY id) AS id FROM kept")
    + """SELECT m.id, f.content, n.id AS superseded_by, CASE WHEN n.id IS NOT NULL THEN f.superseded_at END AS superseded_at
          FROM kept f
          JOIN m ON m.old_id = f.id
          LEFT
          JOIN m n ON n.old_id = f.superseded_by"""
)
def import_remaps(spark, sf):
    f = fx.facts(spark, sf)
    return transfer.import_facts(f.where("id % 3 = 0"), transfer.export_facts(f, users(spark)), owner=9, start=1000000)[0].select("id", "content", "superseded_by", "superseded_at")


@case(with_("facts") + "SELECT id, CASE WHEN user_id = 2 THEN 9 ELSE user_id END AS user_id, CASE WHEN subject = 'src3' AND category NOT IN ('en') THEN '' ELSE subject END AS subject FROM facts")
def owner_backfill(spark, sf):
    f = fx.facts(spark, sf).withColumn("user_id", F.when(F.col("user_id") != 2, F.col("user_id"))).withColumn("category", F.when(F.col("category") == "en", "identity").otherwise(F.col("category")))
    return transfer.backfill_owner(f, 9, "src3").select("id", "user_id", "subject")


@case(with_("facts") + "SELECT id, CASE WHEN kind <> '' THEN kind WHEN json_type(metadata, '$.surface') = 'VARCHAR' THEN metadata ->> '$.surface' ELSE '' END AS kind FROM facts")
def kind_backfill(spark, sf):
    f = fx.facts(spark, sf).withColumn("metadata", F.replace("metadata", F.lit('"surface"'), F.lit('"kind"')))
    return transfer.backfill_kind(f).select("id", "kind")


# ---- streams, run to their end over the given files


def drained(spark, sf, name: str, make, mode: str = "append"):
    """A stream over a table, run to the end of its input into a table in the shared folder, and read back."""
    source = streamed(spark, f"{sf}/{name}.parquet")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"

    def save(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = make(source).writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def answers_in_time(text: str, attempt: int) -> list[list[float]]:
    """A stand-in for a model that refuses some texts, by their length: one in seven for good, others at their first attempts."""
    n = len(text)
    if n % 7 == 0:
        raise ValueError("refused")
    if attempt <= n % 3:
        raise queue.Retryable("busy")
    return [[float(n), float(attempt)]]


@case("SELECT doc_id AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text' WHEN length(text) % 7 = 0 THEN 'refused' END AS error, CASE WHEN trim(coalesce(text, '')) <> '' AND length(text) % 7 <> 0 THEN length(text) END AS size, CASE WHEN trim(coalesce(text, '')) <> '' AND length(text) % 7 <> 0 THEN length(text) % 3 + 1 END AS attempt FROM documents")
def stream_retries(spark, sf):
    """All documents through a queue whose model fails, until none waits: what was stored, and at which attempt; what was quarantined, and why."""
    source = streamed(spark, f"{sf}/documents.parquet")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    facts = source.select(F.col("doc_id").alias("id"), "text")
    queue.drain(queue.embedding_queue(facts, f"{at}/out", f"{at}/state", "stand-in", 2, answers_in_time, every="0 seconds", wait=0.001), 3600)
    stored, failed, _ = queue.outcomes(spark, f"{at}/out")
    v = lambda i: F.col("vector")[i].cast("long")
    return stored.select("id", F.lit(None).cast("string").alias("error"), v(0).alias("size"), v(1).alias("attempt")).unionByName(failed.select("id", "error"), allowMissingColumns=True)


@case("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicates(spark, sf):
    """Every event is sent twice; each is kept once."""
    twice = lambda s: jobs.first_turns(s.unionByName(s).select(F.col("event_id").cast("string").alias("uuid"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_id", "user_id", "event_type"), "40 days").select("event_id", "user_id", "event_type")
    return drained(spark, sf, "events", twice)


@case(
    with_(
        g="SELECT user_id, event_type, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600 THEN 1 ELSE 0 END AS gap FROM events",
        s="SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS stretch FROM g",
        l="SELECT * FROM s QUALIFY stretch = max(stretch) OVER (PARTITION BY user_id)",
        f="SELECT user_id, event_type, max(ts) AS t FROM l GROUP BY ALL",
    )
    + """SELECT user_id, files, seen FROM (SELECT user_id, string_agg(event_type, ',' ORDER BY t, event_type) AS files FROM f GROUP BY user_id)
      JOIN (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS seen FROM (SELECT DISTINCT user_id, event_id FROM l) GROUP BY user_id) USING (user_id)"""
)
def stream_remembers(spark, sf):
    """Session memory as a stream's state, at its end: the same files as recent_files of the whole table."""
    made = lambda s: memory.session_memory(s.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("file"), F.col("event_id").alias("fact_id"), "ts"), "40 days")
    got = memory.latest(drained(spark, sf, "events", made, "update"))
    return got.select(F.col("session_id").cast("long").alias("user_id"), F.array_join("files", ",").alias("files"), F.array_join(F.col("seen").cast("array<string>"), ",").alias("seen"))


@case("SELECT item_id AS id, 64 AS size, 1.0 AS length FROM benchmark")
def stream_embeds(spark, sf):
    def make(s):
        f = s.select(F.col("item_id").alias("id"), F.lit("b").alias("subject"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
        return jobs.embed(f)[0]

    from tessera.functions.vector import norm

    return drained(spark, sf, "benchmark", make).select("id", F.size("vector").alias("size"), F.round(norm(F.col("vector")), 5).alias("length"))


@case("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    return jobs.windowed_counts(fx.table(spark, sf, "events"))


@case("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS gap FROM events), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, gap DESC) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n
      FROM s
      GROUP BY user_id, k""")
def session_stretches(spark, sf):
    return jobs.session_stretches(fx.table(spark, sf, "events"), user="user_id")
