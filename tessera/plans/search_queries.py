"""Filters, point reads, counts and search over the stand-in facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.meta import MetaFilter
from tessera.functions.text import STOP_WORDS, candidate_words, decomposed, terms, weight
from tessera.operators import facts as facts_ops
from tessera.operators import search
from tessera.operators.facts import Options, Scope
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import with_

CASES: dict[str, tuple] = {}


def case(sql: str | None):
    """Registers a query with its SQL."""

    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


BRIEF = ("id", "namespace", "subject", "category", "kind")


@case(with_("facts") + "SELECT id, namespace, subject, category, kind FROM facts WHERE subject = 'src3' AND category = 'en' AND superseded_by IS NULL AND namespace = 'ns1'")
def list_by_columns(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(subject="src3", category="en"), Scope("ns1")).select(*BRIEF)


@case(with_("facts") + """SELECT id, namespace, subject, category, kind
      FROM facts
      WHERE kind = 'decision' AND subsystem = 'sub3' AND namespace IN ('ns0', 'ns2') AND user_id = 0 ORDER BY id LIMIT 5""")
def list_by_scope_with_limit(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(kind="decision", subsystem="sub3", only_active=False, limit=5), Scope(namespaces=("ns0", "ns2"), user_id=0)).select(*BRIEF)


@case(with_("facts") + "SELECT id, namespace, subject, category, kind FROM facts WHERE id IN (3, 5, 8, 13, 21, 100000)")
def list_by_ids(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(ids=(3, 5, 8, 13, 21, 100000), only_active=False)).select(*BRIEF)


@case(with_("facts") + """SELECT id, metadata
      FROM facts
      WHERE superseded_by IS NULL AND json_type(metadata, '$.chapter') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(metadata ->> '$.chapter' AS DOUBLE) <= 3""")
def metadata_number(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(metadata=(MetaFilter("chapter", "<=", 3),))).select("id", "metadata")


@case(with_("facts") + """SELECT id, metadata
      FROM facts
      WHERE superseded_by IS NULL AND (metadata IS NULL OR json_type(metadata, '$.chapter') IS NULL OR (json_type(metadata, '$.chapter') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(metadata ->> '$.chapter' AS DOUBLE) <> 3))""")
def metadata_number_or_absent(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(metadata=(MetaFilter("chapter", "!=", 3, include_null=True),))).select("id", "metadata")


@case(with_("facts") + "SELECT id, metadata FROM facts WHERE superseded_by IS NULL AND json_type(metadata, '$.surface') = 'VARCHAR' AND metadata ->> '$.surface' = 'project'")
def metadata_text(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(metadata=(MetaFilter("surface", "=", "project"),))).select("id", "metadata")


@case("SELECT event_id, event_type FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) >= 50 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def metadata_and_time_of_events(spark, sf):
    rows = fx.table(spark, sf, "events").withColumnsRenamed({"props": "metadata", "ts": "created_at"})
    o = Options(only_active=False, metadata=(MetaFilter("k", ">=", 50),), created_from="2024-01-05 00:00:00", created_to="2024-01-06 00:00:00")
    return rows.where(facts_ops.predicate(o)).select("event_id", "event_type")


@case(with_("facts") + "SELECT id, created_at FROM facts WHERE superseded_by IS NULL AND created_at >= TIMESTAMP '2024-01-03 05:00:00' AND created_at <= TIMESTAMP '2024-01-04 05:00:00'")
def created_between(spark, sf):
    return facts_ops.list_facts(fx.facts(spark, sf), Options(created_from="2024-01-03 05:00:00", created_to="2024-01-04 05:00:00")).select("id", "created_at")


@case(with_("facts") + "SELECT id, content FROM facts WHERE id = 42")
def get_fact(spark, sf):
    return facts_ops.get(fx.facts(spark, sf), 42).select("id", "content")


@case(with_("facts") + "SELECT id, content FROM facts WHERE subject = 'src7' AND superseded_by IS NULL")
def facts_by_subject(spark, sf):
    return facts_ops.by_subject(fx.facts(spark, sf), "src7").select("id", "content")


@case(with_("facts") + "SELECT count(*) AS n FROM facts WHERE superseded_by IS NULL")
def active_count(spark, sf):
    return facts_ops.active_count(fx.facts(spark, sf))


@case(with_("facts") + "SELECT DISTINCT subsystem FROM facts WHERE subsystem <> '' AND superseded_by IS NULL")
def subsystems(spark, sf):
    return facts_ops.list_subsystems(fx.facts(spark, sf))


@case(
    with_("facts", active="SELECT * FROM facts WHERE superseded_by IS NULL", counts="""SELECT 'subject' AS dimension, subject AS key, count(*) AS n
          FROM active
          GROUP BY 2
          UNION ALL SELECT 'category', category, count(*)
          FROM active
          GROUP BY 2
          UNION ALL SELECT 'kind', kind, count(*)
          FROM active
          WHERE kind <> ''
          GROUP BY 2""", placed="SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS position FROM counts")
    + """SELECT dimension, key, n, CAST(position AS INTEGER) AS position
          FROM placed
          WHERE dimension <> 'subject' OR position <= 10
          UNION ALL SELECT dimension, '+' || CAST(count(*) AS VARCHAR) || ' more', CAST(sum(n) AS BIGINT), 11
          FROM placed
          WHERE dimension = 'subject' AND position > 10
          GROUP BY dimension"""
)
def status_counts(spark, sf):
    return facts_ops.status(fx.facts(spark, sf), cap=10)


#: The same analyzer in SQL.
TERMS = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
QUERIES = ((1, "the tion"), (2, "de la"), (3, "there,and"), (4, "Was inwhin be"), (5, "und."), (6, "zzzz"), (7, "le ou les"))


def query_table(spark):
    return spark.createDataFrame(QUERIES, "query_id int, text string")


QUERY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ") q(query_id, text)"


def bm25_views(where: str = "superseded_by IS NULL") -> dict[str, str]:
    """BM25 in SQL: phrases by comparing slices of the term lists."""
    return {
        "queries": QUERY_SQL,
        "analyzed": f"SELECT id, {TERMS.format("content || ' ' || subject || ' ' || category")} AS terms FROM facts WHERE {where}",
        "size": "SELECT count(*) AS docs, avg(len(terms)) AS mean_len FROM analyzed",
        "words": f"SELECT query_id, unnest(list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: {TERMS.format('w')}), lambda p: len(p) > 0)) AS want FROM queries",
        "phrases": "SELECT query_id, row_number() OVER (PARTITION BY query_id) AS phrase, want FROM words",
        "hits": """SELECT query_id, phrase, id, len(terms) AS n, len(list_filter(range(1, len(terms) - len(want) + 2), lambda i: terms[i:i + len(want) - 1] = want)) AS tf
              FROM phrases, analyzed
              WHERE list_contains(terms, want[1])""",
        "found": "SELECT * FROM hits WHERE tf > 0",
        "having_": "SELECT query_id, phrase, count(*) AS h FROM found GROUP BY ALL",
        "idf": "SELECT query_id, phrase, CASE WHEN ln((docs - h + 0.5) / (h + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - h + 0.5) / (h + 0.5)) END AS idf FROM having_, size",
        "lexical": """SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_len))) AS score
              FROM found
              JOIN idf USING (query_id, phrase), size
              GROUP BY query_id, id
              HAVING count(*) = (SELECT count(*) FROM phrases p WHERE p.query_id = found.query_id)""",
    }


@case(with_("facts", **bm25_views()) + "SELECT query_id, id, round(score, 6) AS score FROM lexical")
def bm25_all(spark, sf):
    return search.bm25(fx.facts(spark, sf).where("superseded_by is null"), query_table(spark)).select("query_id", "id", F.round("score", 6).alias("score"))


@case(with_("facts", **bm25_views(), placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM lexical") + "SELECT query_id, id, round(score, 6) AS score FROM placed WHERE k <= 20")
def bm25_top(spark, sf):
    return search.bm25(fx.facts(spark, sf).where("superseded_by is null"), query_table(spark), fetch=20).select("query_id", "id", F.round("score", 6).alias("score"))


@case(with_("facts") + f"SELECT t AS term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, unnest({TERMS.format('content')}) AS t FROM facts) GROUP BY t")
def term_counts(spark, sf):
    return fx.facts(spark, sf).select("id", F.explode(terms(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


VECTOR_QUERIES = (3, 77, 250)
NEAREST = {
    "vqueries": f"SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id IN {VECTOR_QUERIES}",
    "sims": "SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score FROM embeddings, vqueries",
}


@case(with_(**NEAREST, placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sims WHERE score > 0") + "SELECT query_id, id, round(score, 6) AS score FROM placed WHERE k <= 15")
def nearest_vectors(spark, sf):
    v = fx.vectors(spark, sf)
    q = v.where(F.col("id").isin(*VECTOR_QUERIES)).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.nearest(v, q, 15).select("query_id", "id", F.round("score", 6).alias("score"))


def hybrid_inputs(spark, sf):
    """Facts with vectors; queries whose vectors are those of documents 1, 2, ..."""
    f = fx.facts(spark, sf).where("superseded_by is null").join(fx.vectors(spark, sf).select("id", "embedding"), "id", "left")
    q = query_table(spark).join(fx.vectors(spark, sf).select(F.col("id").cast("int").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")
    return f, q


def hybrid_views(fetch: int) -> dict[str, str]:
    return bm25_views() | {
        "qv": "SELECT query_id, embedding AS v FROM queries JOIN embeddings ON vec_id = query_id",
        "sims": """SELECT query_id, f.id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score
              FROM facts f
              JOIN embeddings e ON e.vec_id = f.id, qv
              WHERE superseded_by IS NULL""",
        "vec": f"SELECT * FROM sims WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {fetch}",
        "lex": f"SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {fetch}",
        "lexn": "SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS fts FROM lex",
        "merged": """SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, coalesce(fts, 0) AS fts, coalesce(v.score, 0) AS vec
              FROM lexn l
              FULL
              JOIN vec v ON l.query_id = v.query_id AND l.id = v.id""",
        "fused": "SELECT *, 0.6 * fts + 0.4 * vec AS combined FROM merged",
        "aged": """SELECT m.*, category, (combined + least(0.05 * confirmed_count, 0.15)) * pow(0.5, (epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(created_at)) / CASE category WHEN 'de' THEN 864000.0 ELSE 2592000.0 END) AS decayed, combined + least(0.05 * confirmed_count, 0.15) AS trusted
              FROM fused m
              JOIN facts f ON f.id = m.id""",
    }


def show():
    return ["query_id", "rank", "id", *[F.round(c, 6).alias(c) for c in ("fts", "vec", "combined")]]


@case(with_("facts", **hybrid_views(20), placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY trusted DESC, id) AS rank FROM aged") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(fts, 6) AS fts, round(vec, 6) AS vec, round(trusted, 6) AS combined FROM placed WHERE rank <= 10")
def hybrid_search(spark, sf):
    f, q = hybrid_inputs(spark, sf)
    return search.search(f, q, search.SearchOptions(max_results=10)).select(*show())


@case(with_("facts", **hybrid_views(20), placed="SELECT *, CASE WHEN category = 'fr' THEN trusted ELSE decayed END AS final FROM aged", ranked="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM placed") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(fts, 6) AS fts, round(vec, 6) AS vec, round(final, 6) AS combined FROM ranked WHERE rank <= 10")
def hybrid_with_decay(spark, sf):
    f, q = hybrid_inputs(spark, sf)
    o = search.SearchOptions(max_results=10, half_life_s=30 * 86400, category_half_life_s={"de": 10 * 86400, "fr": 0})
    return search.search(f, q, o).select(*show())


@case(with_("facts", **bm25_views(), lex="SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10", trusted="""SELECT query_id, f.id, score / max(score) OVER (PARTITION BY query_id) AS fts, score / max(score) OVER (PARTITION BY query_id) + least(0.05 * confirmed_count, 0.15) AS combined
      FROM lex
      JOIN facts f ON f.id = lex.id""", placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS rank FROM trusted") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(fts, 6) AS fts, round(combined, 6) AS combined FROM placed WHERE rank <= 5")
def lexical_search(spark, sf):
    f = fx.facts(spark, sf).where("superseded_by is null")
    return search.search(f, query_table(spark), search.SearchOptions(max_results=5), lexical_only=True).select("query_id", "rank", "id", F.round("fts", 6).alias("fts"), F.round("combined", 6).alias("combined"))


def rerank_sql(fused: str, where: str) -> str:
    return with_(
        "facts",
        **hybrid_views(40),
        pool="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS place FROM fused",
        scored=f"""SELECT p.*, q.text AS q, list_distinct({TERMS.format('q.text')}) AS qt, list_distinct({TERMS.format('content')}) AS dt, confirmed_count
              FROM pool p
              JOIN queries q USING (query_id)
              JOIN facts f ON f.id = p.id""",
        reranked="SELECT *, CASE WHEN place <= 8 THEN CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, dt)) / len(qt) END END AS rr FROM scored",
        final=f"SELECT *, CASE WHEN rr IS NULL THEN combined ELSE {fused} END + least(0.05 * confirmed_count, 0.15) AS score FROM reranked WHERE {where}",
        placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM final",
    ) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(rr, 6) AS rerank, round(score, 6) AS combined FROM placed WHERE rank <= 6"


def reranked(spark, sf, **options):
    f, q = hybrid_inputs(spark, sf)
    o = search.SearchOptions(max_results=6, rerank_candidates=8, rerank_bytes=1 << 30, **options)
    # The arms fetch for the default pool, so that a smaller pool shows in the ranks only.
    lexical, vector = search.bm25(f, q, fetch=40), search.nearest(f, q, 40)
    rows = search.rerank(search.merge_arms(lexical, vector, o.weights), f, q, o)
    rows = search.boosted(rows.join(f.select("id", "category", "confirmed_count", "created_at"), "id"), o, "2025-01-01")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "id"))
    return rows.withColumn("rank", place).where("rank <= 6").select("query_id", "rank", "id", F.round("rerank", 6).alias("rerank"), F.round("combined", 6).alias("combined"))


@case(rerank_sql("0.7 * rr + 0.3 * combined", "true"))
def rerank_balanced(spark, sf):
    return reranked(spark, sf, rerank_mode="balanced")


@case(rerank_sql("rr + 1e-6 * combined", "rr >= 0.5"))
def rerank_dominant_with_threshold(spark, sf):
    return reranked(spark, sf, rerank_mode="dominant", rerank_threshold=0.5)


@case(rerank_sql("combined", "rr >= 0.5"))
def rerank_gate(spark, sf):
    return reranked(spark, sf, rerank_mode="gate", rerank_threshold=0.5)


STOPS = "('" + "','".join(STOP_WORDS) + "')"


@case(
    """SELECT item_id, word
          FROM (SELECT item_id, unnest(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(trim(w, '.,;:!?\"''()[]{}')))) AS word FROM benchmark)
          WHERE strlen(word) >= 3 AND word NOT IN """ + STOPS + " GROUP BY ALL"
)
def prompt_words(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", F.explode(candidate_words(F.col("text"))).alias("word"))


@case(r"""SELECT page_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[/._:\-]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '\s+', ' ', 'g'))) AS words
      FROM pages""")
def decomposed_urls(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", decomposed(F.col("url")).alias("words"))


@case(r"SELECT page_id, length(regexp_replace(html, '\s', '', 'g')) AS weight FROM pages")
def page_weight(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", weight(F.col("html")).cast("long").alias("weight"))
