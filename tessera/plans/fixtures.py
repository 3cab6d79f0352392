"""How the given tables stand in for the store's: bindings of ours, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import spread

#: Views in SQL; each query's SQL names those it needs through with_().
VIEWS = {
    "facts": """
      SELECT doc_id AS id, 'ns' || CAST(doc_id % 3 AS VARCHAR) AS namespace, doc_id % 4 AS user_id, text AS content, source AS subject, lang AS category,
        CASE doc_id % 8 WHEN 0 THEN 'decision' WHEN 1 THEN 'convention' WHEN 2 THEN 'invariant' WHEN 3 THEN 'failure_mode' WHEN 4 THEN 'pattern' WHEN 5 THEN 'summary' WHEN 6 THEN 'trigger' ELSE '' END AS kind,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'sub' || CAST(doc_id % 5 AS VARCHAR) END AS subsystem,
        CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"chapter":' || CAST(doc_id % 10 AS VARCHAR) || '}'
          WHEN 2 THEN '{"chapter":"text","surface":"project","project_path":"/work/src' || CAST(doc_id % 20 AS VARCHAR) || '"}'
          ELSE '{"chapter":' || CAST(doc_id % 10 AS VARCHAR) || ',"quality":"' || CASE WHEN doc_id % 3 = 0 THEN 'local:draft' ELSE 'good' END || '"}' END AS metadata,
        CASE WHEN doc_id % 7 = 3 THEN doc_id + 1 WHEN doc_id % 7 = 4 THEN doc_id + 2 END AS superseded_by,
        CASE WHEN doc_id % 7 IN (3, 4) THEN TIMESTAMP '2024-06-01 00:00:00' END AS superseded_at,
        CAST(doc_id % 5 AS INTEGER) AS confirmed_count, CAST(doc_id % 11 AS INTEGER) AS use_count,
        TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS created_at
      FROM documents""",
    "vectors": "SELECT vec_id AS id, embedding, label FROM embeddings",
    "links": """
      SELECT row_number() OVER (ORDER BY l_suppkey, l_partkey) AS id, l_suppkey AS source_id, 100000 + l_partkey AS target_id, CASE WHEN l_partkey % 3 = 0 THEN 'depends' ELSE 'reference' END AS link_type, l_partkey % 4 = 0 AS bidirectional
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""",
    "chains": "SELECT o_orderkey AS id, o_custkey AS subject, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by, o_orderdate AS created_at FROM orders",
    "turns": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, role, text AS content FROM conversations",
    "feedback": "SELECT CAST(doc_id AS VARCHAR) AS ref_id, 'fact' AS ref_type, CAST(doc_id % 50 AS VARCHAR) AS session_id, 2 * quality - 1 AS score FROM labels",
    "files": """
      SELECT page_id AS id, 'src/' || CASE page_id % 9 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'docs/' WHEN 2 THEN '.git/' ELSE 'lib/' END || 'page' || CAST(page_id AS VARCHAR) ||
        CASE page_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.go' WHEN 2 THEN '.html' WHEN 3 THEN '.exe' WHEN 4 THEN '' WHEN 5 THEN '.PY' ELSE '.txt' END AS path,
        html AS content, CASE WHEN page_id % 13 = 0 THEN 2000000 ELSE length(html) END AS size FROM pages""",
}


def with_(*names: str, **more: str) -> str:
    """A WITH clause of the named views, then more."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ({n: VIEWS[n] for n in names} | more).items()) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    kinds = ("decision", "convention", "invariant", "failure_mode", "pattern", "summary", "trigger", "")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (i % 8 + 1).cast("int"))
    chapter = F.concat(F.lit('{"chapter":'), text(i % 10))
    metadata = (
        F.when(i % 4 == 1, F.concat(chapter, F.lit("}")))
        .when(i % 4 == 2, F.concat(F.lit('{"chapter":"text","surface":"project","project_path":"/work/src'), text(i % 20), F.lit('"}')))
        .when(i % 4 == 3, F.concat(chapter, F.lit(',"quality":"'), F.when(i % 3 == 0, "local:draft").otherwise("good"), F.lit('"}')))
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.concat(F.lit("ns"), text(i % 3)).alias("namespace"), (i % 4).alias("user_id"), F.col("text").alias("content"), F.col("source").alias("subject"), F.col("lang").alias("category"),
        kind.alias("kind"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("sub"), text(i % 5))).alias("subsystem"), metadata.alias("metadata"),
        F.when(i % 7 == 3, i + 1).when(i % 7 == 4, i + 2).alias("superseded_by"), F.when((i % 7).isin(3, 4), F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("superseded_at"),
        (i % 5).cast("int").alias("confirmed_count"), (i % 11).cast("int").alias("use_count"), F.timestamp_seconds(start.cast("long") + i * 3600).alias("created_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are hashes of the endpoints: numbering in order would put all rows into one task. Partitions are dealt by a count of rows, as a task holds its distinct pairs in memory."""
    pairs = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    return pairs.select(
        F.xxhash64("l_suppkey", "l_partkey").alias("id"), F.col("l_suppkey").alias("source_id"), (100000 + F.col("l_partkey")).alias("target_id"),
        F.when(F.col("l_partkey") % 3 == 0, "depends").otherwise("reference").alias("link_type"), (F.col("l_partkey") % 4 == 0).alias("bidirectional"),
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.lead("o_orderkey").over(w).alias("superseded_by"), F.col("o_orderdate").alias("created_at"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("ref_id"), F.lit("fact").alias("ref_type"), (F.col("doc_id") % 50).cast("string").alias("session_id"), (2 * F.col("quality") - 1).alias("score"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    folder = F.when(i % 9 == 0, "vendor/").when(i % 9 == 1, "docs/").when(i % 9 == 2, ".git/").otherwise("lib/")
    end = F.element_at(F.array(*map(F.lit, (".md", ".go", ".html", ".exe", "", ".PY", ".txt"))), (i % 7 + 1).cast("int"))
    path = F.concat(F.lit("src/"), folder, F.lit("page"), i.cast("string"), end)
    return table(spark, sf_dir, "pages").select(i.alias("id"), path.alias("path"), F.col("html").alias("content"), F.when(i % 13 == 0, F.lit(2000000).cast("long")).otherwise(F.length("html").cast("long")).alias("size"))
