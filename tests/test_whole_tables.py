"""Queries over whole tables: no document too long for them, no id beyond them."""

import duckdb
import pytest

from tessera.plans.registry import cases

from .test_queries import plain

#: Large enough for users beyond the ids of the queries over a few.
SF = "/root/testdata/sf0.01"

LONG = "word " * 4000


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    rows = [(1, "one short text", "en", "s", 14), (2, LONG, "en", "s", 20000), (3, None, "de", "t", None), (4, "", "de", "t", 0), (5, "zebra " + LONG, "fr", "t", 20006)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["active_count", "term_counts", "bm25_all", "status_counts", "export_rows", "list_by_ids", "insert_checks_length", "store_batch_statuses"])
def test_long_and_null_texts_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet/*.parquet'")
    query, sql = cases()[name]
    assert plain(query(spark, small).toPandas()) == plain(con.execute(sql).df())


def test_no_document_is_left_out(spark, small):
    run = lambda name: cases()[name][0](spark, small).collect()
    assert {r["id"] for r in run("export_rows")} == {1, 2, 3, 4, 5}
    assert {(r["term"], r["n"]) for r in run("term_counts")} >= {("word", 8000), ("zebra", 1)}
    assert {r["id"] for r in run("insert_checks_length")} == {1, 2, 3, 4, 5, 10**9 + 1, 10**9 + 4}


def test_every_row_counts(spark):
    """Sums over what the queries return are those of their tables."""
    run = lambda name: cases()[name][0](spark, SF).collect()
    n = lambda table: spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert sum(r["n"] for r in run("hook_payloads")) == n("events")
    assert len(run("store_batch_statuses")) == n("documents")
    tasks = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()
    assert len({r["task_id"] for r in run("agent_suggestions")}) > 0.9 * len(tasks)
    assert {r["user_id"] for r in run("recent_files")} == {r["user_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
