"""Searches over kept postings against searches over texts, and limits that differ by row."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import recall, search, tools
from tessera.sources import postings
from tessera.sources.postings import Postings

FACTS = "id long, namespace string, user_id long, content string, subject string, category string, kind string, subsystem string, metadata string, superseded_by long, confirmed_count int, use_count int, created_at timestamp, extra string"


def facts(spark, n, seed=0, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(first, first + n):
        text = " ".join(["common", *(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randrange(1, 30)))])
        rows.append((i, "ns", 0, None if i % 17 == 5 else text + (" file.go" if i % 9 == 0 else ""), f"s{i % 3}", "note", "decision" if i % 4 else "", "", None, None, i % 5, 0, None, "x"))
    return spark.createDataFrame(rows, FACTS).withColumn("created_at", F.lit("2024-06-01").cast("timestamp"))


QUERIES = [(1, "w0"), (2, "w1 w2"), (3, "common"), (4, "common w0 w3"), (5, "file.go w1"), (6, "absent w1"), (7, ""), (8, "w5 w5"), (9, "w30"), (10, None), (11, "s1 w0")]


def scores(df):
    return {(r["query_id"], r["id"]): round(r["score"], 9) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(postings, "SLICE", 40)


def test_kept_top_as_scan(spark, tmp_path, small_blocks):
    docs, queries = facts(spark, 300), spark.createDataFrame(QUERIES, "query_id long, text string")
    kept = Postings(spark, str(tmp_path))
    kept.build(docs)
    for fetch in (1, 400):
        assert scores(kept.bm25(queries, fetch)) == scores(search.bm25(docs, queries, fetch=fetch))
    within = docs.where("id % 2 = 0")
    assert scores(kept.bm25(queries, 5, within=within)) == scores(search.bm25(within, queries, population=docs, fetch=5))


def test_updates_are_segments_and_read_as_a_build(spark, tmp_path, small_blocks):
    old, queries = facts(spark, 200), spark.createDataFrame(QUERIES, "query_id long, text string")
    kept = Postings(spark, str(tmp_path))
    kept.build(old)
    changed = facts(spark, 30, seed=9, first=50).unionByName(facts(spark, 20, seed=8, first=500))
    kept.update(changed, spark.createDataFrame([(3,), (77,), (9999,)], "id long"))
    version = kept.update(facts(spark, 10, seed=7, first=60), None)
    now = old.where("(id < 50 or id >= 80) and id <> 3").unionByName(changed.where("(id < 60 or id >= 70) and id <> 77")).unionByName(facts(spark, 10, seed=7, first=60))
    # 77 was in both changed and gone: what changed stands.
    now = now.unionByName(changed.where("id = 77"))
    words = spark.createDataFrame([("w1",), ("common",), ("nothing",)], "word string")
    for _ in range(2):
        assert scores(kept.bm25(queries, 7)) == scores(search.bm25(now, queries, fetch=7))
        assert sorted(map(tuple, kept.term_doc_counts(words).collect())) == sorted(map(tuple, search.term_doc_counts(now, words).collect()))
        kept.compact()
    assert len(kept._segments()) == 1 and len(kept._segments(version)) == 3
    # The segment of an update holds the changed documents and no others.
    kept.update(now.where("id = 7"))
    assert kept.tables.read(f"documents_{kept._segments()[-1]}").count() == 1
    assert scores(kept.bm25(queries, 7)) == scores(search.bm25(now, queries, fetch=7))


def test_empty_index_and_nulls(spark, tmp_path):
    kept, queries = Postings(spark, str(tmp_path)), spark.createDataFrame(QUERIES, "query_id long, text string")
    kept.build(facts(spark, 3).limit(0))
    assert scores(kept.bm25(queries, 5)) == {}
    kept.update(facts(spark, 2).withColumn("content", F.lit(None).cast("string")))
    assert scores(kept.bm25(queries, 5)) == scores(search.bm25(facts(spark, 2).withColumn("content", F.lit(None).cast("string")), queries, fetch=5))
    assert scores(kept.bm25(queries.limit(0), 5)) == {}


def test_blocks_under_the_threshold_are_left(spark, tmp_path, small_blocks, monkeypatch):
    docs = facts(spark, 600, seed=2)
    kept, read = Postings(spark, str(tmp_path)), []
    kept.build(docs)
    inner = Postings._scored

    def counting(self, blocks, upper, lead, *rest):
        read.append((lead.count(), blocks.count()))
        return inner(self, blocks, upper, lead, *rest)

    monkeypatch.setattr(Postings, "_scored", counting)
    one = spark.createDataFrame([(1, "common")], "query_id long, text string")
    assert scores(kept.bm25(one, 3)) == scores(search.bm25(docs, one, fetch=3))
    assert sum(n for n, _ in read) < read[0][1] / 2


def test_searches_and_recall_take_kept_postings(spark, tmp_path):
    docs = facts(spark, 250, seed=4).withColumn("superseded_by", F.when(F.col("id") % 10 == 0, F.lit(1)).cast("long"))
    live = docs.where("superseded_by is null")
    kept = Postings(spark, str(tmp_path))
    kept.build(live)
    queries = spark.createDataFrame([(1, "w0 w1"), (2, "common w2")], "query_id long, text string")

    def rows(df):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy("query_id", "rank").collect()]

    assert rows(search.search(live, queries, lexical_only=True, kept=kept)) == rows(search.search(live, queries, lexical_only=True)) != []
    mine, theirs = (tools.tool_search(live, queries, 5, kept=k)[0] for k in (kept, None))
    assert rows(mine) == rows(theirs)
    requests = spark.createDataFrame([(1, "where is w7 and w12, w9", 3), (2, "common w20 w8", 20), (3, "w3 w3 w11", None)], "request_id long, prompt string, result_limit int").withColumn("query_id", F.col("request_id"))
    for o in (recall.RecallOptions(), recall.RecallOptions(idf_floor=-9.0, idf_fraction=0.0, min_score=0.0)):
        got, want = (recall.recall(docs, requests, o=o, kept=k).withColumnRenamed("request_id", "query_id") for k in (kept, None))
        assert rows(got) == rows(want)


def test_limits_by_row_are_cut_before_the_shuffle(spark):
    """A word that every row has: each task sends on no more than the bound."""
    rows = spark.range(20_000, numPartitions=8).select(F.when(F.col("id") >= 0, "all").alias("word"), "id", (F.col("id") % 97).cast("double").alias("score"), F.lit(7).alias("k"))
    got = search.first_of(rows, ("word",), [F.desc("score"), F.col("id")], F.col("k"), 80)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["place"]) for r in got.orderBy("place").collect()] == [(96 + 97 * i, i + 1) for i in range(7)]
