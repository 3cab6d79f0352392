"""Columns whose names clash with what operators add, null rows, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import context, graph, search, sessions

CLASH = ("term", "pos", "len", "score", "rank", "tf", "phrase", "wanted", "start", "place", "k", "up", "far", "root", "turns", "to", "at", "low", "query_id", "terms", "text_")


def clashing(df, keep):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in keep and c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the store of go", "s", "note", [1.0, 0.0]), (2, "go go", None, None, [0.0, 1.0]), (3, None, None, None, None), (4, "", "go", "x", [1.0, 1.0]), (5, "the the store", "s", "note", [-1.0, 0.0])]
    return spark.createDataFrame(rows, "id long, content string, subject string, category string, embedding array<double>").withColumns({"confirmed_count": F.lit(0), "created_at": F.lit("2024-01-01").cast("timestamp")})


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "go", [1.0, 0.0]), (2, "the store", None), (3, None, [0.0, 1.0]), (4, "", None)], "query_id int, text string, vector array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_search(docs, queries):
    plain, odd = docs, clashing(docs, ())
    assert rows(search.bm25(odd, queries)) == rows(search.bm25(plain, queries))
    assert {(r["query_id"], r["id"]) for r in search.bm25(odd, queries).collect()} == {(1, 1), (1, 2), (1, 4), (2, 1), (2, 5)}
    assert {(r["query_id"], r["id"]) for r in search.nearest(odd.drop("query_id"), queries).collect()} == {(1, 1), (1, 4), (3, 2), (3, 4)}
    assert search.search(docs.limit(0), queries).collect() == [] and search.bm25(docs, queries.limit(0)).collect() == []
    found = search.search(odd, queries)
    assert {r["query_id"] for r in found.collect()} == {1, 2, 3}


def test_queries_in_blocks(docs, queries, monkeypatch):
    whole = rows(search.nearest(docs, queries))
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 1)
    assert rows(search.nearest(docs, queries)) == whole


def test_graph(spark):
    links = spark.createDataFrame([(1, 10, 20, True), (2, 10, 20, False), (3, None, 20, True), (4, 30, 30, False)], "id long, source_id long, target_id long, bidirectional boolean")
    odd = clashing(links, ())
    ids = spark.createDataFrame([(10,), (10,), (30,), (None,)], "fact_id long")
    assert sorted(r["id"] for r in graph.links_of(odd, ids).collect()) == [1, 2, 4]
    assert rows(graph.neighbourhood(odd, spark.createDataFrame([(10,)], "id long"), 3)) == [(10, 0), (20, 1)]
    chain = clashing(spark.createDataFrame([(1, 2), (2, None), (3, 9)], "id long, superseded_by long"), ())
    assert rows(graph.chain_positions(chain)) == [(1, 1, 0), (2, 1, 1), (3, 3, 0)]
    assert rows(graph.history(chain, spark.createDataFrame([(2,)], "id long"))) == [(2, 1, 0, 2), (2, 2, 1, 2)]


def test_sessions_and_context(spark):
    turns = spark.createDataFrame([("a", 1, "user", "hi"), ("a", 1, "user", "ho"), ("a", 2, "assistant", None), ("b", 1, "user", None)], "session_id string, turn_index int, role string, content string")
    odd = clashing(turns, ())
    assert rows(sessions.search_query(odd)) == rows(sessions.search_query(turns))
    assert {r["session_id"]: r["snippet"] for r in sessions.snippet(odd).collect()}["a"] == "[user]: hi\n[user]: ho"
    assert sessions.snippet(turns.limit(0)).collect() == []
    ranked = spark.createDataFrame([(t, k, 10 * t + k) for t in (1, 2) for k in (1, 2, 3)], "task int, rank int, id int")
    chosen = spark.createDataFrame([(1, [13, 99, 11, 13]), (2, [22])], "task int, ids array<int>")
    assert rows(context.curate(ranked, 5, chosen, ("task",))) == [(1, 11, 2), (1, 13, 1), (2, 22, 1)]
    states = spark.createDataFrame([(1, "done"), (2, "completed"), (3, None)], "id long, status string")
    assert rows(context.unknown_states(states)) == [(1, "done"), (3, None)]
