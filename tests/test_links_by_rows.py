"""Tables of links are dealt by their number of rows, and ends are looked up one after the other."""

from tessera.operators import graph, lifecycle
from tessera.plans import fixtures as fx
from tessera.sources import tables

SF = "/root/testdata/sf0.001"


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    links = fx.links(spark, SF)
    assert links.rdd.getNumPartitions() == -(-n // 500)
    assert links.count() == links.select("source_id", "target_id").distinct().count() > 0


def test_neighbourhood_by_joins_too(spark, monkeypatch):
    rows = [(1, 2, False), (1, 2, False), (2, 3, True), (3, 4, False), (None, 1, True), (4, 1, False), (5, 3, True)]
    links = spark.createDataFrame(rows, "source_id long, target_id long, bidirectional boolean")
    seeds = spark.createDataFrame([(1,), (1,)], "id long")
    want = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert sorted(map(tuple, graph.neighbourhood(links, seeds, 3).collect())) == want
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.neighbourhood(links, seeds, 3).collect())) == want
    assert sorted(map(tuple, graph.neighbourhood(links.limit(0), seeds, 2).collect())) == [(1, 0)]


def test_owned_links_without_a_row_for_each_end(spark):
    facts = spark.createDataFrame([(1, "ns", 1), (2, "ns", 1), (2, "ns", 2), (3, "ns", 2), (4, "other", 1), (5, "ns", None), (6, "ns", None), (5, "ns", 3), (6, "ns", 3)], "id long, namespace string, user_id int")
    pairs = [(1, 2), (2, 3), (1, 3), (1, 4), (1, 1), (9, 9), (2, 2), (None, 1), (5, 6), (5, 1)]
    new = spark.createDataFrame([(k, *p, "x") for k, p in enumerate(pairs)], "id long, source_id long, target_id long, label string")
    out = lifecycle.owned_links(new, facts, "ns")
    got = {r["id"]: (r["user_id"], r["error"]) for r in out.collect()}
    no = (None, "fact not found")
    assert got == {0: (1, None), 1: (2, None), 2: no, 3: no, 4: (1, None), 5: no, 6: (1, None), 7: no, 8: (3, None), 9: no}
    assert "Generate" not in out._jdf.queryExecution().toString()
