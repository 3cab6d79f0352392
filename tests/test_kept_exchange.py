"""What a build of kept postings exchanges, and entries of rows that repeat an id."""

from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources import postings
from tessera.sources.postings import Postings
from tests.test_kept_searches import facts, scores


def exchanged(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_exchanges_blocks_once_and_no_places(spark, tmp_path):
    """Documents are analysed and packed where they lie: what moves are a task's blocks, not each document's terms, which were exchanged four times."""
    docs = facts(spark, 2000).coalesce(2)
    pairs = docs.select("id", F.explode(F.array_distinct(postings.terms(F.concat_ws(" ", "content", "subject", "category")))).alias("term")).count()
    before = exchanged(spark)
    Postings(spark, str(tmp_path)).build(docs)
    assert exchanged(spark) - before < pairs / 4


def test_rows_that_repeat_an_id_are_one_entry(spark, tmp_path):
    rows = [(1, "a b a"), (1, "c a"), (2, "b"), (None, "a"), (None, "a a"), (3, None)]
    docs = spark.createDataFrame(rows, "id long, content string").withColumns({"subject": F.lit(""), "category": F.lit("")})
    kept, words = Postings(spark, str(tmp_path)), spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    kept.build(docs)

    def places():
        found = kept.places(words.select(F.col("word").alias("term")))
        return sorted((r["term"], r["id"] or 0, r["len"], r["pos"]) for r in found.collect() if r["term"])

    once = [("a", 0, 1, 0), ("a", 0, 1, 0), ("a", 0, 1, 1), ("a", 1, 2, 0), ("a", 1, 2, 1), ("a", 1, 2, 2), ("b", 1, 3, 1), ("b", 2, 1, 0), ("c", 1, 2, 0)]
    counts = lambda: sorted(map(tuple, kept.term_doc_counts(words).collect()))
    assert places() == once
    assert counts() == [("a", 2, 6), ("b", 2, 6), ("c", 1, 6)]
    kept.update(docs.where("id = 2"), spark.createDataFrame([(1,)], "id long"))  # both rows of 1 go
    assert places() == [x for x in once if x[1] != 1]
    assert counts() == [("a", 1, 4), ("b", 1, 4), ("c", 0, 4)]


def test_many_slices_and_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE", 30)
    monkeypatch.setattr(postings, "PLACES", 200)
    docs, kept = facts(spark, 300, seed=3), Postings(spark, str(tmp_path))
    kept.build(docs)
    queries = spark.createDataFrame([(1, "common"), (2, "w1 w2"), (3, "file.go w1")], "query_id long, text string")
    for _ in range(2):
        blocks = kept._read("postings")
        assert blocks.count() == blocks.select("term", "tier", "slice").distinct().count()
        assert scores(kept.bm25(queries, 9)) == scores(search.bm25(docs, queries, fetch=9))
        kept.compact()
