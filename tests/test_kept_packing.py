"""How much a build of kept postings exchanges: packed rows of many blocks, however many slices there are, and few bytes for each entry."""

import random

from pyspark.sql import functions as F

from tessera.sources import postings
from tessera.sources.postings import Postings
from tests.test_kept_searches import facts


def stages(spark) -> list:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_exchanged_rows_do_not_grow_with_slices(spark, tmp_path, monkeypatch):
    docs, rows = facts(spark, 2000).coalesce(2), []
    for size in (2000, 50):
        monkeypatch.setattr(postings, "SLICE", size)
        before = sum(s.shuffleWriteRecords() for s in stages(spark))
        kept = Postings(spark, str(tmp_path / str(size)))
        kept.build(docs)
        rows.append(sum(s.shuffleWriteRecords() for s in stages(spark)) - before)
    assert kept._read("postings").select("slice").distinct().count() > 10
    assert rows[1] < rows[0] * 1.2


def test_an_entry_of_a_rare_term_is_few_bytes(spark, tmp_path):
    """Most blocks have one entry. A row of the shuffle for each took 26 bytes with its counts, compressed; rows of many blocks take 18."""
    rng = random.Random(1)
    texts = [(i, " ".join(f"t{rng.randrange(200_000)}" for _ in range(100))) for i in range(1000)]
    docs = spark.createDataFrame(texts, "id long, content string").withColumns({"subject": F.lit(""), "category": F.lit("")}).coalesce(2)
    before = sum(s.shuffleWriteBytes() for s in stages(spark))
    Postings(spark, str(tmp_path)).build(docs)
    assert sum(s.shuffleWriteBytes() for s in stages(spark)) - before < 100_000 * 22


def test_a_search_moves_no_places(spark, tmp_path):
    """Scores need how often a term stands in a document, not where."""
    docs = spark.range(300).select("id", F.expr("repeat('common other ', 1000)").alias("content"), F.lit("").alias("subject"), F.lit("").alias("category"))
    kept, limits = Postings(spark, str(tmp_path)), ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    kept.build(docs)
    before = sum(s.shuffleWriteBytes() for s in stages(spark))
    for name in limits:
        spark.conf.set(name, "-1")
    try:
        assert kept.bm25(spark.createDataFrame([(1, "common")], "query_id long, text string"), 5).count() == 5
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert sum(s.shuffleWriteBytes() for s in stages(spark)) - before < 300 * 1000
