"""Nearest vectors by cells equal the plain scan, score for score: clusters, ties, odd vectors, few rows."""

import random

from tessera.operators import search, similar


def vectors(spark, n, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(n)]
    rows += [(n + i, rows[i % min(n, 40)][1]) for i in range(200)]  # equal ones: ties by id
    rows += [(-1, None), (-2, []), (-3, [0.0] * 8), (-4, [float("nan")] + [1.0] * 7), (-6, [None] + [1.0] * 7)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def test_equal_to_the_scan(spark):
    docs = vectors(spark, 6000, 1)
    sound = docs.where("id >= 0")
    queries = sound.where("id % 500 = 3").selectExpr("id as query_id", "embedding as vector").unionByName(spark.createDataFrame([(-9, None), (-8, [1.0] + [0.0] * 7)], "query_id long, vector array<double>"))
    for k in (1, 7):
        want = {tuple(r) for r in search.nearest(sound, queries, k).collect()}
        got = [tuple(r) for r in similar.nearest(docs, queries, k).collect()]
        assert len(got) == len(want) and set(got) == want


def test_vectors_without_a_cosine_give_no_bound(spark):
    bad = spark.range(4000).selectExpr("-id - 10 as id", "array(double('nan'), 1D) as embedding")
    docs = bad.unionByName(spark.createDataFrame([(i, [1.0, i / 50]) for i in range(50)], "id long, embedding array<double>"))
    got = similar.nearest(docs, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), 3).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2]


def test_fewer_rows_than_asked_for(spark):
    docs, queries = vectors(spark, 5, 2).where("id >= 0 and id < 5"), spark.createDataFrame([(1, [1.0] * 8)], "query_id long, vector array<double>")
    assert {tuple(r) for r in similar.nearest(docs, queries, 9).collect()} == {tuple(r) for r in search.nearest(docs, queries, 9).collect()}
    assert similar.nearest(docs.limit(0), queries, 9).count() == 0 and similar.nearest(docs, queries.limit(0), 9).count() == 0
