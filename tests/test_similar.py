"""The threshold join by cosine: against plain loops, with a subject that holds nearly all rows, blocks made small, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import cosine
from tessera.operators import graph, similar

SCHEMA = "id long, subject string, embedding array<float>"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sides(df):
    a, b = (df.select(F.col("id").alias(i), "subject", F.col("embedding").alias(v)) for i, v in (("a", "v"), ("b", "w")))
    return a, b


def crossed(df, threshold):
    a, b = sides(df)
    rows = a.join(b, "subject").where("a <> b").withColumn("score", cosine(F.col("v"), F.col("w"))).where((F.col("score") >= threshold) & ~F.isnan("score"))
    return sorted(tuple(r) for r in rows.select("a", "b", "score").collect())


def clusters(seed, n, hot):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 6))
    vec = (middle[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 6))).astype("float32")
    vec[n // 2 : n // 2 + 40] = vec[0]  # copies
    return [(i, "hot" if i % hot else f"cold{i % 7}", v.tolist()) for i, v in enumerate(vec)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.95])
def test_pairs_and_scores_as_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(similar, "BLOCK", 50)
    df = made(spark, clusters(1, 700, 10))
    a, b = sides(df)
    got = sorted(tuple(r) for r in similar.near(a, b, "a", "b", threshold).select("a", "b", "score").collect())
    want = crossed(df, threshold)
    assert got == want and want  # the scores too, to the last bit


def test_links_with_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 50)
    df = made(spark, clusters(2, 500, 10)).withColumn("superseded_by", F.when(F.col("id") % 11 == 5, 1).cast("long"))
    want: dict[int, list] = {}
    for a, b, s in crossed(df.select("id", "subject", "embedding"), 0.6):
        if a % 3 == 1 and b % 11 != 5:
            want.setdefault(a, []).append((-s, b))
    expected = sorted((a, b, -s) for a, found in want.items() for s, b in sorted(found)[:3])
    got = sorted(tuple(r) for r in graph.auto_links(df.where("id % 3 = 1"), df).collect())
    assert got == expected and len(got) > 300


def test_no_block_holds_a_hot_subject(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 64)
    sizes = spark.sparkContext.accumulator(0)
    block = similar.best_of_block

    def seen(a, b, *rest):
        sizes.add(int(max(a.num_rows, b.num_rows) > 4 * 64))
        return block(a, b, *rest)

    monkeypatch.setattr(similar, "best_of_block", seen)
    df = made(spark, [(i, "one", [1.0, 0.0, 0.5]) for i in range(2000)])
    a, b = sides(df.where("id < 400"))[0], sides(df)[1]
    assert similar.near(a, b, "a", "b", 0.9).count() == 400 * 1999
    assert sizes.value == 0


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, "s", [1.0, 0.0]), (2, "s", [2.0, 0.0]), (2, "s", [2.0, 0.0]), (3, "s", None), (4, "s", []), (5, "s", [0.0, 0.0]), (6, "s", [nan, 1.0]), (7, "s", [inf, 1.0]),
        (8, "s", [1.0, None]), (9, "s", [1.0, 0.0, 0.0]), (10, None, [1.0, 0.0]), (None, "s", [1.0, 0.0]), (11, "t", [1.0, 0.0]), (12, "s", [0.0, -1.0]), (13, "s", [3.0, 0.0, 0.0]),
    ]
    a, b = sides(made(spark, rows))
    found = similar.near(a.withColumn("tag", F.lit("x")), b, "a", "b", 0.9)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(1, 2), (1, 2), (2, 1), (2, 1), (9, 13), (13, 9)]
    assert found.columns == ["a", "subject", "tag", "b", "score"]
    none = similar.near(a.limit(0), b, "a", "b", 0.9)
    assert none.count() == 0 and similar.near(a, b.limit(0), "a", "b", 0.9).count() == 0 and none.columns == ["a", "subject", "b", "score"]


def test_far_cells_are_skipped(spark):
    pivots = {2: np.array([[1.0, 0.0], [0.0, 1.0]])}
    df = made(spark, [(1, "s", [1.0, 0.1]), (2, "s", [0.1, 1.0])]).withColumn("__norm", F.sqrt(F.lit(1.01))).withColumn("__size", F.lit(2))
    assert {r["id"]: r["__cell"] for r in similar.placed(df, "embedding", pivots, False).collect()} == {1: 0, 2: 1}
