"""Operators 11 to 13 and their components, against plain versions and on odd inputs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import clustering, minhash, negatives
from tessera.llm.components import star_components

from . import brute

VECTORS = "vec_id long, embedding array<double>, label int, x string"


def vectors(n, width=64, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    return [(i, (centers[i % 6] * spread + rng.normal(size=width) * 0.3).tolist(), int(rng.integers(0, 4)), "") for i in range(n)]


def odd(width=64):
    """Rows that take no part."""
    short = [0.5] * (width - 1)
    return [(900, None, 1, ""), (901, [None, *short], 1, ""), (902, [float("nan"), *short], 1, ""), (903, [float("inf"), *short], 1, ""), (904, [-float("inf"), *short], 1, "")]


def plain_clusters(rows, k=8, rounds=10):
    x = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)
    key = [hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() for r in rows]
    c = x[sorted(range(len(rows)), key=lambda i: (key[i], x[i].tolist()))[:k]].copy()
    for last in [False] * rounds + [True]:
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        for j in range(0 if last else len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(0) // (a == j).sum()
    d = d.min(1)
    sums = [int(d[a == j].sum()) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted((r[0], int(j), int(e), sums[j], int(d.sum()), sha[j]) for r, j, e in zip(rows, a, d, strict=True))


def clusters(spark, rows):
    return sorted(map(tuple, clustering.cluster_vectors(spark.createDataFrame(rows, VECTORS)).collect()))


@pytest.mark.parametrize("n, copies", [(240, 0), (120, 90), (5, 0), (40, 39)])
def test_clusters_as_plain_rounds(spark, n, copies):
    rows = vectors(n)
    rows += [(1000 + i, rows[0][1], 0, "") for i in range(copies)]  # ties: one vector very often
    assert clusters(spark, rows + odd() + [(905, [0.5] * 63, 1, ""), (906, [], 1, "")]) == plain_clusters(rows)


def test_clusters_of_nothing_of_repeats_and_of_too_large_components(spark):
    assert clusters(spark, odd()) == []
    rows = vectors(30) * 2
    assert clusters(spark, rows) == plain_clusters(rows)
    with pytest.raises(Exception, match="beyond"):
        clusters(spark, [(1, [1e9] * 64, 0, "")])


def test_bounds_only_skip_what_is_farther():
    """Rounds by reassigned() with carried bounds, against all distances; on a grid, where ties are many."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (500, 4)).astype(np.int64)
    centers, moved = x[:8].copy(), None
    cluster, upper, lower = np.zeros(500, np.int32), np.full(500, np.inf), np.zeros((500, 8))
    for _ in range(12):
        if moved is not None:
            upper, lower = np.nextafter(upper + moved[cluster], np.inf), np.maximum(np.nextafter(lower - moved, -np.inf), 0)
        cluster, upper, lower = clustering.reassigned(x, cluster, upper, lower, centers)
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(d) + 1e-9).all()
        after = centers + rng.integers(-1, 2, centers.shape)
        moved, centers = clustering.outward(((after - centers) ** 2).sum(1))[1], after


def plain_negatives(rows, anchors, scale=256):
    width = max((len(r[1]) for r in rows), default=0)
    x = [np.floor(np.array(r[1] + [0.0] * (width - len(r[1]))) * scale).astype(np.int64) for r in rows]
    out = []
    for i, a in enumerate(rows):
        if a[0] % anchors == 0:
            s = sorted((-int(x[i] @ x[j]), b[0], b[2]) for j, b in enumerate(rows) if b[0] != a[0])
            for p, pid, _ in [t for t in s if t[2] == a[2]][:5]:
                inside = [t for t in s if t[2] != a[2] and 30 * -p <= 100 * -t[0] <= 90 * -p][:10]
                out += [(a[0], pid, k + 1, t[1], -p, -t[0]) for k, t in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, anchors):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % anchors == 0).collect()))


@pytest.mark.parametrize("spread, copies, anchors", [(1.0, 0, 10), (0.0, 0, 10), (1.0, 60, 10), (1.0, 0, 1000)])
def test_negatives_as_plain_search(spark, spread, copies, anchors):
    rows = vectors(300, width=24, seed=3, spread=spread)
    rows += [(1001 + 3 * i, rows[7][1], i % 4, "") for i in range(copies)]  # ties of score
    got = mined(spark, rows + odd(24) + [(1, rows[0][1], None, ""), (None, rows[0][1], 1, "")], anchors)
    assert got == plain_negatives(rows, anchors) and got


def test_negatives_of_short_vectors_repeats_and_blocks(spark, monkeypatch):
    assert mined(spark, odd(), 1) == []
    rows = [(i, [random.Random(i).gauss(0, 1) for _ in range(1 + i % 5)], i % 2, "") for i in range(60)]
    want = plain_negatives(rows, 4)
    assert mined(spark, rows, 4) == want
    for name, value in (("ANCHORS", 4), ("ROWS", 16), ("SIDE", 8), ("ANCHOR_SIDE", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, 4) == want
    assert mined(spark, rows + rows[:1], 4) == plain_negatives(rows + rows[:1], 4)
    assert mined(spark, [(3, [1.0], 0, "")], 4) == []


def test_bounds_of_scores_hold_and_prune(spark):
    rows = vectors(400, width=16, seed=5)
    df = spark.createDataFrame(rows, VECTORS).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), negatives.scaled(F.col("embedding"), 256).alias("x"))
    cuts, least, most = negatives.cells(df)
    t = negatives.approximated(df, cuts).toArrow().combine_chunks()
    _, _, codes, x = negatives.unpacked(t.to_batches(), 16)
    below, above = negatives.bounds(codes, *negatives.look_ups(x[:40], least, most))
    exact = x @ x[:40].T
    assert (below <= exact).all() and (exact <= above).all()
    assert (above - below).mean() < exact.std() / 4


def near(spark, rows, shingle=3, level=85):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node long, n int"), shingle=shingle, level=level).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)


def texts(n, seed=0, words=60, change=2, base=8):
    rng, out = random.Random(seed), []
    lines = [[f"w{rng.randrange(400)}" for _ in range(words)] for _ in range(base)]
    for i in range(n):
        t = list(lines[i % base])
        for _ in range(rng.randrange(change + 1)):
            t[rng.randrange(words)] = f"w{rng.randrange(400)}"
        out.append((i, " ".join(t), 0, 0))
    return out


@pytest.mark.parametrize("n, base, change, shingle, level", [(200, 12, 3, 3, 85), (300, 1, 5, 3, 85), (160, 20, 4, 5, 80), (120, 1, 25, 3, 85)])
def test_near_duplicates_as_all_pairs(spark, monkeypatch, n, base, change, shingle, level):
    rows = texts(n, base=base, change=change)
    monkeypatch.setattr(minhash, "SMALL", 8)  # large buckets, in several blocks
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELL", 16)
    want = brute.near_duplicates([(d, t) for d, t, *_ in rows], shingle, level)
    assert near(spark, rows, shingle, level) == sorted(((d, k, c, d == c) for d, k, c in want.values()), key=str)


def test_visitors_of_a_cell_as_all_pairs():
    rows = texts(60, base=1, change=9)
    sets = minhash.shingle_sets([t for _, t, *_ in rows], 3)
    t = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "visits": [i >= 30 for i in range(60)]})
    got = minhash.in_group(3, 85)(t)

    def link(i, j):
        x = len(np.intersect1d(sets[i], sets[j]))
        return 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x)

    pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert [a for a, _ in pairs] == [i for i in range(30, 60) if any(link(i, j) for j in range(30))] and 0 < len(pairs) < 30
    assert all(link(a, b) for a, b in pairs)


def test_near_duplicates_of_odd_rows(spark):
    assert near(spark, []) == []
    a, b = "a b c d e f", "q r s t u v"
    rows = [(5, a, 0, 0), (3, a.upper(), 0, 0), (9, b, 0, 0), (9, a, 0, 0), (2, b, 0, 0), (7, None, 0, 0), (8, " \n", 0, 0), (None, a, 0, 0), (11, "x", 0, 0), (10, "X", 0, 0), (5, a, 0, 0), (12, "w " * 50_000, 0, 0), (13, "w w w", 0, 0)]
    assert near(spark, rows) == sorted([(5, 4, 2, False), (5, 4, 2, False), (3, 4, 2, False), (9, 4, 2, False), (9, 4, 2, False), (2, 4, 2, True), (7, 0, 7, True), (8, 0, 8, True), (None, 4, None, True), (11, 1, 10, False), (10, 1, 10, True), (12, 1, 12, True), (13, 1, 12, False)], key=str)


def test_stars_as_union_find(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(150)] + [(400, 300 + i) for i in range(90)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    links += [(7, 7), (None, 3), (5, None)] + links[:9]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = star_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)
    assert star_components(spark.createDataFrame([], "a long, b long")).collect() == []
