"""Operators that compare documents, and the pipeline: 4, 6, 9."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, ppm, suffix
from tessera.llm.components import components

from . import brute

CLASH = ("bucket", "tie", "part", "node", "component", "token", "n", "held_out", "set_id")


def word(k=400):
    return f"w{random.randrange(k)}"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})


def test_repeats(spark):
    random.seed(5)
    w = lambda: "".join(random.choices("abcdeé", k=random.randint(1, 7)))
    text = lambda n: " ".join(w() for _ in range(n))
    base, rows = [text(80) for _ in range(5)], []
    for i in range(100):
        k = random.random()
        if k < 0.2:
            t = random.choice(base)
        elif k < 0.5:
            b = random.choice(base).split()
            for _ in range(random.randint(1, 3)):
                b[random.randrange(len(b))] = w()
            t = " ".join(b)
        elif k < 0.7:
            t = text(random.randint(5, 40)) + random.choice(base)[random.randint(0, 100) : random.randint(150, 400)] + text(20)
        elif k < 0.8:
            t = "ab" * random.randint(1, 300)
        else:
            t = random.choice([None, "", "x" * random.randint(0, 250), text(random.randint(1, 120))])
        rows.append((i, t))
    rows.append((None, base[0]))
    want = brute.repeats(rows)
    for n in (None, 3):
        got = {r["doc_id"]: tuple(r) for r in suffix.remove_repeats(frame(spark, rows), texts=False, partitions=n).collect()}
        assert got == want
    kept = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] for r in kept.values())
    assert suffix.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeats_in_equal_rows_and_long_texts(spark, monkeypatch):
    t = " ".join(str(i) for i in range(60))
    got = sorted(r["n_removed"] for r in suffix.remove_repeats(frame(spark, [(1, t), (1, t), (1, None)]), texts=False).collect())
    assert got == [0, 0, len(t)]
    long = [(1, " ".join(str(i % 9000) for i in range(14_000))), (2, "z" + t)]
    want = brute.repeats(long)
    monkeypatch.setattr(suffix, "SEGMENT", 1 << 20)
    assert {r["doc_id"]: tuple(r) for r in suffix.remove_repeats(frame(spark, long), texts=False).collect()} == want


def test_loser_tree_never_recompares(monkeypatch):
    random.seed(7)
    runs = [sorted("".join(random.choices("ab", k=random.randint(1, 12))).encode() for _ in range(random.randint(0, 40))) for _ in range(7)]
    asked = []
    plain = suffix.shared_prefix
    monkeypatch.setattr(suffix, "shared_prefix", lambda a, b, known: asked.append(a[:known] == b[:known]) or plain(a, b, known))
    coded = [suffix.front_decode(*suffix.front_code(r)) for r in runs]
    got = list(suffix.merge_runs(coded))
    assert [k for k, _, _ in got] == sorted(k for r in runs for k in r) and all(asked)
    for (a, _, _), (b, shared, _) in zip(got, got[1:], strict=False):
        assert shared == plain(a, b, 0)


@pytest.mark.parametrize("light", [None, 0, 9, 29])
def test_near_duplicates(spark, monkeypatch, light):
    random.seed(3)
    bases, rows = [[word() for _ in range(n)] for n in (3, 5, 8, 11, 12, 14, 20, 21, 22, 30, 31, 33, 60, 150) for _ in range(2)], []
    for i in range(500):
        k, b = random.random(), list(random.choice(bases))
        if 0.2 < k < 0.75:
            for _ in range(random.choice([1, 1, 1, 2, 3, 4])):
                o = random.random()
                if o < 0.4:
                    b[random.randrange(len(b))] = word()
                elif o < 0.8:
                    b.insert(random.choice([0, len(b)]), word())
                else:
                    b = b[1:] or b
        elif k > 0.9:
            b = [word(30) for _ in range(random.randint(0, 15))]
        rows.append((i, None if 0.75 < k < 0.77 else " ".join(b).upper() if k < 0.3 else "\t".join(b)))
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    got = {r["doc_id"]: tuple(r) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


@pytest.mark.parametrize("big", [False, True])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, big):
    """Groups beyond a block, whose members link only through some of them."""
    random.seed(8)
    base, rows = [word(10_000) for _ in range(60)], []
    for i in range(120):
        b = list(base)
        for k in range(i % 4):
            b[-1 - k] = word(10_000)
        rows.append((i, " ".join(b)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LONG", 100 if big else 4)
    got = {r["doc_id"]: tuple(r) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_odd(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "A  B\nc d"), (5, "z" * 100_000)]
    got = sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 1), (5, 1, 5)], key=str)
    assert jaccard.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    a, b = ("%s " * 40 % tuple(f"{c}{i}" for i in range(40)) for c in "ab")
    twice = [(5, a), (5, b), (7, a), (9, b + "x"), (8, "c d e f")]
    got = sorted(map(tuple, jaccard.near_duplicates(frame(spark, twice)).select("doc_id", "component_id").collect()))
    assert got == [(5, 5), (5, 5), (7, 5), (8, 8), (9, 5)]


def test_boundary_follows_costs():
    import numpy as np

    assert jaccard.boundary(np.zeros(8), {5: 10, 15: 10, 25: 10}) < 15 <= jaccard.boundary(np.full(8, 2000.0), {5: 10, 15: 10}) <= 29


def test_components(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(40)] + [(random.randrange(100, 200), random.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e}


def test_ppm(spark):
    random.seed(11)
    rows = [(i, " ".join(random.choice(["the", "of", "There", "théâtre", word(50)]) for _ in range(random.randint(0, 30)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "ÀÉ zzz\x00 q"), (1003, "x" * 5000)]
    want = brute.ppm(rows)
    got = {r["doc_id"]: tuple(r) for r in ppm.score(frame(spark, rows), langid.remainder("doc_id", 5) == 1).collect()}
    assert got.keys() == want.keys() and any(r[1] for r in want.values())
    for d, r in want.items():
        assert got[d][:5] == r[:5]
        assert got[d][5:] == pytest.approx(r[5:], rel=1e-9, abs=1e-9)


def test_ppm_odd(spark):
    rows = [(None, "null id"), (1, "a"), (1, "a")]
    assert len(ppm.score(frame(spark, rows), langid.remainder("doc_id", 5) == 1).collect()) == 3
    none = ppm.score(frame(spark, [(1, "ab")]), F.lit(True)).first()
    assert none["train_tokens"] == 0 and none["score"] == pytest.approx(-3 * 2.408239965)
    assert ppm.score(frame(spark, rows).limit(0), F.lit(False)).count() == 0
