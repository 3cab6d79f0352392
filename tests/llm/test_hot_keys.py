"""Ids with several texts, hubs with very many links, and texts that repeat themselves."""

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import components as components_module
from tessera.llm import decontaminate, jaccard
from tessera.llm.components import components


def joined(pairs):
    """The smallest node that each reaches, plainly."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in parent}


def test_an_id_ties_all_its_texts(spark):
    a, b = ("%s " * 40 % tuple(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, b), (9, a), (8, "c d e f")]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 3)]


def test_repeated_ids_as_brute_force(spark):
    random.seed(21)
    bases = [[f"w{random.randrange(400)}" for _ in range(n)] for n in (3, 6, 12, 25, 40) for _ in range(4)]
    rows = []
    for _ in range(160):
        b = list(random.choice(bases))
        if random.random() < 0.6:
            b[random.randrange(len(b))] = f"w{random.randrange(400)}"
        rows.append((random.choice([None, *range(90)]) if random.random() < 0.95 else None, " ".join(b) if random.random() < 0.95 else random.choice([None, ""])))

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    named = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(d, d) for d, _ in named] + [(d, e) for d, s in named for e, t in named if s and t and 100 * len(s & t) >= 90 * len(s | t)]
    least = joined(links)
    want = sorted(((d, len(shingles(t)), least.get(d)) for d, t in rows), key=str)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("few", [2, 64])
def test_hubs_and_paths(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    random.seed(3)
    pairs = [(1000, i) for i in range(400)] + [(i, i + 1) for i in range(2000, 2300)] + [(5000 - i, 5001 - i) for i in range(100)] + [(7000, 6000 + i) for i in range(50)]
    pairs += [(random.randrange(8000, 8100), random.randrange(8000, 8100)) for _ in range(60)] + [(399, 2000), (9, 9), (9, 9)]
    random.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 4), (4, None)], "a long, b long").withColumn("node", F.lit("clash"))
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {n: c for n, c in joined(pairs).items() if any(a != b and n in (a, b) for a, b in pairs)}
    assert got == want
    assert components(df.limit(0)).collect() == []


def plain_leaks(doc, item):
    """All alignments and windows, one by one."""
    w, best = min(decontaminate.WINDOW, len(item)), None
    for a in range(len(doc) - w + 1):
        for b in range(len(item) - w + 1):
            n = sum(x == y for x, y in zip(doc[a : a + w], item[b : b + w], strict=True))
            if n >= decontaminate.AGREE * w:
                best = min(best or (0,), (-n, a, b))
    return best


def test_repetitive_texts_as_brute_force(monkeypatch):
    random.seed(12)
    for hits in (1_000_000, 7):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        for _ in range(60):
            kinds = random.choice([1, 2, 3])
            items = [[f"t{random.randrange(kinds)}" for _ in range(random.choice([6, 9, 20, 33]))] for _ in range(3)]
            docs = [[f"t{random.randrange(kinds + 1)}" for _ in range(random.choice([0, 5, 8, 21, 50]))] for _ in range(3)]
            seeds = decontaminate.Seeds([(i, " ".join(t)) for i, t in enumerate(items)])
            for doc, got in zip(docs, seeds.leaks([" ".join(d) for d in docs]), strict=True):
                want = [(i, a, b, min(20, len(x)), -n) for i, x in enumerate(items) if len(x) >= 6 and (p := plain_leaks(doc, x)) for n, a, b in [p]]
                assert got == want


def test_very_long_repetitive_texts():
    seeds = decontaminate.Seeds([(1, "a " * 2000), (2, "a b " * 150)])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = seeds.leaks(["a " * 100_000, "b a " * 60_000, None, ""])
    assert got[0] == [(0, 0, 0, 20, 20)] and got[1][0][0] == 1 and got[2:] == [[], []]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000 and time.time() - began < 60


@pytest.mark.parametrize("partitions", [3, 8])
def test_repeats_around_common_lines(spark, monkeypatch, partitions):
    """Lines that many documents have, each time between other words, and anchors that are cut wherever they occur."""
    from tessera.llm import suffix

    from . import brute

    monkeypatch.setattr(suffix, "HOT", 1)
    random.seed(31)
    lines = ["all rights reserved by the makers of this very page and its friends " * k for k in (1, 2, 4)] + ["ab" * 90, "é" * 70]
    w = lambda: "".join(random.choices("abcdeé", k=random.randint(1, 7)))
    rows = [(i, " ".join(w() for _ in range(random.randint(0, 20))) + random.choice(lines) + " ".join(w() for _ in range(random.randint(0, 20)))) for i in range(90)] + [(100, None), (101, "")]
    got = {r["doc_id"]: tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False, partitions=partitions).collect()}
    assert got == brute.repeats(rows)
