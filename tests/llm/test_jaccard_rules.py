"""Operator 6 under other shingle lengths and levels than its own."""

import random
import re

import pytest

from tessera.llm import jaccard


def components_of(rows, shingle, level):
    """Every pair compared, no index: the smallest id that links reach."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"\S+", t.lower())
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)}
    least = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {d: (d, len(sets[d]), least[d]) for d in sets}


@pytest.mark.parametrize(("shingle", "level", "together"), [(5, 80, True), (3, 90, False)])
def test_pair_between_two_rules(spark, shingle, level, together):
    """100 words, two changed apart: 5-word similarity 86 / 106, 3-word similarity 92 / 104."""
    a = [f"w{i}" for i in range(100)]
    b = ["x" if i in (30, 60) else w for i, w in enumerate(a)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, shingle=shingle, level=level).collect()}
    assert got == {1: 1, 2: 1 if together else 2}


@pytest.mark.parametrize(("shingle", "level", "light"), [(5, 80, None), (5, 80, 0), (5, 80, 12), (1, 70, None), (2, 100, 12)])
def test_other_rules_as_brute_force(spark, monkeypatch, shingle, level, light):
    random.seed(11)
    bases, rows = [[f"w{random.randrange(300)}" for _ in range(n)] for n in (2, 4, 5, 9, 12, 16, 22, 40, 110) for _ in range(2)], []
    for i in range(240):
        b = list(random.choice(bases))
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            b[random.randrange(len(b))] = f"w{random.randrange(300)}"
        rows.append((i, " ".join(b)))
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle, level=level)
    assert {r["doc_id"]: tuple(r) for r in got.collect()} == components_of(rows, shingle, level)


def test_bad_rules(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for shingle, level in ((0, 90), (3, 0), (3, 101)):
        with pytest.raises(ValueError):
            jaccard.near_duplicates(docs, shingle=shingle, level=level)
