"""Globs looked up by their rarest plain segment, against trying each on each path."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths

BITS = ["a", "b", "ab", "src", "*", "?", "**", "*.md", "a.md", "[ab]", "[a/b]", "\\\\a", "****", ".", "x\n"]


@pytest.mark.parametrize(
    ("glob", "words"),
    [("dir/*.md", ["dir"]), ("**/go.mod", ["go.mod"]), ("a/**/b/c?", ["a", "b"]), ("a****b", []), ("[a/lit/b]", []), ("**", []), ("*", []), ("./src//lib/**", ["lib", "src"]), ("a**b", ["a", "b"])],
)
def test_words(glob, words):
    assert paths.glob_words(glob) == words


def test_as_each_on_each(spark, monkeypatch):
    random.seed(3)
    globs = sorted({"/".join(random.choices(BITS, k=random.randint(1, 4))) if random.random() < 0.8 else "".join(random.choices(BITS, k=3)) for _ in range(400)})
    names = ["/".join(random.choices(["a", "b", "ab", "src", "c", "a.md", "x.md", "x\n", "..", ""], k=random.randint(1, 5))) for _ in range(300)] + ["a\n", "", None]
    p = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string").withColumn("_n", F.lit("clash"))
    g = spark.createDataFrame([(x,) for x in [*globs, globs[0], None]], "glob string")
    every = spark.createDataFrame([(x, paths.glob_regex(x)) for x in globs], "glob string, regex string")
    want = sorted((r["i"], r["glob"]) for r in p.withColumn("c", paths.clean(F.col("path"))).join(F.broadcast(every), F.expr("c rlike regex")).collect())
    for bound in (paths.BROADCAST_GLOBS, 0):
        monkeypatch.setattr(paths, "BROADCAST_GLOBS", bound)
        found = paths.glob_matches(p, "path", g, "glob")
        assert found.columns == ["i", "path", "_n", "glob"]
        assert sorted((r["i"], r["glob"]) for r in found.collect()) == want
    assert len(want) > 1000 and paths.glob_matches(p.limit(0), "path", g, "glob").count() == 0


def test_no_nested_loop_for_plain_segments(spark):
    n = 20_000
    g = spark.range(n).select(F.concat(F.lit("**/dir"), F.col("id").cast("string"), F.lit("/*.md")).alias("glob"))
    p = spark.range(n).select(F.concat(F.lit("src/dir"), F.col("id").cast("string"), F.lit("/a.md")).alias("path"))
    assert paths.glob_matches(p, "path", g, "glob").count() == n
