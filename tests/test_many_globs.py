"""Triggers by globs, more of them than 1000."""

from tessera.operators import context, recall

from .test_rules import facts

MANY = 1100


def test_every_glob_finds_its_file(spark):
    triggers = spark.createDataFrame([(i, f"dir{i}/*.md") for i in range(MANY)] + [(MANY, None), (MANY + 1, "**/a.md")], "id int, signal string")
    files = spark.createDataFrame([(f"x/dir{i}/a.md",) for i in range(0, MANY, 100)] + [("x/none/b.md",), (None,)], "file string")
    got = sorted((r["file"], r["id"]) for r in context.file_triggers(triggers, files).collect())
    assert got == sorted((f"x/dir{i}/a.md", k) for i in range(0, MANY, 100) for k in (i, MANY + 1))
    assert context.file_triggers(triggers.limit(0), files).columns == ["file", "id"] and context.file_triggers(triggers.limit(0), files).count() == 0


def test_every_directory_loads_its_facts(spark):
    meta = '{"signal_type":"cwd_pattern","signal":"dir%d","load_subsystem":"sub%d"}'
    rows = [{"id": i, "kind": "trigger", "content": "t", "metadata": meta % (i, i)} for i in range(MANY)]
    rows += [{"id": 10_000 + i, "kind": "decision", "content": "c", "subsystem": f"sub{i}"} for i in range(MANY)]
    asked = spark.createDataFrame([(i, f"/work/dir{i}") for i in range(0, MANY, 100)] + [(5, "")], "request_id int, cwd string")
    got = sorted((r["request_id"], r["id"]) for r in recall.trigger_loads(facts(spark, rows), asked).collect())
    assert got == [(i, 10_000 + i) for i in range(0, MANY, 100)]
