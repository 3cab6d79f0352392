"""Words of tasks inside texts, without a comparison of every task with every text."""

from pyspark.sql import functions as F

from tessera.operators import context, matches

FACTS = [
    (3, "a", ["en", ""], "The Thention there's no break"), (1, "b", ["EN", None], "xél\ty" + "z" * 5000 + "worthless"), (2, "c", [], None), (4, "d", None, "thention"),
    (5, "e", ["is"], ""), (6, "f", [], "WORTHLESSLY\x0bthe"), (6, "f", [], "the the İstanbul"), (7, "g", [], "br bre"),
]
TASKS = [(1, "the hen The worthless"), (2, None), (3, ""), (4, "  él is in  EN "), (5, "no break ten İstanbul"), (6, "zzzz\nthe")]


def tables(spark):
    return spark.createDataFrame(FACTS, "id long, agent string, domains array<string>, content string"), spark.createDataFrame(TASKS, "task_id int, task string")


def each_on_each(facts, tasks):
    words = F.size(F.filter(F.split(F.lower(F.trim("task")), r"\s+"), lambda w: (F.octet_length(w) >= 3) & F.contains(F.lower("content"), w)))
    hits = F.size(F.filter("domains", lambda d: (d != "") & F.contains(F.lower("task"), F.lower(d))))
    return facts.crossJoin(tasks).withColumn("score", 3 * hits + words).where("score > 0").select("task_id", "id", "agent", "score")


def test_as_each_on_each(spark, monkeypatch):
    facts, tasks = tables(spark)
    want = sorted(map(tuple, each_on_each(facts, tasks).collect()))
    assert len(want) > 8
    assert sorted(map(tuple, matches.matches(facts, tasks).collect())) == want
    monkeypatch.setattr(matches.search, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, matches.matches(facts, tasks).collect())) == want


def test_first_of_each_task(spark):
    facts, tasks = tables(spark)
    many = facts.crossJoin(spark.range(400).withColumnRenamed("id", "n")).withColumn("id", F.col("id") + F.col("n") * 10).drop("n").where("id <> 6 or agent is not null").dropDuplicates(["id"])
    want: dict = {}
    for task, i, agent, score in map(tuple, each_on_each(many, tasks).collect()):
        want.setdefault(task, []).append((-score, i, agent))
    rows = context.scored_agents(many.coalesce(2), tasks, 3).collect()
    got = {(r["task_id"], r["rank"]): (-r["score"], r["id"], r["agent"]) for r in rows}
    assert got == {(t, k + 1): x for t, every in want.items() for k, x in enumerate(sorted(every)[:3])}


def test_no_pairs_are_made(spark):
    facts, tasks = tables(spark)
    plan = context.scored_agents(facts, tasks)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_tasks_no_facts(spark):
    facts, tasks = tables(spark)
    assert context.scored_agents(facts, tasks.limit(0)).collect() == context.scored_agents(facts.limit(0), tasks).collect() == []
