"""Long and circular chains, kept postings, tools, snapshots and what else stands on several parts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.meta import patched
from tessera.operators import chunking, corpus, graph, lifecycle, recall, search, tools
from tessera.operators import facts as facts_ops
from tessera.operators.facts import Scope
from tessera.sources.postings import Postings
from tessera.sources.tables import Snapshots, create_file
from tessera.streaming import jobs

from .test_rules import facts, one


def chain(spark, pointers):
    """id and superseded_by, with a column whose name clashes with what the walk adds."""
    return spark.createDataFrame([(i, n, 0) for i, n in pointers], "id long, superseded_by long, position int")


def walked(pointers, start):
    """The chain through start, plainly: back to the smallest predecessor each time, then forward; a fact that comes again ends it."""
    after = dict(pointers)
    if start not in after:
        return []
    before = {}
    for i, n in pointers:
        if n is not None:
            before[n] = min(before.get(n, i), i)
    path = [start]
    while (b := before.get(path[0])) is not None and b not in path:
        path.insert(0, b)
    while (n := after[path[-1]]) in after and n not in path:
        path.append(n)
    return path


def test_history_of_a_long_chain(spark):
    n = 10_000
    f = chain(spark, [(i, i + 1 if i < n else None) for i in range(1, n + 1)])
    got = sorted((r["position"], r["id"], r["chain_length"]) for r in graph.history(f, spark.createDataFrame([(n // 2,)], "id long")).collect())
    assert got == [(i, i + 1, n) for i in range(n)]


def test_history_as_a_plain_walk(spark):
    random.seed(6)
    pointers = [(i, random.choice([None, random.randrange(70), random.randrange(40)])) for i in range(60)]
    pointers += [(100, 101), (101, 102), (102, 100), (99, 101), (200, 200), (300, 999)]
    starts = [i for i, _ in pointers] + [5000]
    got = {}
    for r in graph.history(chain(spark, pointers), spark.createDataFrame([*[(s,) for s in starts], (None,), (starts[0],)], "id long")).collect():
        got.setdefault(r["start"], []).append((r["position"], r["id"], r["chain_length"]))
    for s in starts:
        path = walked(pointers, s)
        assert sorted(got.get(s, [])) == [(k, i, len(path)) for k, i in enumerate(path)]
    assert graph.history(chain(spark, pointers[:0]), spark.createDataFrame([(1,)], "id long")).collect() == []


def test_two_walks_side_by_side(spark):
    """Nothing is registered in the session that another walk could replace."""
    a, b = chain(spark, [(1, 2), (2, None)]), chain(spark, [(1, 3), (3, None)])
    ids = spark.createDataFrame([(1,)], "id long")
    x, y = graph.history(a, ids), graph.history(b, ids)
    assert {r["id"] for r in x.collect()} == {1, 2} and {r["id"] for r in y.collect()} == {1, 3}


@pytest.mark.parametrize(
    ("old", "patch", "new"),
    [
        ('{"a\\"b":1,"z":null}', '{"c":2}', {'a"b': 1, "z": None, "c": 2}),
        ('{"a":null,"b":[1,{"c":null}]}', '{"a":3}', {"a": 3, "b": [1, {"c": None}]}),
        ('{"a":1,"b":2}', '{"a":null,"q":null}', {"b": 2}),
        ('{"tab\\tkey":"é\\\\"}', "{}", {"tab\tkey": "é\\"}),
        (None, '{"x":true}', {"x": True}),
        ("[1]", '{"x":1.5}', {"x": 1.5}),
        ('{"x":1}', "not json", {"x": 1}),
    ],
)
def test_patched(spark, old, patch, new):
    got = one(spark, patched(F.col("m"), F.col("p")), m=old, p=patch)
    assert json.loads(got) == new


def searched(spark, f, queries, found=None):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in search.bm25(f, queries, found=found).collect())


def test_kept_postings_follow_changes(spark, tmp_path):
    random.seed(2)
    words = ["sqlite", "go", "store", "index", "the", "café", "x1"]
    text = lambda: " ".join(random.choice(words) + random.choice(["", ".", "-"]) for _ in range(random.randint(0, 12)))
    rows = [{"id": i, "content": text(), "subject": random.choice(["store.go", "s"])} for i in range(60)] + [{"id": 90, "content": None}]
    queries = spark.createDataFrame([(1, "the"), (2, "sqlite.go store"), (3, "zzz"), (4, "cafe the the"), (5, " -- "), (6, "go.go")], "query_id int, text string")
    kept = Postings(spark, str(tmp_path / "index"))
    kept.build(facts(spark, rows))
    assert searched(spark, None, queries, kept.places(search.query_terms(queries))) == searched(spark, facts(spark, rows), queries) != []
    changed = [r | {"content": text() + " zzz"} for r in rows[:20]] + [{"id": 200, "content": "new zzz store"}]
    kept.update(facts(spark, changed), spark.createDataFrame([(30,), (31,)], "id long"))
    now = changed + [r for r in rows[20:] if r["id"] not in (30, 31)]
    assert searched(spark, None, queries, kept.places(search.query_terms(queries))) == searched(spark, facts(spark, now), queries)
    assert searched(spark, None, queries, kept.places(search.query_terms(queries), 1)) == searched(spark, facts(spark, rows), queries)
    assert searched(spark, facts(spark, []), queries) == []


def test_of_two_writers_one_fails(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"))
    df = spark.range(3)
    assert tables.commit(a=df) == 1
    create_file(spark, str(tmp_path / "t/_commits/2/pointer.json"), "")  # another writer was quicker
    with pytest.raises(Exception, match="(?i)exist"):
        tables.commit(a=df.limit(1))
    assert tables.read("a").count() == 3


def test_tool_search(spark):
    rows = [{"id": i, "content": "apple " * (i % 5 + 1) + "pear" * (i % 2), "category": "note" if i % 2 else "identity", "namespace": "n" if i < 40 else "m"} for i in range(60)]
    queries = spark.createDataFrame([(1, "apple"), (2, "  ")], "query_id int, text string")
    ask = lambda limit: tools.tool_search(facts(spark, rows), queries, limit, s=Scope("n"), now=dt.datetime(2024, 3, 1))
    for limit, n in ((0, 10), (-3, 10), (7, 7), (500, 40)):
        found, used = ask(limit)
        got = found.collect()
        assert len(got) == n and {r["query_id"] for r in got} == {1} and all(r["use_count"] == 1 and r["id"] < 40 for r in got)
        assert {r["id"] for r in used.where("use_count = 1").collect()} == {r["id"] for r in got}
    first = {r["id"]: r["score"] for r in ask(50)[0].collect()}
    assert first[4] == pytest.approx(1.0) and first[9] == pytest.approx(0.5 ** 2 * first[4], rel=0.2)  # 60 days of a note
    assert tools.tool_search(facts(spark, []), queries, 0)[0].collect() == []


def test_tool_store(spark):
    f = facts(spark, [{"id": 1, "content": "a"}, {"id": 2, "content": "b", "superseded_by": 1}, {"id": 3, "content": "c"}])
    items = spark.createDataFrame([(0, 10, " new ", "s", None, 1), (1, 11, "newer", "s", "x", 2), (2, 12, "newest", "s", "", 99), (3, 13, "a", "s", "", 3), (4, 14, "", "s", "", 3), (5, 15, "plain", "s", "", None)], "item int, id long, content string, subject string, category string, supersedes long")
    after, report = tools.tool_store(f, items, "n", 1, "2024-05-01")
    got = {r["item"]: (r["status"], r["superseded"], r["warning"]) for r in report.collect()}
    assert got == {0: ("stored", 1, None), 1: ("stored", None, "fact 2 was not replaced"), 2: ("stored", None, "fact 99 was not replaced"), 3: ("duplicate", None, None), 4: ("error", None, None), 5: ("stored", None, None)}
    now = {r["id"]: (r["content"], r["category"], r["superseded_by"]) for r in after.collect()}
    assert now[10] == ("new", "note", None) and now[1][2] == 10 and now[2][2] == 1 and now[3][2] is None and set(now) == {1, 2, 3, 10, 11, 12, 15}


def test_owned_links(spark):
    f = facts(spark, [{"id": 1, "user_id": 1}, {"id": 2, "user_id": 1}, {"id": 3, "user_id": 2}, {"id": 4, "user_id": 1, "namespace": "other"}])
    new = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 2, 2), (5, 3, 3), (6, 9, 9), (7, None, 1)], "id long, source_id long, target_id long")
    both = {r["id"]: (r["user_id"], r["error"]) for r in lifecycle.owned_links(new, f, "n").collect()}
    bad = (None, "fact not found")
    assert both == {1: (1, None), 2: bad, 3: bad, 4: (1, None), 5: (2, None), 6: bad, 7: bad}
    assert {r["id"] for r in lifecycle.owned_links(new, f, "n", 1).where("error is null").collect()} == {1, 4}
    assert [r["id"] for r in facts_ops.absent(f, spark.createDataFrame([(1,), (7,), (7,), (None,)], "id long")).collect()] == [7]


def test_second_tier_only_where_there_is_room(spark):
    rows = [(i, i, 0, "maxContent" if i < 3 else "max content here", False) for i in range(8)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, ordinal int, content string, generated boolean")
    q = spark.createDataFrame([(1, "maxContent")], "query_id int, text string")
    for limit, tiers in ((2, [0, 0]), (3, [0, 0, 0]), (5, [0, 0, 0, 1, 1]), (20, [0, 0, 0, 1, 1, 1, 1, 1])):
        got = corpus.search_chunks(chunks, q, limit).orderBy("place").collect()
        assert [r["tier"] for r in got] == tiers and [r["place"] for r in got] == list(range(1, len(tiers) + 1))


def test_contexts_and_records(spark):
    f = facts(spark, [{"id": 1, "content": "x" * 400}, {"id": 2, "content": "two", "category": "note"}])
    shown = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (8, 1, 1)], "request_id int, rank int, id long")
    got = {r["request_id"]: r["text"] for r in recall.contexts(shown, f).collect()}
    assert got[7] == "[id=2] s | note\n  two\n\n[id=1] s | note\n  " + "x" * 300 + "...\n"
    requests = spark.createDataFrame([(7, "s"), (8, "")], "request_id int, session_id string")
    injected, seen = recall.recorded(shown, requests, spark.createDataFrame([("s", 1), ("t", 5)], "session_id string, id long"))
    assert sorted((r["session_id"], r["ref_id"], r["rank"]) for r in injected.collect()) == [("s", "1", 1), ("s", "2", 0)]
    assert sorted(map(tuple, seen.collect())) == [("s", 1), ("s", 2), ("t", 5)]


def test_embedding_outcomes_and_batches(spark):
    rows = [(1, [[1.0]], None, None), (2, [], None, None), (3, None, "time-out", True), (4, None, "no such input", False), (5, [[1.0], [2.0]], None, None), (6, None, "?", None)]
    good, bad, again = jobs.embed_outcomes(spark.createDataFrame(rows, "id long, vectors array<array<float>>, error string, retryable boolean"))
    assert [r["id"] for r in good.collect()] == [1] and {r["id"] for r in bad.collect()} == {4, 6} and {r["id"] for r in again.collect()} == {2, 3, 5}
    f = facts(spark, [{"id": i, "content": "t" * i if i else None} for i in range(120)]).coalesce(1)

    def call(texts):
        assert len(texts) <= 50
        return [[float(len(t))] for t in texts]

    assert {r["id"]: r["vector"] for r in jobs.embed_in_batches(f, call).collect()} == {i: [float(i)] for i in range(120)}
    with pytest.raises(Exception, match="1 vectors for 50 texts"):
        jobs.embed_in_batches(f, lambda texts: [[0.0]]).collect()


def go_file(statements: int) -> bytes:
    body = "".join(f"\tx{i} := call(\n\t\t\"}}{{ {'z' * 60}\",\n\t\tf{i}, // }} comment {{\n\t)\n\tif x{i} != nil {{\n\t\treturn x{i} +\n\t\t\t1\n\t}}\n" for i in range(statements))
    specs = "".join(f"\t// C{i} is\n\tC{i} = {i} + // {'c' * 100}\n\t\t2\n" for i in range(statements))
    return f"package p\n\nimport \"fmt\"\n\n// F does.\nfunc F(\n\ta int,\n\tb int,\n) error {{\n{body}}}\n\nconst (\n{specs})\n\nvar V = []int{{\n{'1,' * 5000}\n}}\n".encode()


def test_go_is_cut_between_statements_and_specs():
    data = go_file(120)
    found = chunking.go_source(data).chunks
    text = [data[c.byte_start : c.byte_end].decode() for c in found]
    f, c, v = ([t for t, k in zip(text, found, strict=True) if k.symbol == s] for s in ("F", "C0", "V"))
    assert len(f) > 3 and f[0].startswith("// F does.\nfunc F(") and all(t.startswith(("x", "if x")) for t in f[1:]) and f[-1].endswith("}")
    assert all(t.rstrip()[-1] in ")}" for t in f)
    assert len(c) > 2 and all(t.startswith("C") for t in c[1:]) and c[-1].endswith(")")
    assert len(v) == 1 and len(v[0]) > chunking.MAX
    for pieces in (f[:-1], c[:-1]):
        assert all(chunking.TARGET <= chunking.weight(t.encode()) for t in pieces)


def test_go_comments_cost_their_length():
    data = b"package p\n" + b"/* x */\n" * 40_000 + b"func F() {}\n"
    assert [c.symbol for c in chunking.go_source(data).chunks][-1] == "F"


def test_cluster_needs_a_shared_folder(monkeypatch):
    from tessera.sources import tables

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Plain:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isEmpty():
                                return True

                        return Option

                return Plain

        @staticmethod
        def getConf():
            return Conf()

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)
