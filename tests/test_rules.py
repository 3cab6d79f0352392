"""Rules with literal rows: each test states a rule and what it gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.meta import MetaFilter, conflicts, meta_filter, patched
from tessera.functions.text import candidate_words, cut_bytes, decomposed, query_phrases, terms, weight
from tessera.functions.vector import cosine
from tessera.operators import chunking, context, corpus, extract, graph, lifecycle, recall, search, sessions
from tessera.operators.facts import Options, Scope, exists, list_facts, scope
from tessera.schemas import FACTS, LINKS
from tessera.sources import tables, transfer


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def facts(spark, rows):
    """Facts from dicts; what a row doesn't name is empty."""
    base = {"namespace": "n", "user_id": 1, "subject": "s", "category": "note", "kind": "", "subsystem": "", "confirmed_count": 0, "use_count": 0, "created_at": dt.datetime(2024, 1, 1)}
    names = [f.split()[0] for f in FACTS.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], FACTS)


# ---- text


def test_terms_and_phrases(spark):
    assert one(spark, terms(F.col("t")), t="Café store/sqlite.go  ÑANDÚ_2") == ["cafe", "store", "sqlite", "go", "nandu", "2"]
    assert one(spark, query_phrases(F.col("t")), t=" sqlite.go  the -- ") == [["sqlite", "go"], ["the"]]


def test_candidate_words(spark):
    assert one(spark, candidate_words(F.col("t")), t='How does "Auth" (auth) work, in go? é Zürich') == ["auth", "work", "zürich"]


@pytest.mark.parametrize(("text", "words"), [("MaxContentLength", "max content length"), ("HTTPServer.go", "http server go"), ("a_b-c:d/e", "a b c d e"), ("", ""), ("plain words", "plain words")])
def test_decomposition(spark, text, words):
    assert one(spark, decomposed(F.col("t")), t=text) == words


def test_cut_bytes_keeps_characters_whole(spark):
    random.seed(1)
    rows = ["".join(random.choices("aé漢😀", k=random.randint(0, 60))) for _ in range(200)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", cut_bytes(F.col("t"), 40, "…").alias("x")).collect()
    for r in got:
        if len(r["t"].encode()) <= 40:
            assert r["x"] == r["t"]
        else:
            cut = r["x"][:-1]
            assert r["x"][-1] == "…" and r["t"].startswith(cut) and len(cut.encode()) <= 40
            assert len(cut.encode()) + len(r["t"][len(cut)].encode()) > 40 - 6


def test_weight(spark):
    assert one(spark, weight(F.col("t")), t=" a\u00a0b\n漢 ") == 3


# ---- metadata


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (MetaFilter("chapter", "<=", 3), {1}),
        (MetaFilter("chapter", "<=", 3, include_null=True), {1, 3, 5}),
        (MetaFilter("chapter", "!=", 1), {2}),
        (MetaFilter("chapter", "=", "text"), {4}),
        (MetaFilter("flag", "=", True), {6}),
        (MetaFilter("flag", "=", 1), set()),
    ],
)
def test_typed_filters(spark, f, want):
    rows = [(1, '{"chapter":1}'), (2, '{"chapter":9}'), (3, '{"other":1}'), (4, '{"chapter":"text"}'), (5, None), (6, '{"chapter":"x","flag":true}')]
    df = spark.createDataFrame(rows, "id int, m string")
    assert {r["id"] for r in df.where(meta_filter(F.col("m"), f)).collect()} == want


@pytest.mark.parametrize("bad", [("a b", "=", 1), ("a", "~", 1), ("", "=", 1)])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        MetaFilter(*bad)


@pytest.mark.parametrize(("old", "patch", "new"), [('{"a":1,"b":"x"}', '{"b":null,"c":[1]}', '{"a":1,"c":[1]}'), (None, '{"a":"q\\"r"}', '{"a":"q\\"r"}'), ('{"a":{"z":1}}', '{"a":{"y":2}}', '{"a":{"y":2}}'), ('{"a":1}', '{"a":null}', "{}")])
def test_patches(spark, old, patch, new):
    assert one(spark, patched(F.col("o"), F.col("p")), o=old, p=patch) == new


@pytest.mark.parametrize(("a", "b", "want"), [('{"p":"x"}', '{"p":"y"}', True), ('{"p":"x"}', '{"q":"y"}', False), ('{"p":"x"}', None, False), ("{bad", '{"p":1}', False), ('{"p":1,"q":2}', '{"q":2}', False)])
def test_conflicts(spark, a, b, want):
    assert one(spark, conflicts(F.col("a"), F.col("b")), a=a, b=b) is want


# ---- paths

GLOBS = [
    ("lib/news/**", "/home/x/lib/news/a/b.go", True), ("lib/news/**", "/home/x/lib/news", True), ("lib/news/**", "/home/x/lib/other/a.go", False),
    ("*.go", "/a/b/c.go", True), ("*.go", "/a/b/c.md", False), ("b/*.go", "/a/b/c.go", True), ("b/*.go", "/a/b/d/c.go", False), ("**/c.go", "/a/b/c.go", True), ("a/**/c.go", "/a/c.go", True),
    ("a/**/c.go", "/a/x/y/c.go", True), ("a/**/c.go", "/b/x/c.go", False), ("**", "/any/thing", True), ("c?.go", "/a/c1.go", True), ("c[0-2].go", "/a/c1.go", True), ("c[^0-2].go", "/a/c1.go", False),
    ("a.b", "/x/aXb", False), ("src/**/test/*.py", "/r/src/a/b/test/t.py", True), ("src/**/test/*.py", "/r/src/test/t.py", True), ("x/**", "/a/xy/b", False), ("./b/*.go", "/a/b/c.go", True),
]


@pytest.mark.parametrize(("pattern", "path", "want"), GLOBS)
def test_globs(spark, pattern, path, want):
    assert one(spark, paths.glob_match(pattern, F.col("p")), p=path) is want


@pytest.mark.parametrize(("path", "want"), [("a/./b//c", "a/b/c"), ("/a/../..", "/"), ("a/../../b", "../b"), ("", "."), ("/", "/"), ("a/b/..", "a"), ("../..", "../..")])
def test_clean(spark, path, want):
    assert one(spark, paths.clean(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.md", True), ("/a", False), ("", False), ("a\\b", False), ("a//b", False), ("../x", False), ("..", False), ("a/../b", False), ("..a/b", True)])
def test_valid(spark, path, want):
    assert one(spark, paths.valid(F.col("p")), p=path) is want


@pytest.mark.parametrize(("path", "size", "want"), [("vendor/a.md", 9, "excluded directory: vendor"), ("a/.git/x.exe", 9, "excluded directory: .git"), ("a.exe", 1 << 30, "unroutable extension: .exe"), ("a/Makefile", 9, "no extension"), ("a.md", (1 << 20) + 1, "size 1048577 exceeds cap 1048576"), ("A.PY", 1 << 20, None)])
def test_skip(spark, path, size, want):
    assert one(spark, paths.skip_reason(F.col("p"), F.lit(size)), p=path) == want


# ---- ranking


def test_merge_normalises_by_the_largest(spark):
    lexical = spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.0), (1, 3, 1.0)], "query_id int, id int, score double")
    got = {r["id"]: r["fts"] for r in search.merge_arms(lexical, lexical.limit(0), (1.0, 0.0)).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.1}
    only_vec = search.merge_arms(lexical.limit(0), lexical, (0.6, 0.4)).where("id = 2").first()
    assert (only_vec["fts"], only_vec["combined"]) == (0.0, 2.0)


def pool(spark):
    docs = spark.createDataFrame([(1, "a", "c"), (2, "b", "c"), (3, "c", "c")], "id int, content string, category string")
    merged = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.1)], "query_id int, id int, combined double")
    return merged, docs, spark.createDataFrame([(1, "q")], "query_id int, text string")


def second_stage(query, doc):
    return F.when(doc == "a", 0.1).when(doc == "b", 0.2).otherwise(0.9)


def test_balanced_fusion(spark):
    rows = search.rerank(*pool(spark), search.SearchOptions(rerank_mode="balanced"), second_stage).collect()
    assert {r["id"]: round(r["combined"], 6) for r in rows} == {1: 0.37, 2: 0.29, 3: 0.66}


def test_gate_keeps_order_and_drops(spark):
    rows = search.rerank(*pool(spark), search.SearchOptions(rerank_mode="gate", rerank_threshold=0.15), second_stage).orderBy(F.desc("combined")).collect()
    assert [(r["id"], r["combined"]) for r in rows] == [(2, 0.5), (3, 0.1)]


def test_outage_never_filters(spark):
    rows = search.rerank(*pool(spark), search.SearchOptions(rerank_mode="gate", rerank_threshold=0.99), None).collect()
    assert {r["id"]: r["combined"] for r in rows} == {1: 1.0, 2: 0.5, 3: 0.1} and all(r["rerank"] is None for r in rows)


def test_pool_is_cut_and_threshold_drops_the_rest(spark):
    o = search.SearchOptions(rerank_mode="dominant", rerank_candidates=2)
    assert {r["id"]: r["rerank"] for r in search.rerank(*pool(spark), o, second_stage).collect()} == {1: 0.1, 2: 0.2, 3: None}
    o = search.SearchOptions(rerank_mode="dominant", rerank_candidates=2, rerank_threshold=0.05)
    assert {r["id"] for r in search.rerank(*pool(spark), o, second_stage).collect()} == {1, 2}


def test_trust_then_decay(spark):
    rows = spark.createDataFrame([(1, 1.0, "note", 9, dt.datetime(2024, 1, 1)), (2, 1.0, "note", 1, dt.datetime(2024, 1, 31)), (3, 1.0, "identity", 0, dt.datetime(2000, 1, 1))], "id int, combined double, category string, confirmed_count int, created_at timestamp")
    o = search.SearchOptions(half_life_s=30 * 86400, category_half_life_s={"identity": 0})
    got = {r["id"]: round(r["combined"], 6) for r in search.boosted(rows, o, "2024-01-31").collect()}
    assert got == {1: 0.575, 2: 1.05, 3: 1.0}


def test_weights_default_only_if_both_are_zero():
    assert search.SearchOptions().weights == (0.6, 0.4)
    assert search.SearchOptions(lexical_weight=1.0).weights == (1.0, 0.0)
    assert search.SearchOptions(max_results=30, rerank_mode="gate").fetch == 60 and search.SearchOptions(rerank_mode="gate").fetch == 40


def test_bm25_as_sqlite_fts5(spark):
    import sqlite3

    random.seed(3)
    docs = [(i, " ".join(random.choices(["alpha", "beta", "gamma.delta", "café", "x-y", "the"], k=random.randint(1, 30)))) for i in range(1, 60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content)")
    con.executemany("insert into t(rowid, content) values (?, ?)", docs)
    df = spark.createDataFrame(docs, "id int, content string")
    for q in ("alpha beta", "gamma.delta", "cafe", "x-y alpha", "delta"):
        match = " ".join(f'"{w}"' for w in q.split())
        want = {i: round(-s, 6) for i, s in con.execute("select rowid, rank from t where t match ?", (match,))}
        got = search.bm25(df, spark.createDataFrame([(1, q)], "query_id int, text string"), columns=("content",))
        assert {r["id"]: round(r["score"], 6) for r in got.collect()} == want


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<float>, b array<float>")
    assert [r["x"] for r in rows.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [None, None, None, pytest.approx(1.0)]


# ---- scope and reads


def test_scope(spark):
    f = facts(spark, [{"id": 1, "namespace": "a", "content": "x"}, {"id": 2, "namespace": "b", "content": "y", "user_id": 2}])
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(scope(f, Scope("a"))) == [1] and ids(scope(f, Scope(namespaces=("a", "b")))) == [1, 2] and ids(scope(f, Scope(every_namespace=True, user_id=2))) == [2]
    assert ids(list_facts(f, Options(), Scope("b", every_namespace=True))) == [2]
    probes = spark.createDataFrame([("x", "s", "a"), ("x", "s", "b")], "content string, subject string, namespace string")
    assert exists(f, probes).count() == 1


# ---- lifecycle


def test_supersede_once_and_only_by_what_exists(spark):
    f = facts(spark, [{"id": i, "content": "c"} for i in (1, 2, 3)])
    f = lifecycle.supersede(f, spark.createDataFrame([(1, 2), (3, 99)], "old_id long, new_id long"), "2024-05-01")
    f = lifecycle.supersede(f, spark.createDataFrame([(1, 3)], "old_id long, new_id long"), "2024-06-01")
    assert {r["id"]: (r["superseded_by"], r["superseded_at"]) for r in f.collect()} == {1: (2, dt.datetime(2024, 5, 1)), 2: (None, None), 3: (None, None)}


def test_insert_stamps_and_refuses_long_content(spark):
    f = facts(spark, [])
    new = spark.createDataFrame([(1, "x", "evil"), (2, "y" * 8001, "evil")], "id long, content string, namespace string")
    r = lifecycle.insert(f, new, "mine", 4, "2024-01-01").collect()
    assert [(x["id"], x["namespace"], x["user_id"], x["kind"], x["use_count"]) for x in r] == [(1, "mine", 4, "", 0)]


def test_embedding_quarantine(spark):
    f = facts(spark, [{"id": i, "content": "c"} for i in (1, 2, 3)])
    f = lifecycle.mark_embed_failed(f, spark.createDataFrame([(2, "bad")], "id long, error string"), "2024-01-01")
    f = lifecycle.set_embedding(f, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"))
    assert [r["id"] for r in lifecycle.pending(f).collect()] == [3]
    back = lifecycle.set_embedding(f, spark.createDataFrame([(2, [1.0])], "id long, vector array<float>")).where("id = 2").first()
    assert back["embed_error"] is None and back["embed_failed_at"] is None


def test_links(spark):
    links = spark.createDataFrame([(1, 10, 20, "reference", False, "", None, None), (2, 30, 10, "depends", True, "", None, None)], LINKS)
    of = lambda d, *t: sorted((r["other_id"]) for r in graph.links_of(links, spark.createDataFrame([(10,)], "fact_id long"), d, t).collect())
    assert of("outbound") == [20, 30] and of("inbound") == [30] and of("both") == [20, 30] and of("both", "depends") == [30]
    more = lifecycle.link(links, spark.createDataFrame([(3, 1, 2)], "id long, source_id long, target_id long")).where("id = 3").first()
    assert (more["link_type"], more["bidirectional"]) == ("reference", False)
    gone = lifecycle.delete(links, links, spark.createDataFrame([(30,)], "id long"))[1]
    assert [r["id"] for r in gone.collect()] == [1]


def test_history_ends_at_cycles_and_gaps(spark):
    f = facts(spark, [{"id": i, "content": "c", "superseded_by": n} for i, n in ((1, 2), (2, 3), (3, None), (4, 3), (5, 6), (6, 5), (7, 99))])
    got = sorted(tuple(r) for r in graph.history(f, spark.createDataFrame([(2,), (5,), (7,)], "id long")).collect())
    assert got == [(2, 1, 0, 3), (2, 2, 1, 3), (2, 3, 2, 3), (5, 5, 1, 2), (5, 6, 0, 2), (7, 7, 0, 1)]
    places = {r["id"]: (r["root"], r["position"]) for r in graph.chain_positions(f).collect()}
    assert places == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 7: (7, 0)}


# ---- corpus and chunkers


def test_manifest(spark):
    m = spark.createDataFrame([("a.md", "AA", 1), ("b.md", "bb", 1), ("vendor/c.md", "", 1), ("new.go", "cc", 1)], "path string, sha256 string, size long")
    s = spark.createDataFrame([("a.md", "aa"), ("b.md", "b0"), ("vendor/c.md", "x"), ("old.md", "y")], "path string, sha256 string")
    assert {r["path"]: r["action"] for r in corpus.sync(m, s).collect()} == {"a.md": "unchanged", "b.md": "need", "vendor/c.md": "skip", "new.go": "need", "old.md": "orphan"}
    bad = spark.createDataFrame([("a.md", "0" * 64, 1), ("a.md", "0" * 64, 1), ("../x", "0" * 64, 1), ("c.md", "zz", 1), ("d.exe", "zz", 1)], "path string, sha256 string, size long")
    assert {(r["path"], r["error"]) for r in corpus.manifest_errors(bad).collect()} == {("a.md", "duplicate"), ("../x", "invalid path"), ("c.md", "bad hash")}


def test_upload_errors(spark):
    import hashlib

    good = hashlib.sha256(b"\xff").hexdigest()
    df = spark.createDataFrame([("a.md", bytearray(b"\xff"), good), ("../a.md", bytearray(b"x"), good), ("a.exe", bytearray(b"x"), good)], "path string, content binary, sha256 string")
    assert [r["error"] for r in corpus.upload_errors(df).collect()] == ["not text", "invalid path", "unroutable extension: .exe"]


def test_upsert_tells_loose_files_apart(spark):
    schema = "id long, namespace string, user_id long, repo_url string, path string"
    docs = spark.createDataFrame([(1, "n", 1, None, "a.md"), (2, "n", 1, "r", "a.md")], schema)
    chunks = spark.createDataFrame([(1, 0), (2, 0)], "document_id long, ordinal int")
    new = spark.createDataFrame([(9, "n", 1, None, "a.md")], schema)
    d, c = corpus.upsert_documents(docs, chunks, new, spark.createDataFrame([(9, 0)], "document_id long, ordinal int"))
    assert sorted(r["id"] for r in d.collect()) == [2, 9] and sorted(r["document_id"] for r in c.collect()) == [2, 9]


@pytest.mark.parametrize("args", [("r", "c", "r@c p:L1-2"), ("r", "", "r p:L1-2"), ("", "c", "p:L1-2"), (None, None, "p:L1-2")])
def test_citation(spark, args):
    assert one(spark, corpus.citation(F.lit(args[0]), F.lit(args[1]), F.lit("p"), F.lit(1), F.lit(2))) == args[2]


def spans_hold(data: bytes, found: chunking.Chunks):
    starts = [c.byte_start for c in found.chunks]
    assert starts == sorted(set(starts))
    for c in found.chunks:
        assert 0 <= c.byte_start < c.byte_end <= len(data) and data[c.byte_start : c.byte_end].strip()


def test_line_windows_overlap_and_advance():
    data = b"".join(b"line %04d with some words in it\n" % i for i in range(400))
    found = chunking.line_window(data)
    spans_hold(data, found)
    assert len(found.chunks) > 3 and found.chunks[0].byte_start == 0 and found.chunks[-1].byte_end == len(data) - 1
    for a, b in zip(found.chunks, found.chunks[1:], strict=False):
        shared = chunking.weight(data[b.byte_start : a.byte_end])
        assert 0 < shared <= chunking.OVERLAP and chunking.weight(data[a.byte_start : a.byte_end]) >= chunking.TARGET
    huge = b"x" * 9000 + b"\n" + b"y" * 9000
    assert [(c.byte_start, c.byte_end) for c in chunking.line_window(huge).chunks] == [(0, 9000), (9001, 18001)]
    assert chunking.line_window(b" \n\n").chunks == [] and chunking.line_window(b"").chunks == []


def test_markdown_sections():
    body = "word " * 200
    text = f"---\ntitle: A guide\ntags: [a, b]\n---\nintro {body}\n# One\n{body}\n## Two\n{body}\n## Three\n{body}\n# Four\nend {body}\n"
    found = chunking.markdown(text.encode())
    spans_hold(text.encode(), found)
    assert found.title == "A guide" and '"tags": ["a", "b"]' in found.front_matter
    assert [(c.heading_path, c.heading_level) for c in found.chunks] == [("", 0), ("", 1), ("One", 2), ("One", 2), ("", 1)]


def test_markdown_merges_small_siblings_and_splits_fences():
    text = "# A\nshort\n# B\nshort\n# C\n" + "long " * 500 + "\n```go\n" + "code line\n" * 400 + "# not a heading\n```\nafter\n"
    found = chunking.markdown(text.encode())
    spans_hold(text.encode(), found)
    parts = [text.encode()[c.byte_start : c.byte_end] for c in found.chunks]
    assert parts[0] == b"# A\nshort\n# B\nshort" and [c.lang for c in found.chunks] == ["", "", "go", ""]
    assert parts[2].startswith(b"```go") and parts[2].endswith(b"# not a heading\n```") and parts[3] == b"after"


def test_markdown_large_section_splits_between_blocks():
    blocks = ["para%d " % i + "w" * 1500 for i in range(9)]
    table = "| a | b |\n| - | - |\n" + "| cc | dd |\n" * 900
    text = "# H\n" + "\n\n".join([*blocks, table]) + "\n"
    found = chunking.markdown(text.encode())
    spans_hold(text.encode(), found)
    assert len(found.chunks) > 3 and sum(table.encode().strip() in text.encode()[c.byte_start : c.byte_end] for c in found.chunks) == 1


@pytest.mark.parametrize("text", ["---\na: [1\n---\nx", "---\nnot yaml at all\n---\nx", "+++\nbad = \n+++\nx", "---\nno end"])
def test_malformed_front_matter_is_content(text):
    found = chunking.markdown(text.encode())
    assert found.front_matter is None and found.chunks


def test_go_source():
    code = b'// Code generated by x. DO NOT EDIT.\n\npackage app\n\nimport (\n\t"fmt"\n\t"net/http"\n)\n\n// Serve says } in a comment.\nfunc (s *Server) Serve(w http.ResponseWriter) {\n\tfmt.Println("{", `}`, \'{\')\n' + b"\t// filler filler filler filler\n" * 30 + b"}\n\ntype Server struct {\n" + b"\tfield%d int // some field of it\n" % 1 * 30 + b"}\n"
    found = chunking.go_source(code)
    spans_hold(code, found)
    assert found.generated and [(c.decl_kind, c.symbol, c.receiver) for c in found.chunks] == [("package_doc", "", ""), ("method", "Serve", "Server"), ("type", "Server", "")]
    serve = found.chunks[1]
    assert code[serve.byte_start :].startswith(b"// Serve says") and serve.imports_used == ["fmt", "net/http"] and serve.scope_path == "app > Server > Serve" and serve.exported
    assert chunking.chunk_file("go", b"not go\n")[0] == "line-window"


def test_python_source():
    code = b"import os\n\nX = 1\n\n@dec\ndef f():\n    return 1\n\nclass _C:\n    pass\n"
    assert [(c.decl_kind, c.symbol, c.exported) for c in chunking.python_source(code).chunks] == [("module", "", False), ("func", "f", True), ("class", "_C", False)]


def test_chunks_are_pure_and_verbatim(spark):
    random.seed(5)
    bits = ["# H\n", "## h2\n", "text text\n", "\n", "```py\n", "```\n", "- item\n", "  more\n", "> q\n", "| a |\n", "---\n", "é漢 words\n", "====\n"]
    files = [(f"f{i}.{e}", "".join(random.choices(bits, k=random.randint(0, 400))).encode()) for i in range(30) for e in ("md", "txt")]
    for _, data in files:
        for f in (chunking.markdown, chunking.line_window):
            spans_hold(data, f(data))
            assert f(data) == f(data)
    df = spark.createDataFrame([*files, ("x.bin", b"no"), ("nul.txt", b"a\0b"), ("bad.txt", b"\xff")], "path string, content binary")
    chunks = chunking.chunk_documents(df)
    assert corpus.span_errors(chunks, "path").count() == 0
    assert {r["path"] for r in chunks.select("path").distinct().collect()} <= {p for p, _ in files}
    broken = spark.createDataFrame([("d", 0, "abc", 0, 3, 1, 1), ("d", 2, "x", 0, 5, 2, 1)], "document_id string, ordinal int, content string, byte_start int, byte_end int, line_start int, line_end int")
    assert [r["error"] for r in corpus.span_errors(broken).collect()] == ["ordinal"]


def test_directory(spark, tmp_path):
    (tmp_path / "sub" / "vendor").mkdir(parents=True)
    for p, t in (("a.md", "# A"), ("sub/b.txt", "b"), ("sub/vendor/c.md", "c"), ("d.exe", "d")):
        (tmp_path / p).write_text(t)
    got = {r["path"]: (r["skip"], r["size"]) for r in tables.directory(spark, f"file:{tmp_path}").collect()}
    assert got == {"a.md": (None, 3), "sub/b.txt": (None, 1), "sub/vendor/c.md": ("excluded directory: vendor", 1), "d.exe": ("unroutable extension: .exe", 1)}


# ---- recall


def rows_for_weighing(spark, **more):
    base = {"request_id": 1, "id": 1, "content": "c", "subject": "x", "category": "note", "kind": "", "metadata": None, "cwd": "", "project": "", "hits": 1, "score": 1.0, "recent": None}
    row = base | more
    kinds = {"request_id": "int", "id": "long", "hits": "int", "score": "double", "recent": "array<string>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


@pytest.mark.parametrize(
    ("more", "score"),
    [
        ({}, 1.0),
        ({"metadata": '{"quality":"local:x"}'}, None),
        ({"subject": "session-activity"}, None),
        ({"kind": "trigger"}, None),
        ({"kind": "pattern"}, None),
        ({"kind": "pattern", "metadata": '{"surface":"project"}'}, 1.0),
        ({"kind": "summary", "project": "p"}, None),
        ({"kind": "summary"}, 1.0),
        ({"kind": "decision"}, 1.5),
        ({"kind": "invariant"}, 1.3),
        ({"subject": "sym:f"}, 0.2),
        ({"subject": "org/Repo", "project": "repo"}, 2.5),
        ({"subject": "other", "project": "repo"}, 0.3),
        ({"subject": "other", "project": "repo", "category": "preference"}, 1.0),
        ({"metadata": '{"surface":"project","project_path":"/a/b/"}', "cwd": "/a/b/c"}, 4.0),
        ({"metadata": '{"surface":"project","project_path":"/a/b"}', "cwd": "/a/bc"}, 1.0),
        ({"content": "see Main.go now", "recent": ["/x/main.go"]}, 1.3),
        ({"hits": 3}, 1.4),
    ],
)
def test_recall_rules(spark, more, score):
    got = recall.weighed(rows_for_weighing(spark, **more)).collect()
    assert [round(r["score"], 9) for r in got] == ([] if score is None else [score])


@pytest.mark.parametrize(("avg", "n", "want"), [(1.0, 1, 2**0.52), (1.0, 5, 2.0), (-1.0, 9, 0.5), (0.0, 0, 1.0)])
def test_feedback_factor(spark, avg, n, want):
    assert one(spark, recall.feedback_factor(F.lit(avg), F.lit(n))) == pytest.approx(want)


def test_recall_cut(spark):
    rows = [(1, i, f"content {i}", "s", "n", dt.datetime(2024, 1, 1), s, 5, 80) for i, s in ((1, 2.0), (2, 1.9), (3, 1.0), (4, 0.5), (5, 0.34))]
    df = spark.createDataFrame(rows, "request_id int, id long, content string, subject string, category string, created_at timestamp, score double, result_limit int, budget int")
    got = recall.selected(df).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["block"] == "[id=1] s | n | 2024-01-01\n  content 1\n"
    assert [r["id"] for r in recall.selected(df.withColumn("budget", F.lit(9999))).collect()] == [1, 2, 3]
    assert [r["id"] for r in recall.selected(df.withColumn("budget", F.lit(9999)).withColumn("result_limit", F.lit(1))).collect()] == [1]


def test_recall_triggers_and_seen(spark):
    f = facts(spark, [
        {"id": 1, "content": "load", "kind": "trigger", "metadata": '{"signal_type":"cwd_pattern","signal":"work/**","load_subsystem":"auth","load_kinds":["decision"]}'},
        {"id": 2, "content": "use tokens", "subsystem": "auth", "kind": "decision"}, {"id": 3, "content": "other", "subsystem": "auth"},
        {"id": 4, "content": "zebra facts here"}, {"id": 5, "content": "zebra again, said twice"}, *[{"id": i, "content": f"noise {i}"} for i in range(10, 30)],
    ])
    req = spark.createDataFrame([(1, "s1", "where is the zebra", "/home/work/src", ""), (2, "s2", "and of", "/home/work", "")], "request_id int, session_id string, prompt string, cwd string, project string")
    got = recall.recall(f, req, seen=spark.createDataFrame([("s1", 5)], "session_id string, id long"))
    assert sorted((r["request_id"], r["id"]) for r in got.collect()) == [(1, 2), (1, 4)]


def test_keywords_fall_back_to_longest(spark):
    req = spark.createDataFrame([(1, "tiny longest words longer")], "request_id int, prompt string")
    assert [r["word"] for r in recall.keywords(req, None).orderBy("place").collect()] == ["longest", "longer", "words", "tiny"]


# ---- extraction


@pytest.mark.parametrize(
    ("raw", "n"),
    [('[{"content":"a"},{"content":"b"}]', 2), ('{"content":"a"}', 1), ('{"facts":[{"content":"a"}]}', 1), ('Sure:\n```json\n[{"content":"]"}]\n```', 1), ("no json", 0), (None, 0), ("[1, 2]", 0), ('{"facts":[]}', 0)],
)
def test_answers(spark, raw, n):
    assert len(extract.parse_answer(raw)) == n
    rows = extract.candidates(spark.createDataFrame([(1, raw)], "answer_id int, raw string")).collect()
    assert len(rows) == n and all(r["category"] == "note" for r in rows)


def test_extraction_duplicates(spark):
    f = facts(spark, [{"id": 1, "content": "old", "subject": "s"}])
    new = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "a", "t"), (4, "old", "s")], "i int, content string, subject string")
    assert {r["i"]: r["action"] for r in extract.plan_extraction(new, f, ["i"]).collect()} == {1: "insert", 2: "duplicate", 3: "insert", 4: "duplicate"}


def test_replacements(spark):
    old = facts(spark, [
        {"id": 1, "content": "o", "embedding": [1.0, 0.0]}, {"id": 2, "content": "o", "embedding": [0.9, 0.1], "metadata": '{"p":"x"}'},
        {"id": 3, "content": "o", "subject": "t", "embedding": [1.0, 0.0]}, {"id": 4, "content": "o"},
    ])
    new = facts(spark, [{"id": 10, "content": "n", "embedding": [1.0, 0.01], "metadata": '{"p":"y"}'}, {"id": 11, "content": "n", "embedding": [1.0, 0.02]}, {"id": 12, "content": "n", "embedding": [0.0, 1.0]}]).withColumn("batch_index", (F.col("id") - 10).cast("int"))
    got = {(r["old_id"], r["new_id"]) for r in extract.replacements(new, old).collect()}
    # 10 takes 1 (2 conflicts); 11 is nearest to its batch-mate 10; 12 is near nothing.
    assert got == {(1, 10), (10, 11)}


def test_replacements_as_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vec = {i: rng.normal(size=3).astype("float32") for i in range(60)}
    old = facts(spark, [{"id": i, "content": "o", "subject": str(i % 3), "embedding": vec[i].tolist()} for i in range(40)])
    new = facts(spark, [{"id": i, "content": "n", "subject": str(i % 3), "embedding": vec[i].tolist()} for i in range(40, 60)]).withColumn("batch_index", (F.col("id") - 40).cast("int"))
    cos = lambda a, b: float(a.astype(float) @ b.astype(float) / np.linalg.norm(a.astype(float)) / np.linalg.norm(b.astype(float)))
    gone, want = set(), set()
    for i in range(40, 60):
        near = [(-cos(vec[i], vec[j]), j) for j in range(i) if j % 3 == i % 3 and j not in gone and cos(vec[i], vec[j]) >= 0.85]
        if near:
            gone.add(min(near)[1])
            want.add((min(near)[1], i))
    assert {(r["old_id"], r["new_id"]) for r in extract.replacements(new, old).collect()} == want and want


# ---- sessions


def test_transcript(spark):
    lines = [
        '{"type":"user","uuid":"u1","message":{"role":"user","content":"hello"}}', '{"type":"assistant","message":{"content":[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]}}',
        '{"type":"user","message":{"content":[{"type":"tool_result","text":"no"}]}}', '{"type":"system","message":{"content":"x"}}', "broken", '{"type":"assistant","message":{"content":"plain"}}', '{"type":"user","message":{"content":""}}', '{"type":"user","message":{"content":"bye"}}',
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, line_no int, value string")
    assert [(r["turn_index"], r["role"], r["content"]) for r in sessions.parse_transcript(df).orderBy("turn_index").collect()] == [(0, "user", "hello"), (1, "assistant", "a\nb"), (2, "user", "bye")]


def test_corpus_text_stops_at_the_first_that_does_not_fit(spark):
    turns = spark.createDataFrame([("s", 0, "user", "tiny"), ("s", 1, "user", "x" * 50), ("s", 2, "assistant", "last")], "session_id string, turn_index int, role string, content string")
    assert sessions.corpus_text(turns, total=60).first()["text"] == "[assistant]: last"
    assert sessions.corpus_text(turns).first()["text"].startswith("[user]: tiny\n---\n[user]: xxx")


def test_feedback_is_given_once(spark):
    fb = spark.createDataFrame([("1", "fact", "s", 1, None)], "ref_id string, ref_type string, session_id string, score int, reason string")
    new = spark.createDataFrame([("1", "fact", "s", -1, "x"), ("1", "fact", "t", -1, "x"), ("2", "fact", "s", 0, "x")], fb.schema)
    assert sorted((r["ref_id"], r["session_id"], r["score"]) for r in sessions.record_feedback(fb, new).collect()) == [("1", "s", 1), ("1", "t", -1)]


def test_recent_files_forget_after_a_pause(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("s", "old", t(1, 0)), ("s", "a", t(3, 0)), ("s", "b", t(3, 10)), ("s", "a", t(3, 20))]
    assert sessions.recent_files(spark.createDataFrame(rows, "session_id string, file string, ts timestamp")).first()["files"] == ["b", "a"]


def test_backfill(spark):
    inj = spark.createDataFrame([("s", "1", "fact", 0), ("s", "2", "fact", 1), ("rated", "1", "fact", 0)], "session_id string, ref_id string, ref_type string, rank int")
    turns = spark.createDataFrame([("s", 0, "user", "about one"), ("rated", 0, "user", "x")], "session_id string, turn_index int, role string, content string")
    fb = spark.createDataFrame([("9", "fact", "rated", 1)], "ref_id string, ref_type string, session_id string, score int")
    f = facts(spark, [{"id": 1, "content": "one"}, {"id": 2, "content": "two"}])
    got = sessions.backfill(inj, turns, fb, f, lambda content, text: F.when(F.contains(text, content), 1).otherwise(-1))
    assert {(r["ref_id"], r["score"]) for r in got.collect()} == {("1", 1), ("2", -1)}


# ---- context, tasks, tokens


def test_agents(spark):
    f = facts(spark, [{"id": 1, "content": "reviews security", "subsystem": "agent-routing", "metadata": '{"agent_name":"sec","domains":["Auth","security"]}'}, {"id": 2, "content": "writes docs", "subsystem": "agent-routing", "metadata": '{"agent_name":"doc","domains":["docs"]}'}, {"id": 3, "content": "x", "subsystem": "agent-routing"}])
    tasks = spark.createDataFrame([(1, "check auth security of docs")], "task_id int, task string")
    got = [(r["agent"], r["score"], r["confidence"]) for r in context.suggest_agents(f, tasks).orderBy("rank").collect()]
    assert got == [("sec", 7, "high"), ("doc", 4, "medium")]


def test_tasks(spark):
    new = context.new_tasks(spark.createDataFrame([("do it", "todo", "high", "")], "content string, subject string, priority string, due string")).first()
    assert new["kind"] == "task" and new["metadata"] == '{"surface":"task","status":"pending","priority":"high"}'
    f = facts(spark, [{"id": 1, "content": "c", "kind": "task", "metadata": new["metadata"]}])
    done = context.update_tasks(f, spark.createDataFrame([(1, "completed", "ok")], "id long, status string, note string"))
    assert done.first()["metadata"] == '{"note":"ok","priority":"high","status":"completed"}'
    assert context.update_tasks(f, spark.createDataFrame([(1, "odd", "")], "id long, status string, note string")).first()["metadata"] == new["metadata"]
    assert context.list_tasks(done).count() == 0 and context.list_tasks(done, "completed").count() == 1 and context.list_tasks(f).count() == 1


@pytest.mark.parametrize(("scopes", "want", "ok"), [(["admin"], "write", True), ([], "read", True), ([], "ingest", False), (["read"], "write", False), (["ingest"], "ingest", True), (["admin"], "ingest", False)])
def test_scopes(spark, scopes, want, ok):
    df = spark.createDataFrame([(scopes,)], "s array<string>")
    assert df.select(context.allows(F.col("s"), want).alias("x")).first()["x"] is ok


def test_curation(spark):
    c = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "rank int, id long")
    assert [r["id"] for r in context.curate(c, 2).orderBy("rank").collect()] == [10, 20]
    chosen = spark.createDataFrame([([30, 99, 10],)], "ids array<long>")
    assert [r["id"] for r in context.curate(c, 5, chosen).orderBy("rank").collect()] == [30, 10]


# ---- transfer and snapshots


def test_transfer(spark, tmp_path):
    f = facts(spark, [{"id": 5, "content": "a", "superseded_by": 900, "superseded_at": dt.datetime(2024, 2, 2), "use_count": 4}, {"id": 900, "content": "b"}, {"id": 1 << 40, "content": "c", "superseded_by": 12345}])
    users = spark.createDataFrame([(1, "ann")], "id long, name string")
    transfer.write_export(f, users, f"file:{tmp_path}/x")
    back = spark.read.json(f"file:{tmp_path}/x", schema=transfer.export_facts(f, users).schema)
    rows, ids = transfer.import_facts(facts(spark, []), back, owner=7, start=100)
    got = {r["content"]: r for r in rows.collect()}
    assert sorted(r["id"] for r in got.values()) == [101, 102, 103]
    assert got["a"]["superseded_by"] == got["b"]["id"] and got["a"]["superseded_at"] == dt.datetime(2024, 2, 2) and got["c"]["superseded_by"] is None
    assert got["a"]["user_id"] == 7 and got["a"]["use_count"] == 0
    again, _ = transfer.import_facts(f, back, owner=7, start=100)
    assert sorted(r["content"] for r in again.collect()) == ["a", "c"]  # replaced ones aren't active, so they aren't duplicates
    with pytest.raises(ValueError):
        transfer.import_facts(f, back.withColumn("version", F.lit(2)), 7, 0)


def test_kind_backfill(spark):
    f = facts(spark, [{"id": 1, "content": "a", "metadata": '{"kind":"decision"}'}, {"id": 2, "content": "b", "kind": "pattern", "metadata": '{"kind":"decision"}'}])
    assert {r["id"]: r["kind"] for r in transfer.backfill_kind(f).collect()} == {1: "decision", 2: "pattern"}


def test_owner_backfill(spark):
    f = facts(spark, [{"id": 1, "content": "a", "subject": "ann", "user_id": None}, {"id": 2, "content": "b", "subject": "ann", "category": "identity"}])
    assert {r["id"]: (r["user_id"], r["subject"]) for r in transfer.backfill_owner(f, 5, "ann").collect()} == {1: (5, ""), 2: (1, "ann")}


def test_snapshots_change_together(spark, tmp_path):
    s = tables.Snapshots(spark, f"file:{tmp_path}/store")
    assert s.commit(docs=spark.range(2), chunks=spark.range(3)) == 1
    assert s.commit(docs=spark.range(5)) == 2
    assert s.read("docs").count() == 5 and s.read("chunks").count() == 3 and s.read("docs", 1).count() == 2
    with pytest.raises(KeyError):
        s.read("none")


def test_partitioning_changes_nothing(spark):
    f = facts(spark, [{"id": i, "content": f"alpha {'beta ' * (i % 3)}", "confirmed_count": i % 2} for i in range(40)])
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    rows = [[tuple(r) for r in search.search(f.repartition(n), q, search.SearchOptions(max_results=5), lexical_only=True).orderBy("rank").collect()] for n in (1, 8)]
    assert rows[0] == rows[1] and len(rows[0]) == 5
