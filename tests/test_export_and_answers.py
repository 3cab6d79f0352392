"""An export deals no facts by their user; answers are parsed in slices of a bounded size."""

import json

import pyarrow as pa

from tessera.operators import extract
from tessera.plans import fixtures as fx
from tessera.plans import store_queries
from tessera.sources import transfer

SF = "/root/testdata/sf0.001"


def test_export_deals_nothing_by_user(spark, monkeypatch):
    few = transfer.export_facts(fx.facts(spark, SF), store_queries.users(spark))
    monkeypatch.setattr(transfer, "FEW_USERS", 0)
    many = transfer.export_facts(fx.facts(spark, SF), store_queries.users(spark))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) != []
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


RAW = ['[{"content": "a"}, 7, {"content": "b", "subject": 3}]', None, "nothing", "x" * 50 + '{"content": " c ", "category": "k"}', '{"n": 1, "facts": [{"content": ""}, {"content": "d"}]}'] * 20


def test_slices_of_answers():
    given = pa.RecordBatch.from_pydict({"answer_id": pa.array(range(len(RAW)), pa.int64()), "raw": pa.array(RAW)})
    want = [(i, at, json.dumps({k: v if isinstance(v, str) else None for k in ("content", "subject", "category") for v in (f.get(k),)})) for i, r in enumerate(RAW) for at, f in enumerate(extract.parse_answer(r))]
    old, extract.SLICE_BYTES = extract.SLICE_BYTES, 100
    try:
        parts = list(extract.parsed(iter([given, given.slice(0, 0)])))
    finally:
        extract.SLICE_BYTES = old
    assert len(parts) > 20 and max(p.num_rows for p in parts) <= 6
    assert [(r["answer_id"], r["at"], json.dumps({k: r[k] for k in ("content", "subject", "category")})) for p in parts for r in p.to_pylist()] == want


def test_candidates_keep_ids_of_any_kind(spark):
    rows = spark.createDataFrame([("q", RAW[0]), (None, RAW[3]), ("r", None)], "answer_id string, raw string")
    assert sorted(map(repr, map(tuple, extract.candidates(rows).select("answer_id", "at", "content", "subject", "category").collect()))) == ["('q', 0, 'a', '', 'note')", "('q', 1, 'b', '', 'note')", "(None, 0, 'c', '', 'k')"]
