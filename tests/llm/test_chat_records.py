"""Field paths of chat records, and layouts that depend on them (operator 10)."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"prompt": "[1, 2] what is this", "response": "r"}, [("user", "[1, 2] what is this"), ("assistant", "r")]),
        ({"prompt": "[]", "response": "[{}]"}, [("user", "[]"), ("assistant", "[{}]")]),
        ({"prompt": '{"a": 1}', "response": "{b"}, [("user", '{"a": 1}'), ("assistant", "{b")]),
        ({"prompt": {"a": 1}, "response": "r"}, None),
        ({"messages": [{"role": "user"}, {"role": "assistant", "content": "yo"}]}, [("user", None), ("assistant", "yo")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b", "name": "n"}]}, None),
        ({"messages": [{"role": "user", "content": "[x"}, {"role": "assistant", "content": '{"y": []}'}]}, [("user", "[x"), ("assistant", '{"y": []}')]),
    ],
)
def test_turns_follow_types_not_texts(spark, record, turns):
    r = chat.canonical_turns(spark.createDataFrame([(1, json.dumps(record))], "id int, record string")).first()
    assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns


@pytest.mark.parametrize(
    ("record", "paths"),
    [
        ({"a": {"b": [{"c": 1}, {"d": [[{"e": None}]]}], "f": {}}, "g": []}, ["a.b[].c", "a.b[].d[][].e", "a.f", "g[]"]),
        ({"a": 1.5, "b": True, "c": 10**20, "d": None}, ["a", "b", "c", "d"]),
        ({"x y": 1, "p.q": {"`r`: s": "t"}, "ARRAY<": 1, "é>": [1, "m"], "": 1, "1": {"OBJECT": 2}}, ["", "1.OBJECT", "ARRAY<", "p.q.`r`: s", "x y", "é>[]"]),
        ({}, [""]),
        ([{"a": 1}, {"b": 2}], ["[].a", "[].b"]),
        ("text", [""]),
    ],
)
def test_record_paths(spark, record, paths):
    row = spark.createDataFrame([(json.dumps(record),)], "record string")
    assert row.select(chat.record_paths(F.try_parse_json("record")).alias("p")).first()["p"] == sorted(paths)


def test_later_messages_count(spark):
    """Messages that differ only after the first have different fingerprints; the order of fields has no part in them."""
    rows = [(1, '{"m":[{"a":1},{"a":2}]}'), (2, '{"m":[{"a":1},{"a":2,"b":3}]}'), (3, '{"m":[{"b":3,"a":2}]}')]
    got = {r["id"]: r["fingerprint"] for r in chat.canonical_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    assert got[1] != got[2] == got[3]
