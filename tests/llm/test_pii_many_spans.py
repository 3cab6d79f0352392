"""Operator 8 and its redaction on texts with very many spans, and the pipeline's stage with added spans, against plain versions."""

import time

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii

from .test_pii_spans import spans, texts, trained

SF = "/root/testdata/sf0.001"
NAMES = [f"[{k.upper()}]" for k in pii.BASE + pii.ADDED]


def redact(text, found):
    out, at = "", 0
    for start, rank, end in found:
        if start >= at:
            out += text[at:start] + NAMES[rank]
        at = max(at, end)
    return out + text[at:]


def test_redaction_of_odd_texts(spark):
    some = [t * k if t else t for k in (1, 400) for t in texts(60)]
    model = trained(texts(1200))
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = pii.find_spans(df, model).withColumn("all", F.array_sort(F.concat("base", "added")))
    n = 0
    for r in found.select("doc_id", "all", pii.redacted(F.col("searched"), F.col("all")).alias("clean")).collect():
        t = some[r["doc_id"]] or ""
        base, added = spans(t, model)
        assert [tuple(s) for s in r["all"]] == sorted(base + added)
        assert r["clean"] == redact(t, sorted(base + added))
        n += len(added)
    assert n > 1000 and max(len(t or "") for t in some) > 5 * pii.PIECE


def test_a_hundred_thousand_spans(spark):
    one = "\u00e9 a@b.co token = AbCdEf0123456789XyZ01 call (415) 555-2671\n"
    n = 33_400
    df = spark.createDataFrame([(1, one * n)], "doc_id long, text string")
    model = trained(texts(1200))
    base, added = spans(one, model)
    assert len(base) == 1 and len(added) == 2
    begun = time.time()
    pii.find_spans(df, model).select(F.size("base"), F.size("added")).collect()
    print(round(time.time() - begun, 1), "s to find them")
    begun = time.time()
    r = pii.find_spans(df, model).withColumn("all", F.array_sort(F.concat("base", "added"))).select(pii.redacted(F.col("searched"), F.col("all")).alias("clean"), F.size("all").alias("n")).first()
    print(round(time.time() - begun, 1), "s to find and redact")
    assert r["n"] == 3 * n and r["clean"] == redact(one, sorted(base + added)) * n


def test_stage_redacts_added_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = [(100_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts(300))]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    some = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = trained(list(some.values()))
    seen = 0
    for r in corpus_pipeline.without_personal_data(spark, docs, SF).collect():
        t = some.pop(r["doc_id"])
        base, added = spans(t or "", model)
        assert r["text"] == (None if t is None else redact(t, sorted(base + added)))
        seen += len(added) > 0 and "token = " in t
    assert seen > 10 and not some
