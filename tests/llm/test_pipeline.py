import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, pii
from tessera.llm.bpe import vocabulary
from tessera.llm.queries import vocabulary_file

from . import brute

SF = "/root/testdata/sf0.001"


def test_run_as_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = vocabulary_file("piece_bpe_32k.model")
    known = {r["doc_id"] for r in langid.identify(docs, model, langid.train(docs, model)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    stay = {d for d, (_, _, c) in brute.near_duplicates([(d, texts[d]) for d in sorted(known)], 5, 80).items() if d == c}
    seeds = decontaminate.Seeds([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {d for d in stay if not seeds.leaks([texts[d]])[0]}
    vocab = vocabulary(vocabulary_file("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean and len(clean) < len(texts)
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    for d, r in got.items():
        t, at, out = texts[d], 0, ""
        for start, rank, end in brute.pii(t):
            if start >= at:
                out += t[at:start] + names[rank]
            at = max(at, end)
        out += t[at:]
        if "token = " not in t:
            assert bytes(r["token_ids"]) == vocab.encode(out)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, stage):
    rows = [(1, "a plain text of some words", "en", "s", 26), (1, "a plain text of some words", "en", "s", 26), (2, None, None, None, None), (3, "", "en", None, 0), (None, "another text without an id", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    out = stage(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS or stage is corpus_pipeline.tokens
    left = out.collect()
    assert any(r["doc_id"] is None for r in left) and any(r["doc_id"] == 1 for r in left)
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert pii.BASE
