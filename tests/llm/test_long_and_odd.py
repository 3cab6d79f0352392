"""Very long texts, ties, repeated rows and odd records in operators 9 and 10 and in the pipeline's stages."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, langid, ppm

from . import brute

SF = "/root/testdata/sf0.001"


def test_ppm_of_long_texts(spark):
    random.seed(40)
    words = ["the", "of", "théâtre", "zz\x00z", "And"]
    rows = [(i, " ".join(random.choices(words, k=n))) for i, n in enumerate([9000, 3, 0, 4000, 1, 2000])] + [(50, "a" * 60_000), (51, "ab" * 20_000)]
    want = brute.ppm(rows)
    got = {r["doc_id"]: tuple(r) for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), langid.remainder("doc_id", 5) == 1).collect()}
    assert got.keys() == want.keys()
    for d, r in want.items():
        assert got[d][:5] == r[:5] and got[d][5:] == pytest.approx(r[5:], rel=1e-9, abs=1e-9)


def test_ppm_in_small_slices(spark, monkeypatch):
    """Slices of text and many parts change nothing; contexts of three bytes are whole in a part."""
    monkeypatch.setattr(ppm, "SLICE", 50)
    random.seed(41)
    rows = [(i, "".join(random.choices("abé \x00", k=random.randint(0, 90)))) for i in range(80)]
    want = brute.ppm(rows)
    for n in (1, 7):
        got = {r["doc_id"]: tuple(r) for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), langid.remainder("doc_id", 5) == 1, partitions=n).collect()}
        for d, r in want.items():
            assert got[d][:5] == r[:5] and got[d][5:] == pytest.approx(r[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("record", ["", "{}", "[]", "null", "7", '"text"', "{bad", None, '{"messages":[]}', '{"messages":[{"role":"user","content":"a"},{"role":"user","content":[{"type":"text","text":"b"}]}]}'])
def test_records_of_no_known_layout(spark, record):
    rows = spark.createDataFrame([(1, record), (1, record)], "id int, record string").withColumns({"r": F.lit("clash"), "turns": F.lit("clash")})
    got = chat.canonical_turns(rows).collect()
    assert len(got) == 2 and all(r["turns"] is None and r["id"] == 1 for r in got)
    assert chat.canonical_turns(rows.limit(0)).collect() == []


def test_messages_in_parts(spark):
    record = '{"messages":[{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image","text":"x"},{"type":"text","text":" you"}]},{"role":"assistant","content":[{"type":"text","text":"yo"}]}]}'
    r = chat.canonical_turns(spark.createDataFrame([(1, record)], "id int, record string")).first()
    assert [tuple(t) for t in r["turns"]] == [("user", "hi you"), ("assistant", "yo")]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_long_texts_and_ties(spark, stage):
    random.seed(42)
    words = ["the", "letter", "came", "with", "a", "house", "of", "many", "other", "things", "and", "people"]
    prose = lambda n: " ".join(random.choices(words, k=n))
    one = prose(60)
    rows = [(1, prose(40_000)), (2, "x" * 300_000), (3, one), (4, one), (4, one), (5, one + " more"), (6, "the " * 20_000), (7, prose(50) + " a@b.co"), (8, "\n" * 5000 + prose(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("node", "component_id", "lang_pred", "base", "n_tokens", "item_id")})
    left = {r["doc_id"] for r in stage(spark, docs, SF).collect()}
    kept = {i for i, _ in rows}
    if stage is corpus_pipeline.near_duplicates:
        kept -= {4, 5}
    assert left == kept


def test_stage_two_follows_five_words_and_80(spark):
    """100 words, two changed apart: five-word similarity 86 / 106, and three changed apart: 81 / 111."""
    a = [f"w{i}" for i in range(100)]
    text = lambda *changed: " ".join("x" if i in changed else w for i, w in enumerate(a))
    rows = [(1, text()), (2, text(30, 60)), (3, "other " + text(20, 50, 80).replace("w", "v")), (4, text(20, 50, 80).replace("w", "v")), (5, text().replace("w", "u")), (6, text(20, 50, 80).replace("w", "u"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3, 5, 6}
