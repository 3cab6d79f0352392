"""Language references of operator 1: the exact common words, whatever the tasks and however flat the vocabulary."""

from collections import Counter

import pytest

from tessera.llm import quality


def plain(rows):
    counts = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(text.encode().split())
    return {x: sorted(c.items(), key=lambda p: (-p[1], p[0]))[: quality.COMMON] for x, c in counts.items()}


@pytest.mark.parametrize("remembered", [50, 200_000])
def test_common_words_of_flat_vocabularies(spark, monkeypatch, remembered):
    """Words that are rare in every task are common all the same; ties go by bytes."""
    monkeypatch.setattr(quality, "REMEMBERED", remembered)
    rows = [("a", " ".join(f"w{(i * 37 + k) % 3000}" for k in range(100))) for i in range(300)]
    rows += [("b", "x y x"), ("c", ""), ("d", None), (None, "none"), ("a", "extra extra")]
    got = quality.references(spark.createDataFrame(rows, "lang string, text string").repartition(16))
    want = plain(rows)
    assert got["langs"] == ["a", "b", "c"]
    for lang, words, shares in zip(got["langs"], got["words"], got["shares"], strict=True):
        assert words == [w for w, _ in want[lang]]
        total = sum(len(t.split()) for x, t in rows if x == lang)
        assert [round(s * total) for s in shares[: len(words)]] == [n for _, n in want[lang]]
        assert shares.sum() == pytest.approx(1 if total else 0)


def test_many_small_tasks(spark):
    """64 tasks of 200 words that occur once: the first 100 by their bytes are the common ones."""
    df = spark.range(64 * 200).selectExpr("'en' as lang", "concat('word', id) as text").repartition(64)
    got = quality.references(df)
    assert got["words"] == [sorted(b"word%d" % i for i in range(64 * 200))[: quality.COMMON]]
    assert got["shares"][0][-1] == pytest.approx(1 - quality.COMMON / (64 * 200))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 3)
    df = spark.range(4).selectExpr("cast(id as string) as lang", "'some words' as text")
    with pytest.raises(ValueError, match="more than 3 languages"):
        quality.references(df)
    assert len(quality.references(df.where("lang <> '0'"))["langs"]) == 3
