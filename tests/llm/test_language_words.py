"""Whole words and whole vocabulary in language identification (operator 5), against plain sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import vocabulary_file


@pytest.fixture(scope="module")
def pieces():
    return langid.pieces_of(vocabulary_file("piece_bpe_32k.model"))


def number(pieces, piece):
    k = int(pieces.numbers(np.array([pieces.hash(piece)], np.uint64))[0])
    return pieces.n if len(piece) == 1 and k > pieces.n else k


def plain_sums(pieces, word, p):
    """Logarithm of the sum over all segmentations and expected uses, by exact integers' logarithms of prefixes and suffixes."""
    n = len(word)
    cuts = [(i, j, k) for j in range(1, n + 1) for i in range(max(0, j - pieces.longest), j) if (k := number(pieces, word[i:j])) <= pieces.n]
    into, out = {}, {}
    for c in cuts:
        into.setdefault(c[1], []).append(c)
        out.setdefault(c[0], []).append(c)
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    a, b = {0: 0.0}, {n: 0.0}
    for j in range(1, n + 1):
        a[j] = add([a[i] + math.log(p[k]) for i, _, k in into[j]])
    for i in range(n - 1, -1, -1):
        b[i] = add([math.log(p[k]) + b[j] for _, j, k in out[i]])
    use = Counter()
    for i, j, k in cuts:
        use[k] += math.exp(a[i] + math.log(p[k]) + b[j] - a[n])
    return a[n], use


def test_every_letter_piece_counts(pieces):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    names = {x.lower() for x in names if x.lstrip("▁").isalpha() or x == "▁"}
    assert pieces.n == len(names) and pieces.longest == max(map(len, names)) > 8
    assert len({number(pieces, x) for x in names}) == len(names)


@pytest.mark.parametrize("size", [1, 5, 31, 32, 33, 70, 400])
def test_words_of_any_length(pieces, monkeypatch, size):
    random.seed(size)
    monkeypatch.setattr(langid, "BLOCK", 64)
    p = np.r_[np.random.default_rng(1).random(pieces.n + 1) * 0.01 + 1e-6, 0.0]
    words = ["".join(random.choices(["international", "e", "t", "ñ", "ness", "日", "ﻼ"], k=size))[:size] for _ in range(3)]
    want = [plain_sums(pieces, "▁" + w, p) for w in words]
    scorer = langid.Scorer(pieces, p[:, None])
    got = scorer.scores(words)
    assert [s[0] for s in got] == pytest.approx([w for w, _ in want], rel=1e-9)
    counted = Counter(dict(zip(words, (1, 2, 3), strict=True)))
    use, total = langid.expected(pieces, counted, p), Counter()
    for w, n in counted.items():
        for k, x in plain_sums(pieces, "▁" + w, p)[1].items():
            total[k] += n * x
    for k, x in total.items():
        if k < pieces.n:
            assert use[k] == pytest.approx(x, rel=1e-6, abs=1e-12)


def test_very_long_word(pieces):
    p = np.r_[np.full(pieces.n + 1, 1e-4), 0.0][:, None].repeat(2, 1)
    p[:, 1] /= 10
    s = langid.Scorer(pieces, p).scores(["x" * 200_000, None, "½ ² 12"])
    assert np.isfinite(s[0]).all() and s[0][0] > s[0][1] and s[1] is None and s[2] is None


def test_numerals_are_no_letters(spark):
    texts = ["²", "½", "〇 Ⅷ", "12 ½", "", None, "a²b", "日本", "ª"]
    model = vocabulary_file("piece_bpe_32k.model")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = langid.train(spark.createDataFrame([("en", "some words here"), ("de", "und Worte da"), ("xx", "12"), (None, "no language")], "lang string, text string"), model)
    assert trained[0] == ["de", "en", "xx"]
    got = {r["doc_id"]: r for r in langid.identify(df, model, trained).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(9)] == [True] * 6 + [False] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and langid.words_of("a²b") == ["a", "b"]
    assert langid.identify(df.limit(0), model, trained).count() == 0


def test_training_as_plain_sums(spark, pieces):
    """Two rounds over a small corpus, and predictions, by plain sums in Python."""
    random.seed(4)
    words = {"en": ["the", "internationalisation", "of", "x" * 40, "there"], "de": ["und", "Donaudampfschifffahrtsgesellschaft", "die", "straße"]}
    rows = [(i, lang, " ".join(random.choices(words[lang], k=12))) for i in range(8) for lang in words]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("word", F.lit("clash"))
    model = vocabulary_file("piece_bpe_32k.model")
    langs, p = langid.train(df, model)
    for column, lang in enumerate(langs):
        counts = Counter(w for _, x, t in rows if x == lang for w in t.lower().split())
        q = [1 / pieces.n] * pieces.n + [langid.UNKNOWN, 0.0]
        for _ in range(2):
            use = Counter()
            for w, n in counts.items():
                for k, x in plain_sums(pieces, "▁" + w, q)[1].items():
                    use[k] += n * x
            total = sum(x for k, x in use.items() if k < pieces.n)
            q = [max(use[k] / total, langid.FLOOR) for k in range(pieces.n)] + [langid.UNKNOWN, 0.0]
        assert p[:, column].tolist() == pytest.approx(q, rel=1e-6)
    texts = ["the und of", "straße there", "xyzzy"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, (langs, p)).collect()
    for r in got:
        logs = [sum(plain_sums(pieces, "▁" + w, p[:, k])[0] for w in texts[r["doc_id"]].split()) for k in range(len(langs))]
        k = logs.index(max(logs))
        assert r["lang_pred"] == langs[k] and r["score"] == pytest.approx(1 / sum(math.exp(x - logs[k]) for x in logs), rel=1e-6)
