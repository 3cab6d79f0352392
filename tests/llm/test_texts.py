"""Operators whose rows each stand alone: 1, 2, 3, 5, 7, 8, 10."""

import math
import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, langid, pii, quality, tokencount
from tessera.llm.queries import op5_language, oracle_sql, queries, vocabulary_file

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "x" * 30_000, "a b " * 20_000, "ß İ Σς é é  　 \x85 👩‍👩", "<|endoftext|> mid<|startoftext|>", "'s 'll don't 12³", "▁ ▁▁x  y ", "</s><0x0A>"]


def frame(spark, texts, more=""):
    """Rows with repeated and null ids, and columns whose names clash with what operators add."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0] if texts else None), (None, "null id")] * bool(texts)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("bucket", "tie", "n_tokens", "score", "part", "node", "component", "lang_pred", "token", "base", "n")})


def documents(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_bpe_as_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    random.seed(1)
    bits = ["'s", "'", "!", "A", "ß", "İ", "Σ", "ς", "́", "é", "e", "1", "²", " ", "\n", "<|endoftext|>", "<|", "|>", "한", "ᄀ", "ᅡ", "_", "'ll", "hello"]
    texts = ODD + ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(500)] + documents(spark)
    got = bpe.encode_documents(frame(spark, texts), vocabulary_file("word_bpe_49k.json"), digest=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is None:
            continue
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        ids = b"".join(i.to_bytes(4, "little") for i in want.ids)
        decoded = library.decode(want.ids, skip_special_tokens=False)
        assert (r["n_tokens"], bytes(r["token_ids"]), r["decoded"]) == (len(want.ids), ids, decoded)
        assert (r["ids_sha256"], r["decoded_sha256"]) == (brute.sha(ids), brute.sha(decoded))


def test_token_counts_as_the_library(spark):
    import sentencepiece

    model = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    random.seed(2)
    texts = ODD + ["".join(random.choices(["▁", " ", "  ", "a", "the", "é", "\n", "<s>", "\t", "\x00", "한"], k=random.randint(0, 12))) for _ in range(500)] + documents(spark)
    for r in tokencount.count_tokens(frame(spark, texts), model, limit=10).collect():
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            n = len(library.encode(t))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 10)


def test_quality(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    reference = quality.references(df)
    assert reference["langs"] == ["de", "en", "es", "fr"] and b"the" in reference["words"][1][:3]
    got = {r["doc_id"]: r for r in quality.judge(df, reference).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for r in df.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute.base_counts(r["text"])
    fair = [(labels[d], g["kept"]) for d, g in got.items() if d in labels and not g["base_failed"]]
    assert all(kept for q, kept in fair if q) and sum(kept for q, kept in fair if not q) <= 0.1 * sum(not q for q, _ in fair)


def test_quality_odd(spark):
    df = frame(spark, ODD)
    nothing = quality.references(df.withColumn("lang", F.lit(None).cast("string")))
    assert nothing["langs"] == []
    for reference in (nothing, quality.references(df.withColumn("lang", F.lit("xx")))):
        got = quality.judge(df, reference).collect()
        assert len(got) == len(ODD) + 2
        assert all(r["kept"] is False for r in got if r["base_failed"])
        for r in got:
            if r["doc_id"] is not None:
                assert tuple(r)[1:7] == brute.base_counts(ODD[r["doc_id"]])
    assert quality.judge(df.limit(0), nothing).collect() == []


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_language(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_sums_all_segmentations():
    pieces = langid.pieces_of(vocabulary_file("piece_bpe_32k.model"))
    import numpy as np

    rng = np.random.default_rng(0)
    p = np.r_[rng.random((pieces.n + 1, 2)) * 0.01, np.zeros((1, 2))]
    for word in ("▁hello", "▁ñandú", "▁日本", "▁ﻼx"):
        def total(rest):
            if not rest:
                return np.ones(2)
            out = np.zeros(2)
            for d in range(1, min(len(rest), langid.LONGEST) + 1):
                k = pieces.number.get(rest[:d]) if hasattr(pieces, "number") else int(pieces.numbers(np.array([pieces.hash(rest[:d])], np.uint64))[0])
                if d == 1 and k > pieces.n:
                    k = pieces.n
                if k <= pieces.n:
                    out = out + p[k] * total(rest[d:])
            return out

        assert np.allclose(langid.forward(pieces.lattice([word]), p)[-1, 0], total(word), rtol=1e-9)


def test_language_odd(spark):
    model = vocabulary_file("piece_bpe_32k.model")
    df = frame(spark, [*ODD, "hello there", "12 34"]).withColumn("lang", F.when(F.col("text").contains("hello"), "en"))
    trained = langid.train(df, model)
    got = {r["doc_id"]: r for r in langid.identify(df, model, trained).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[len(ODD) + 1]["lang_pred"] == "und" and got[0]["score"] == 0
    assert got[len(ODD)]["lang_pred"] == "en"
    empty = langid.train(df.limit(0), model)
    assert empty[0] == [] and {r["lang_pred"] for r in langid.identify(df, model, empty).collect()} == {"und"}


def test_leaks(spark):
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 7)))
    items = [[word() for _ in range(n)] for n in (3, 6, 8, 11, 25, 40, 59)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for changed in (0, 1, 2):
            t = list(item)
            for k in range(changed):
                t[(k * 7 + 3) % len(t)] = word()
            w = min(20, len(item))
            agree = max(sum(a == b for a, b in zip(item[s : s + w], t[s : s + w], strict=True)) for s in range(len(item) - w + 1))
            if len(item) >= 6 and agree >= 0.8 * w:
                want.add((len(docs), i))
            docs.append(" ".join([word() for _ in range(30)] + [x.upper() + "," for x in t] + [word() for _ in range(30)]))
    clean = [" ".join(word() for _ in range(80)) for _ in range(10)] + ODD
    df, bench = frame(spark, docs + clean), spark.createDataFrame([*enumerate(map(" ".join, items)), (90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).where("doc_id is not null").collect()}
    assert got == want
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {None, *range(len(docs + clean))} - {d for d, _ in want}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0


def test_masks_miss_nothing():
    """Whatever places disagree, some mask fits between them."""
    for w in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        masks = decontaminate.MASKS if w == decontaminate.WINDOW else decontaminate.SHORT_MASKS
        fits = [sum(1 << (p + k) for k, c in enumerate(m) if c == "1") for m in masks for p in range(w - len(m) + 1)]
        for wrong in combinations(range(w), w - math.ceil(decontaminate.AGREE * w)):
            bits = sum(1 << i for i in wrong)
            assert any(not f & bits for f in fits)


def test_leaks_in_slices(spark, monkeypatch):
    df, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4000)
    assert sorted(map(tuple, decontaminate.leaks(df, bench).collect())) == whole and whole


def test_pii_base_spans(spark):
    random.seed(2)
    bits = ["a", "b.", "@", ".", "x.co", "1", "12", "255", "256", "0", "00", " ", "-", "+", "(", ")", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "+1 (415) 555-2671", "8.8.8.8", "a@b.co", "_", "%", "\n", 'token = "', "0123456789abcdef0123456789abcdef"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(1500)]
    texts += [None, "a" * 50_000, "1" * 50_000, "1 " * 30_000, "a@b." * 20_000, "+1" + " " * 50_000, "1." * 30_000, "x@y.zz " * 3000]
    df = frame(spark, texts)
    model = pii.train(df)
    for r in pii.find_spans(df, model).collect():
        if r["doc_id"] is not None:
            assert [tuple(s) for s in r["base"]] == brute.pii(texts[r["doc_id"]])
    assert pii.train(df.limit(0)) == {} and pii.find_spans(df.limit(0), {}).count() == 0


def test_pii_adds_secrets_and_redacts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs)
    some = spark.createDataFrame([(1, 'see token = "0123456789abcdef0123456789abcdef01234567" and a@b.co end'), (2, "an innocent_long_identifier_name here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_spans(some, model).withColumn("clean", pii.redacted(F.col("searched"), F.array_sort(F.concat("base", "added")))).withColumn("spans", pii.listed(F.array_sort(F.concat("base", "added")))).collect()}
    assert got[1]["spans"] == "secret:13:53,email:59:65" and got[1]["clean"] == 'see token = "[SECRET]" and [EMAIL] end'
    assert got[2]["spans"] == "" and got[3]["clean"] == ""


def test_pii_expectation_maximisation():
    # Labelers that mostly agree: agreement decides, and one that contradicts the others is outvoted.
    chance = pii.reliabilities({"yyyy": 500, "nnnn": 400, "ynyy": 20, "nynn": 20, "----": 1})
    assert chance["yyyy"] > 0.99 and chance["nnnn"] < 0.01 and chance["ynyy"] > 0.5 > chance["nynn"]


def test_chat_reads_back(spark):
    random.seed(6)
    bits = ["\\", "#", "###", "### user: ", "</turn>", " </turn>\n", ":", ": ", "\n", "h", "c", "o", "n", "é", "😀", "x"]
    turns = [(i % 40, i // 40, random.choice(["user", "assistant", "system", "a: b\n", None]), random.choice([None, "".join(random.choices(bits, k=random.randint(0, 9)))])) for i in range(600)]
    turns += [(7, 1, "user", "again"), (None, 0, "assistant", "no id"), (5, None, "user", "no turn")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    formatted = chat.format_chats(chat.turns_of_rows(rows))
    for r in formatted.withColumn("turns", chat.read_back(F.col("formatted"))).collect():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in turns if c == r["id"]])
        assert [tuple(t) for t in r["turns"]] == [(role, text) for _, role, text in own]
        assert len(r["loss_spans"]) == sum(role == "assistant" for _, role, _ in own)
    assert chat.format_chats(chat.turns_of_rows(rows.limit(0))).count() == 0


def test_chat_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    r = chat.format_chats(chat.turns_of_rows(rows)).first()
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == [f"text {i}" for i in range(1, 3000, 2)]


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, SF)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', [("user", "hi"), ("assistant", "yo")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"z"}]}', [("user", "q"), ("assistant", "z")]),
        ('{"output":"b","instruction":"a","input":""}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"prompt":"p","completion":null}', [("user", "p"), ("assistant", None)]),
        ('{"unknown":1}', None),
        ("{bad", None),
        (None, None),
    ],
)
def test_layouts(spark, record, turns):
    r = chat.canonical_turns(spark.createDataFrame([(1, record)], "id int, record string")).first()
    assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns
