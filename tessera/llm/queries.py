"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontaminate, jaccard, langid, minhash, negatives, pii, ppm, quality, suffix, tokencount
from tessera.session import ship

from .common import documents
from .sql import LAYOUTS_SQL, OP1_SQL, OP4_SQL, OP6_SQL, OP7_SQL, OP10_SQL, OP11_SQL, OP12_SQL, OP13_SQL


def vocabulary_file(name: str) -> bytes:
    """Content of a public vocabulary file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.judge(docs, quality.references(docs))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"), ids=False, digest=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary_file("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), texts=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = documents(spark, sf_dir), vocabulary_file("piece_bpe_32k.model")
    held_out = langid.remainder("doc_id", 3) == 1
    trained = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))), model)
    return langid.identify(docs, model, trained).select("doc_id", F.coalesce(langid.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), shingle=jaccard.SHINGLE, level=jaccard.LEVEL)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find_spans(docs, pii.train(docs))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    n = [count(r).alias(f"n_{k}") for r, k in enumerate(pii.BASE)]
    return found.select("doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), langid.remainder("doc_id", 5) == 1)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = chat.format_chats(chat.turns_of_rows(rows.unionByName(one)))
    chats = chats.withColumn("turns", chat.read_back(F.col("formatted")))
    # The text under the mask, cut out of the formatted text by its spans.
    under = F.transform("loss_spans", lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    chats = chats.withColumn("loss", F.array_join(F.transform(under, chat.unescaped), ""))
    return chats.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=3, level=85)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a JSON record in one of seven layouts, the last of them unknown, brought to canonical turns by the records' fingerprints."""
    chats = chat.turns_of_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))

    def each(*fields):
        return F.to_json(F.struct(F.transform("turns", lambda t: F.struct(*[make(t).alias(name) for name, make in fields[1:]])).alias(fields[0])))

    def said(i: int):
        return F.coalesce(F.get("turns", F.lit(i))["text"], F.lit(""))

    role, text = (lambda t: t["role"]), (lambda t: t["text"])
    speaker = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
    cut = lambda t: F.array(F.struct(F.lit("text").alias("type"), F.substring(t["text"], 1, 5).alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), t["text"].substr(F.lit(6), F.lit(1 << 30)).alias("text")))
    records = [
        each("messages", ("role", role), ("content", text)),
        each("turns", ("text", text), ("role", role)),
        each("conversations", ("from", speaker), ("value", text)),
        F.to_json(F.struct(said(1).alias("response"), said(0).alias("prompt"))),
        F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))),
        each("messages", ("role", role), ("content", cut)),
        each("dialogue", ("who", role), ("what", text)),
    ]
    kind = F.pmod("id", F.lit(len(records)))
    record = F.coalesce(*[F.when(kind == k, r) for k, r in enumerate(records)])
    got = chat.canonical_turns(chats.select("id", record.alias("record")))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(F.col("id").alias("conv_id"), F.when(F.col("turns").isNotNull(), F.size("turns")).cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe, op3_token_counts, op4_suffix_dedup, op5_language, op6_jaccard, op7_decontaminate, op8_pii, op9_ppm, op10_chat, op11_hard_negatives, op12_minhash, op13_clusters, chat_layouts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op4_suffix_dedup": OP4_SQL, "op6_jaccard": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_chat": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_minhash": OP12_SQL, "op13_clusters": OP13_SQL, "chat_layouts": LAYOUTS_SQL}
