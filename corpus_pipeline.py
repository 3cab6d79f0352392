"""A corpus pipeline of five stages: language, near-duplicates, benchmark leaks, personal data, tokens.

A stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns documents again (the last: tokens). Rows with a null id
can't be named by a decision about duplicates, and stay; otherwise nulls, empty and repeated rows are as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, langid, pii
from tessera.llm.common import documents, ensure_checkpoint_dir, forget, kept_at
from tessera.llm.queries import vocabulary_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction under this share of the posterior is no identification.
LEAST_SCORE = 0.5
#: Words of a shingle and least similarity, in hundredths, of near-duplicates. (Operator 6's own query has a contract with others.)
SHINGLE, LEVEL = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language, which becomes their lang. Those without (und, or a score under LEAST_SCORE) go."""
    model = vocabulary_file("piece_bpe_32k.model")
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, model, langid.train(docs, model), keep=COLUMNS)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-duplicates."""
    docs = docs.select(*COLUMNS)
    stay = jaccard.near_duplicates(docs, shingle=SHINGLE, level=LEVEL).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*COLUMNS).union(docs.where("doc_id is null"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of personal data are replaced by their kind in brackets, and n_chars follows."""
    found = pii.find_spans(docs, pii.train(docs), keep=COLUMNS)
    clean = pii.redacted(F.col("searched"), F.array_sort(F.concat("base", "added")))
    found = found.withColumn("clean", F.when(F.col("text").isNotNull(), clean))
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.size(F.concat("base", "added")) > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the text that they decode to."""
    return bpe.encode_documents(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("without_leaks", without_leaks), ("without_personal_data", without_personal_data), ("tokens", tokens)]
#: Language models, components and merges aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what a stage keeps is written to the shared folder, and read again by the next."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{k}-{name}")
            docs = kept_at(spark.read.parquet(f"{shared}/{k}-{name}"), f"{shared}/{k}-{name}")
            if before is not None:
                forget(before)  # the next stage reads what this one has written
            before = docs
    return docs
