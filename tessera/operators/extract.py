"""Extraction: a model's answer to candidate facts, duplicates, automatic replacement."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.meta import conflicts
from tessera.operators.similar import near
from tessera.session import ship

SIMILAR = 0.85
#: Bytes of answers that a worker parses at once (a longer answer comes alone).
SLICE_BYTES = 1_000_000


def parse_answer(raw: str | None) -> list[dict]:
    """Facts of an answer: a JSON array, one object with content, or an object that wraps an array; fences and prose around it are passed over."""
    decoder = json.JSONDecoder()
    text = raw or ""
    for i, c in enumerate(text):
        if c in "[{":
            try:
                value, _ = decoder.raw_decode(text, i)
                break
            except json.JSONDecodeError:
                continue
    else:
        return []
    if isinstance(value, dict):
        if value.get("content"):
            value = [value]
        else:
            value = next((v for v in value.values() if isinstance(v, list) and v), [])
    return [v for v in value if isinstance(v, dict)]


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """answer_id, at, content, subject, category of batches of answers (answer_id, raw), SLICE_BYTES of answers at a time: what a worker holds doesn't grow with a batch's texts."""
    text = lambda v: v if isinstance(v, str) else None
    for batch in batches:
        ids, raw = batch.columns
        slices = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        starts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(raw)] if len(raw) else [0]
        for low, high in pairwise(starts):
            found = [(low + i, at, f) for i, r in enumerate(raw.slice(low, high - low).to_pylist()) for at, f in enumerate(parse_answer(r))]
            columns = [pa.array([text(f.get(c)) for *_, f in found], pa.string()) for c in ("content", "subject", "category")]
            rows, places = pa.array([i for i, *_ in found], pa.int64()), pa.array([at for _, at, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(rows), places, *columns], names=["answer_id", "at", "content", "subject", "category"])


def candidates(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """batch_index, content, subject, category of answers (answer_id, raw): trimmed, without empty content, category note by default."""
    ship(answers.sparkSession)
    own = answers.select("answer_id", F.col(raw).cast("string").alias("raw"))
    schema = T.StructType([own.schema["answer_id"], T.StructField("at", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("content", "subject", "category"))])
    rows = own.mapInArrow(parsed, schema)
    rows = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("content", "subject")}).where("content <> ''")
    return rows.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("note")))


def plan_extraction(new: DataFrame, facts: DataFrame, order: list[str]) -> DataFrame:
    """new with action: insert, or duplicate of an earlier row (same content and subject) or of a fact that is there."""
    place = F.row_number().over(Window.partitionBy("content", "subject").orderBy(*order))
    there = facts.where("superseded_by is null").select("content", "subject").distinct().withColumn("_there", F.lit(True))
    rows = new.withColumn("_place", place).join(there, ["content", "subject"], "left")
    return rows.withColumn("action", F.when((F.col("_place") > 1) | F.col("_there"), "duplicate").otherwise("insert")).drop("_place", "_there")


def replacements(new: DataFrame, facts: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """old_id, new_id: what each new fact (in order of batch_index) replaces: the most similar active fact of its subject, from a similarity on.

    Metadata must not conflict; of its batch only earlier ones, and none that an earlier one has already replaced. Pairs come from similar.near, a hot subject's in blocks; the order
    within a subject, which each choice depends on, is then walked with the pairs that reached the threshold.
    """
    a = new.select(F.col("id").alias("new_id"), "subject", "batch_index", F.col("metadata").alias("m"), F.col("embedding").alias("v"))
    own = new.select(F.col("id").alias("old_id"), "subject", F.col("batch_index").alias("old_index"), F.col("metadata").alias("o"), F.col("embedding").alias("w"))
    old = facts.where("superseded_by is null and embedding is not null").select(F.col("id").alias("old_id"), "subject", F.lit(-1).alias("old_index"), F.col("metadata").alias("o"), F.col("embedding").alias("w"))
    pool = old.join(own.select("old_id"), "old_id", "left_anti").select(own.columns).unionByName(own)
    pairs = near(a, pool, "new_id", "old_id", threshold).where("old_index < batch_index").where(~conflicts(F.col("m"), F.col("o")))
    pairs = pairs.select("subject", "batch_index", "new_id", "old_id", F.col("score").alias("sim"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for _, group in rows.sort_values(["batch_index", "sim", "old_id"], ascending=[True, False, True]).groupby("batch_index", sort=True):
            for r in group.itertuples():
                if r.old_id not in gone:
                    gone.add(r.old_id)
                    out.append((r.old_id, r.new_id))
                    break
        return pd.DataFrame(out, columns=["old_id", "new_id"]).astype("int64")

    return pairs.groupBy("subject").applyInPandas(choose, "old_id long, new_id long")


def store_batch(facts: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """Status of each item (item, content, subject, category) of a store call: error, duplicate or stored, in order; over limit items, all are errors."""
    rows = items.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("content", "subject", "category")}).withColumn("category", F.when(F.col("category") == "", "note").otherwise(F.col("category")))
    rows = rows.crossJoin(items.agg(F.count("*").alias("n")))  # one row
    bad = F.when(F.col("n") > limit, "too many items").when(F.col("content") == "", "content is required").when(F.col("subject") == "", "subject is required").when(F.length("content") > 8000, "content is too long")
    planned = plan_extraction(rows.withColumn("error", bad).withColumn("ok", bad.isNull()), facts, [F.desc("ok"), "item"])
    return planned.select("item", F.when(F.col("error").isNotNull(), "error").when(F.col("action") == "duplicate", "duplicate").otherwise("stored").alias("status"), "error")
