"""What runs all the time: the embedding queue, idempotent turns, session stretches, incremental file sync. Event-time windows and watermarks here are ours."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.sessions import IDLE_SECONDS


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Stand-in embedder, ours: signed counts of hashed terms, of length one. Pure and deterministic."""
    from tessera.functions.text import terms
    from tessera.functions.vector import norm

    from pyspark.sql import functions as F

    words = terms(text)
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(places, lambda p: p["i"] == k), F.lit(0.0), lambda a, p: a + p["s"]))
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: (x / F.greatest(norm(v), F.lit(1e-12))).cast("float")))[0]


def embed(facts: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, with_subject: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, vector), (id, error): facts without a vector and not quarantined, embedded; what has no usable text fails for good."""
    todo = facts.where("embedding is null")
    todo = todo.where("embed_failed_at is null") if "embed_failed_at" in facts.columns else todo
    text = F.concat_ws(": ", "subject", "content") if with_subject else F.col("content")
    good = F.length(F.trim(F.coalesce("content", F.lit("")))) > 0
    return todo.where(good).select("id", embedder(text).alias("vector")), todo.where(~good).select("id", F.lit("no text").alias("error"))


def embed_in_batches(facts: DataFrame, call: Callable[[list[str]], list[list[float]]], size: int = 50) -> DataFrame:
    """id, vector of facts without a vector, by a model that takes up to size texts a call. An answer with another number of vectors is an error."""

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            for at in range(0, len(ids), size):
                some = [t or "" for t in texts[at : at + size]]
                got = call(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                yield pa.RecordBatch.from_pydict({"id": ids[at : at + size], "vector": got}, schema=pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32()))]))

    return facts.where("embedding is null").select("id", "content").mapInArrow(run, "id long, vector array<float>")


def embed_outcomes(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, vector), (id, error), (id): answers (id, vectors, error, retryable) of a model, one fact each: stored, quarantined, tried again with the next batch.

    What may pass (a time-out) or came with another number of vectors than one is tried again; any other error would come again for ever, and is quarantined.
    """
    good = F.col("error").isNull() & (F.size(F.coalesce("vectors", F.array().cast("array<array<float>>"))) == 1)
    bad = F.col("error").isNotNull() & ~F.coalesce("retryable", F.lit(False))
    return answers.where(good).select("id", F.col("vectors")[0].alias("vector")), answers.where(bad).select("id", "error"), answers.where(~good & ~bad).select("id")


def embed_stream(facts: DataFrame, out: str, checkpoint: str, embedder: Callable[[Column], Column] = hashed_embedding, once: bool = False) -> StreamingQuery:
    """New facts of a stream to two tables, vectors and failures. A batch that is run again after a failure overwrites its own files: each has its folder."""

    def write(batch: DataFrame, number: int) -> None:
        vectors, failures = embed(batch, embedder)
        vectors.write.mode("overwrite").parquet(f"{out}/vectors/batch={number}")
        failures.write.mode("overwrite").parquet(f"{out}/failures/batch={number}")

    w = facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()


def first_turns(turns: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (session_id, uuid) once, however often it is sent within the watermark. turns: a stream with created_at."""
    return turns.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["session_id", "uuid"])


def session_stretches(touches: DataFrame, user: str = "session_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """user, start, end, n: stretches of activity without a pause of IDLE_SECONDS; for streams and tables alike."""
    rows = touches.withWatermark(at, late) if touches.isStreaming else touches
    got = rows.groupBy(F.session_window(at, f"{IDLE_SECONDS} seconds"), F.col(user)).agg(F.count("*").alias("n"))
    return got.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    got = rows.groupBy(F.window(at, size), F.col(by)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("window.start").alias("start"), by, "n", "total")


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, sha256) of a batch or stream that aren't stored with the same hash."""
    return files.join(stored.select("path", "sha256"), ["path", "sha256"], "left_anti") if not files.isStreaming else files.join(stored.select("path", F.col("sha256").alias("have")), "path", "left_outer").where("have is null or have <> sha256").drop("have")
