"""The embedding queue as state of a stream: each fact that a model hasn't answered yet waits for its next attempt; what fails for good is quarantined.

The model is asked for one fact at a time, so that one it can't take holds up no other. What may pass (Retryable, time-outs, connections, another number of vectors than one) is tried again after a
wait that doubles up to a longest one, on the clock of the machine; any other error would come again for ever and is quarantined, as is, if a most number of attempts is named, what has failed so often.
Waiting facts, their texts and times are the stream's state: they survive a restart, and a trigger that is run again overwrites what it has written, so each answer is kept once.

Cases: facts with a null id are left out; a null or blank text is quarantined without an attempt; of several texts of one id in a trigger the greatest in order counts; a new text of a waiting fact
takes the old one's place and is tried at once, its attempts counted on; a fact that is sent again after its answer is embedded anew, and its newest outcome stands; a vector of another size than
the table's stops the stream, as vectors of two models must never mix; other columns are ignored; an empty stream gives no rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import ship
from tessera.sources.tables import create_file

OUT = "id long, vector array<float>, error string, attempts int, retry_ms long"
STATE = "text string, attempts int"


class Retryable(Exception):
    """A model's failure that may pass."""


def attempts(facts: DataFrame, call: Callable[[str, int], list[list[float]]], size: int | None = None, wait: float = 2.0, longest: float = 3600.0, most: int | None = None) -> DataFrame:
    """id, vector, error, attempts, retry_at: a row for each attempt on a fact (id, text) of a stream, in update mode. Of vector, and of retry_at (null for what is quarantined), one at most is set.

    call gets a text and the number of the attempt, from 1, and answers with a list of one vector.
    """
    ship(facts.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else (None, 0)
        if not state.hasTimedOut:
            sent = [t for p in parts for t in p["text"] if isinstance(t, str)]
            text = max(sent) if sent else None
        vector, error, again = None, None, False
        if text is None or not text.strip():
            error = "no text"
        else:
            n += 1
            try:
                got = call(text, n)
                if len(got) == 1:
                    vector = [float(x) for x in got[0]]
                else:
                    error, again = f"{len(got)} vectors for one text", True
            except (Retryable, TimeoutError, ConnectionError) as e:
                error, again = str(e) or type(e).__name__, True
            except Exception as e:  # whatever else a model raises is this fact's outcome
                error = str(e) or type(e).__name__
        if vector is not None and size is not None and len(vector) != size:
            raise ValueError(f"fact {key[0]}: a vector of {len(vector)} components in a table of {size}")
        again = again and (most is None or n < most)
        retry = None
        if again:
            pause = max(1, int(1000 * min(longest, wait * 2.0 ** min(n - 1, 60))))
            retry = state.getCurrentProcessingTimeMs() + pause
            state.update((text, n))
            state.setTimeoutDuration(pause)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [key[0]], "vector": [vector], "error": [error], "attempts": [n], "retry_ms": pd.array([retry], dtype="Int64")})

    rows = facts.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tried = rows.groupBy("id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return tried.select("id", "vector", "error", "attempts", F.timestamp_millis("retry_ms").alias("retry_at"))


def locked_model(spark: SparkSession, out: str, model: str, size: int) -> None:
    """Binds a folder of vectors to the first model and size that write to it; another one is an error."""
    path = f"{out}/_model/model.json"
    try:
        create_file(spark, path, json.dumps({"model": model, "size": size}) + "\n")
    except Exception as e:  # bound already; whatever else went wrong is raised
        if "FileAlreadyExists" not in str(e):
            raise
    bound = spark.read.json(path, schema="model string, size int").first()
    if (bound["model"], bound["size"]) != (model, size):
        raise ValueError(f"{out} holds vectors of {bound['model']} with {bound['size']} components, not of {model} with {size}")


def embedding_queue(facts: DataFrame, out: str, checkpoint: str, model: str, size: int, call: Callable[[str, int], list[list[float]]], every: str = "2 seconds", **more) -> StreamingQuery:
    """Runs the queue: attempts in out, a folder for each trigger, which outcomes() reads as three tables. more: wait, longest and most of attempts."""
    spark = facts.sparkSession
    locked_model(spark, out, model, size)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/attempts")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)

    def write(batch: DataFrame, number: int) -> None:
        # Written once: three tables written here would each ask the model again. Most triggers of a quiet queue have no rows, and leave no folder.
        at, seen = f"{out}/attempts/batch={number}", Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(at)
        if not seen.get["n"]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(at), True)

    tried = attempts(facts, call, size, **more)
    return tried.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def outcomes(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, vector), (id, error, attempts), (id, error, attempts, retry_at): stored, quarantined and waiting facts of a queue's folder, each by its newest attempt."""
    rows = spark.read.schema("id long, vector array<float>, error string, attempts int, retry_at timestamp, batch long").parquet(f"{out}/attempts")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("vector", "error", "attempts", "retry_at"), "batch").alias("a")).select("id", "a.*")
    stored, waiting = newest.where("vector is not null"), newest.where("retry_at is not null")
    return stored.select("id", "vector"), newest.where("vector is null and retry_at is null").select("id", "error", "attempts"), waiting.select("id", "error", "attempts", "retry_at")


def drain(query: StreamingQuery, seconds: float = 600.0) -> None:
    """Waits until a trigger has found no new facts and none waits, then stops the stream; its error, if it has one, is raised."""
    end, quiet = time.monotonic() + seconds, set()
    try:
        while len(quiet) < 2:
            if time.monotonic() > end:
                raise TimeoutError(f"facts still wait after {seconds} seconds")
            if not query.isActive:
                query.awaitTermination()
                raise RuntimeError("the stream was stopped while facts waited")
            p = query.lastProgress
            if p and not p["numInputRows"] and p["stateOperators"] and not p["stateOperators"][0]["numRowsTotal"]:
                quiet.add(p["batchId"])
            else:
                quiet.clear()
            time.sleep(0.2)
    finally:
        query.stop()
