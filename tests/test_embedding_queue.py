"""The embedding queue with retries in its state: what passes, what waits over a restart, what is quarantined, and the lock on a model."""

import pytest

from tessera.streaming import queue

SCHEMA = "id long, text string, other string"


def picky(text, attempt):
    if text == "poison":
        raise ValueError("too long")
    if text == "twice" and attempt < 3:
        raise TimeoutError("slow")
    if text == "two" and attempt < 2:
        return [[1.0, 2.0], [3.0, 4.0]]
    if text == "down":
        raise queue.Retryable("down")
    return [[float(len(text)), float(attempt)]]


def up_again(text, attempt):
    return [[9.0, float(attempt)]]


def start(spark, folder, rows, call=picky, **more):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return queue.embedding_queue(source, f"{folder}/out", f"{folder}/state", "m", 2, call, every="0 seconds", **({"wait": 0.01} | more))


def tables(spark, folder):
    stored, failed, waiting = queue.outcomes(spark, f"{folder}/out")
    return ({r["id"]: list(r["vector"]) for r in stored.collect()}, {r["id"]: (r["error"], r["attempts"]) for r in failed.collect()}, {r["id"]: (r["error"], r["attempts"], r["retry_at"] is not None) for r in waiting.collect()})


def until_processed(query, batches=1):
    import time

    for _ in range(600):
        if query.exception() or (query.lastProgress and query.lastProgress["batchId"] >= batches - 1):
            break
        time.sleep(0.2)
    query.stop()


def test_retries_quarantine_and_a_restart(spark, tmp_path):
    folder = f"file:{tmp_path}"
    rows = [(1, "good", "x"), (2, "poison", None), (3, "twice", "x"), (4, "two", "x"), (5, None, "x"), (6, "  ", "x"), (None, "good", "x"), (7, "a", "x"), (7, "abc", "x"), (8, "down", "x")]
    # A wait longer than the test: after the first trigger all that failed for now wait.
    until_processed(start(spark, folder, rows, wait=30.0, longest=30.0))
    stored, failed, waiting = tables(spark, folder)
    assert stored == {1: [4.0, 1.0], 7: [3.0, 1.0]} and failed == {2: ("too long", 1), 5: ("no text", 0), 6: ("no text", 0)}
    assert waiting == {3: ("slow", 1, True), 4: ("2 vectors for one text", 1, True), 8: ("down", 1, True)}
    # Started anew, on another model process: what waited is still there, and its attempts are counted on. A new text of a waiting fact is tried at once.
    queue.drain(start(spark, folder, [(8, "works", None), (1, "better", None)], up_again), 120)
    stored, failed, waiting = tables(spark, folder)
    assert stored == {1: [9.0, 1.0], 3: [9.0, 2.0], 4: [9.0, 2.0], 7: [3.0, 1.0], 8: [9.0, 2.0]} and not waiting
    assert failed == {2: ("too long", 1), 5: ("no text", 0), 6: ("no text", 0)}


def test_most_attempts(spark, tmp_path):
    folder = f"file:{tmp_path}"
    queue.drain(start(spark, folder, [(1, "down", None), (2, "twice", None)], most=3), 120)
    assert tables(spark, folder) == ({2: [5.0, 3.0]}, {1: ("down", 3)}, {})


def test_one_model_a_table(spark, tmp_path):
    folder = f"file:{tmp_path}"
    queue.locked_model(spark, f"{folder}/out", "m", 2)
    queue.locked_model(spark, f"{folder}/out", "m", 2)
    for other in (("n", 2), ("m", 3)):
        with pytest.raises(ValueError, match="holds vectors of m with 2"):
            queue.locked_model(spark, f"{folder}/out", *other)
    with pytest.raises(Exception, match="3 components in a table of 2"):
        queue.drain(start(spark, folder, [(1, "x", None)], lambda text, attempt: [[1.0, 2.0, 3.0]]), 120)


def test_no_facts_and_no_empty_folders(spark, tmp_path):
    folder = f"file:{tmp_path}"
    queue.drain(start(spark, folder, []), 120)
    assert tables(spark, folder) == ({}, {}, {})
    queue.drain(start(spark, folder, [(1, "good", None)]), 120)
    # A stream that is stopped within a trigger may leave that one's empty folder, until it's started again.
    assert tables(spark, folder)[0] == {1: [4.0, 1.0]} and len(list((tmp_path / "out/attempts").glob("batch=*"))) <= 3
