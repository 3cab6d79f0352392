"""Session memory as a stream's state: late rows, a restart in between, expiry, the limit of files, odd rows."""

import datetime as dt

from tessera.operators import sessions
from tessera.streaming import memory

SCHEMA = "session_id string, file string, fact_id long, ts timestamp"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def run(spark, folder, rows, **more):
    """Rows come in a file of their own, and the stream is started anew each time, from its checkpoint."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = []
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = memory.session_memory(source, **more).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_late_rows_restarts_and_expiry(spark, tmp_path):
    folder = f"file:{tmp_path}"
    first = run(spark, folder, [("s", "a", 1, at(3)), ("s", "old", 9, at(1)), ("s", "b", None, at(3, 10)), (None, "x", 1, at(3)), ("s", "x", 1, None)])
    assert [(r["session_id"], r["files"], r["seen"], r["last"], r["expired"]) for r in first if not r["expired"]] == [("s", ["a", "b"], [1], at(3, 10), False)]
    # Late within the watermark: at its own time, between the two; a touch again moves a file to the end; a null file keeps the session awake.
    second = run(spark, folder, [("s", "c", 2, at(3, 5)), ("s", "a", 1, at(3, 40)), ("s", None, 7, at(4, 30))])
    assert [(r["files"], r["seen"], r["last"]) for r in second if not r["expired"]] == [(["c", "b", "a"], [1, 2, 7], at(4, 30))]
    # Another session's time passes; the first is forgotten with all it knew, once.
    third = run(spark, folder, [("t", "z", 5, at(9))])
    forgotten = [(r["session_id"], r["files"], r["seen"]) for r in third if r["expired"]]
    assert forgotten == [("s", ["c", "b", "a"], [1, 2, 7])]
    again = run(spark, folder, [("s", "new", None, at(9, 1))])
    assert [(r["files"], r["seen"]) for r in again if r["session_id"] == "s" and not r["expired"]] == [(["new"], [])]


def test_as_the_table_has_it(spark, tmp_path):
    import random

    random.seed(5)
    rows = [(f"s{random.randrange(6)}", f"f{random.randrange(40)}", random.randrange(9), at(0) + dt.timedelta(minutes=random.randrange(1200))) for _ in range(900)]
    got = run(spark, f"file:{tmp_path}", rows, late="2 days")
    table = spark.createDataFrame(rows, SCHEMA)
    want = {r["session_id"]: r["files"] for r in sessions.recent_files(table).collect()}
    assert {r["session_id"]: r["files"] for r in got} == want and max(map(len, want.values())) == sessions.RECENT_FILES


def test_latest_and_empty(spark, tmp_path):
    rows = [("s", ["a"], [1], at(1), False), ("s", ["a", "b"], [1, 2], at(2), False), ("s", ["a", "b"], [1, 2], at(2), True)]
    assert [tuple(r) for r in memory.latest(spark.createDataFrame(rows, memory.OUT)).collect()] == [("s", ["a", "b"], [1, 2])]
    assert run(spark, f"file:{tmp_path}", []) == []
