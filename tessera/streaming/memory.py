"""What a session remembers while it runs, as state of a stream: the files last touched, the facts it has been shown, forgotten after a pause.

Cases: rows with a null session or time are left out; a null file or fact adds nothing of its kind, but keeps the session awake; a row that comes late counts at its own time while it is
less than the pause before the remembered stretch, and is left out if it lies before that; rows later than the watermark never come; ties in time go by file name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.sessions import IDLE_SECONDS, RECENT_FILES

OUT = "session_id string, files array<string>, seen array<long>, last timestamp, expired boolean"
STATE = "begin long, last long, files array<string>, times array<long>, seen array<long>"


def session_memory(touches: DataFrame, late: str = "10 minutes", most: int = RECENT_FILES, idle: int = IDLE_SECONDS) -> DataFrame:
    """session_id, files (oldest first), seen (in order), last, expired: a row for each session of a trigger that had rows, and one when it's forgotten, which is when the watermark is idle seconds past
    its last row. For streams, in update mode. touches: session_id, file, fact_id, ts.

    A session keeps most files and the ids of the facts shown to it; a trigger's rows of one session meet in one task, so a trigger's size (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds them.
    """
    pause = idle * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, files, times, seen = state.get if state.exists else (None, None, [], [], [])

        def row(expired: bool) -> pd.DataFrame:
            return pd.DataFrame({"session_id": [key[0]], "files": [list(files)], "seen": [list(seen)], "last": [pd.Timestamp(last, unit="us")], "expired": [expired]})

        if state.hasTimedOut:
            state.remove()
            yield row(True)
            return
        rows = pd.concat([p[["at", "file", "fact_id"]] for p in parts]).sort_values("at", kind="stable")
        used, known = dict(zip(files, times, strict=True)), set(seen)
        for at, file, fact in zip(rows["at"].tolist(), rows["file"].tolist(), rows["fact_id"].tolist(), strict=True):
            if last is None or at - last >= pause:
                begin, last, used, known = at, at, {}, set()
            elif begin - at >= pause:
                continue
            begin, last = min(begin, at), max(last, at)
            if isinstance(file, str):
                used[file] = max(used.get(file, at), at)
            if fact is not None and not pd.isna(fact):
                known.add(int(fact))
        kept = sorted(used.items(), key=lambda f: (-f[1], f[0]))[:most]
        kept.sort(key=lambda f: (f[1], f[0]))
        files, times, seen = [f for f, _ in kept], [t for _, t in kept], sorted(known)
        state.update((begin, last, files, times, seen))
        # A time-out must lie after the watermark; a session that is past it already is forgotten with the next one.
        state.setTimeoutTimestamp(max((last + pause) // 1000, state.getCurrentWatermarkMs() + 1))
        yield row(False)

    rows = touches.where("session_id is not null and ts is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("file").cast("string").alias("file"), F.col("fact_id").cast("long").alias("fact_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(memory: DataFrame) -> DataFrame:
    """session_id, files, seen: what each session remembered last, of the rows that a stream of session_memory has written."""
    return memory.groupBy("session_id").agg(F.max_by(F.struct("files", "seen"), F.struct("last", "expired", F.size("seen"))).alias("m")).select("session_id", "m.files", "m.seen")
