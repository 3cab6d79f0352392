"""Which words of a stated set of tasks a text contains, anywhere in its own words too.

A word of a task holds no white space, so it is in a text if it is in one of the text's words. What each distinct word of the texts holds is looked up once a task of Spark's (its parts, by
the lengths that words of tasks have), so a text costs its words and what they hold, however many tasks there are; nothing is compared pair by pair.

Cases: a null text holds no words; a null task has no rows; rows that repeat an id are answered each; a word that a task repeats counts as often; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.operators import search
from tessera.session import ship

#: Distinct words of texts whose findings a task remembers (beyond, it begins anew), and rows that are scored at once.
REMEMBERED, ROWS = 400_000, 500
#: Java's \s, which cuts the tasks.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


class Tasks:
    """Words (lower case, 3 bytes or more, with repeats) and lower-case texts of tasks."""

    def __init__(self, words: list[list[str]], texts: list[str]):
        self.texts, at = texts, {}
        for k, own in enumerate(words):
            for w in own:
                at.setdefault(w, []).append(k)
        self.numbers = {w: n for n, w in enumerate(at)}
        self.of = [np.array(k, dtype=np.int64) for k in at.values()]
        self.lengths = sorted({len(w) for w in at})
        self.known: dict[str, tuple[int, ...]] = {}
        self.domains: dict[str, np.ndarray] = {}

    def held(self, token: str) -> tuple[int, ...]:
        """Numbers of the words that a text's word holds."""
        if (found := self.known.get(token)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            get, n = self.numbers.get, len(token)
            parts = {get(token[i : i + k]) for k in self.lengths if k <= n for i in range(n - k + 1)}
            found = tuple(parts - {None})
            if n < 200:
                self.known[token] = found
        return found

    def words_in(self, text: str | None) -> np.ndarray:
        """How many words of each task a lower-case text contains."""
        held = {w for token in set(WORD.findall(text or "")) for w in self.held(token)}
        every = np.concatenate([self.of[w] for w in held]) if held else np.array([], dtype=np.int64)
        return np.bincount(every, minlength=len(self.texts))

    def domains_in(self, domains: list[str | None] | None) -> np.ndarray:
        """How many of a fact's lower-case domains each task's text contains."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        for d in domains or ():
            if d:
                if d not in self.domains:
                    if len(self.domains) >= ROWS:
                        self.domains.clear()
                    self.domains[d] = np.array([d in t for t in self.texts], dtype=np.int64)
                out += self.domains[d]
        return out


def first_places(scores: np.ndarray, ids: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and tasks of scores above zero, of each task the first by score and id if most is named."""
    if most is None or len(ids) <= most:
        return np.nonzero(scores > 0)
    by_id = np.argsort(ids, kind="stable")
    rows = by_id[np.argsort(-scores[by_id], axis=0, kind="stable")[:most]]
    tasks = np.broadcast_to(np.arange(scores.shape[1]), rows.shape)
    above = scores[rows, tasks] > 0
    return rows[above], tasks[above]


def matches(facts: DataFrame, tasks: DataFrame, most: int | None = None, key: str = "task_id") -> DataFrame:
    """key, the columns of facts without content and domains, score: of each task (key, task) the facts that share something with it.

    The score counts the task's words of 3 bytes or more in the content, and 3 for each of the fact's domains (where facts have them) in the task. With most, each Spark task
    may leave out facts that aren't among the first by score and id. Tasks are a stated set, broadcast QUERIES_AT_ONCE of them about at a time; a further block is one more pass.
    """
    spark = ship(facts.sparkSession)
    kept = [c for c in facts.columns if c not in ("content", "domains")]
    scored = "domains" in facts.columns
    rows = facts.select(*kept, F.lower("content").alias("content"), *[F.transform("domains", F.lower).alias("domains")] * scored)
    rows = rows.where("domains is not null") if scored else rows
    schema = StructType([*facts.select(*kept).schema.fields]).add("at", IntegerType()).add("score", IntegerType())
    words = F.filter(F.split(F.lower(F.trim("task")), r"\s+"), lambda w: F.octet_length(w) >= 3)
    tasks = tasks.where("task is not null").select(key, words.alias("words"), F.lower("task").alias("text"))

    def block(own: DataFrame) -> DataFrame:
        named = own.collect()
        shared = spark.sparkContext.broadcast(([r["words"] for r in named], [r["text"] for r in named]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = Tasks(*shared.value)
            for batch in batches:
                for i in range(0, batch.num_rows if given.texts else 0, ROWS):
                    part = batch.slice(i, ROWS)
                    scores = np.stack([given.words_in(t) for t in part.column("content").to_pylist()])
                    if scored:
                        scores += 3 * np.stack([given.domains_in(d) for d in part.column("domains").to_pylist()])
                    found, at = first_places(scores, part.column("id").to_numpy(zero_copy_only=False), most)
                    columns = [part.column(c).take(pa.array(found)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int32()), pa.array(scores[found, at], pa.int32())], names=[*kept, "at", "score"])

        keys = spark.createDataFrame([(k, r[key]) for k, r in enumerate(named)], StructType().add("at", IntegerType()).add(tasks.schema[key]))
        return rows.mapInArrow(run, schema).join(F.broadcast(keys), "at").select(key, *kept, "score")

    blocks = max(1, -(-tasks.count() // search.QUERIES_AT_ONCE))
    out = block(tasks if blocks == 1 else tasks.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == 0))
    for k in range(1, blocks):
        out = out.unionByName(block(tasks.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)))
    return out
