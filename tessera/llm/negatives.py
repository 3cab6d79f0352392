"""Hard-negative mining (operator 11) over a vector-approximation file.

The file holds, for each vector, the number of the cell that each of its components lies in: CELLS cells a dimension, cut where the dimension's values have their quantiles (Spark's mergeable
sketch over all rows), and with the least and greatest value of each. A table of an anchor's products with the ends of each cell gives a lower and an upper bound of a score by look-ups and
sums. Components are integers, and so bounds are exact: no pair that could enter a result is lost. Only pairs whose bounds leave that open are scored.

Two passes over the file, for a block of anchors at a time (a stated query set against all rows), whose vectors are broadcast:
positives: of the anchor's label, scored only where the upper bound reaches the k-th best lower bound, or score, so far;
negatives: of other labels, scored only where the bounds meet the window that a positive's score opens, and the upper bound reaches the k-th of those that surely lie in it.
A task sends on its own first k for each list; what is shuffled is at most k rows for each list and task, dealt by anchor and positive.

Cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; missing components of shorter vectors count as 0; rows that repeat an id are each a row, and an
anchor each; another row of an anchor is one with another id; equal scores go by the smaller id; a positive score below 0 opens no window, and one of 0 only that of 0; an empty table, or
one without anchors, gives an empty table; other columns are ignored. Components beyond vectors.MOST are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import MOST, matrix, scaled, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score as hundredths of its positive's.
LOW, HIGH = 30, 90
CELLS = 64
#: Anchors broadcast at a time; rows of a task that meet them at a time; the part of both whose bounds lie side by side.
ANCHORS, ROWS, SIDE, ANCHOR_SIDE = 8192, 32_768, 2048, 256
LEAST, MOST_ID = -(1 << 62), (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


class First:
    """The first k of each of some lists, by score downwards, then id, of all that was added."""

    def __init__(self, lists: int, k: int):
        self.score, self.id, self.k = np.full((lists, k), LEAST, np.int64), np.full((lists, k), MOST_ID, np.int64), k

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        own = np.unique(which)
        which = np.concatenate([np.repeat(own, self.k), which])
        score, ids = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, -score, which))
        which = which[order]
        start = np.searchsorted(which, own)
        place = np.arange(len(which)) - np.repeat(start, np.diff(np.append(start, len(which))))
        order = order[place < self.k]
        self.score[own], self.id[own] = score[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        which, place = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(self.id[which, place]), pa.array(self.score[which, place])], schema=FOUND)


def cells(vectors: DataFrame, number: int = CELLS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each dimension the first values of all cells but the lowest; the least and the greatest value of each cell (dimension, cell)."""
    shares = [i / number for i in range(1, number)]
    values = vectors.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    rows = values.agg(F.percentile_approx("x", shares, 1000).alias("q"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()  # a row a dimension
    cuts = [np.array(sorted({q for q in r["q"] if q > r["low"]}), np.int64) for r in rows]
    least, most = np.zeros((len(rows), number), np.int64), np.zeros((len(rows), number), np.int64)
    for d, (r, cut) in enumerate(zip(rows, cuts, strict=True)):
        # Shorter vectors count as 0 where they end.
        least[d, : len(cut) + 1], most[d, : len(cut) + 1] = np.r_[min(r["low"], 0), cut], np.r_[cut - 1, max(r["high"], 0)]
    return cuts, least, most


def approximated(vectors: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The vector-approximation file: id, label, codes (a byte a dimension), x."""
    width = len(cuts)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            codes = np.stack([np.searchsorted(c, x[:, d], "right") for d, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in codes], pa.binary()), batch.column("x")], names=["id", "label", "codes", "x"])

    return stored(vectors.mapInArrow(run, "id long, label long, codes binary, x array<int>"))


def blocks_of(batches, width: int):
    """ids, labels, codes and vectors of about ROWS rows at a time."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield unpacked(some, width)
            some, n = [], 0
    if n:
        yield unpacked(some, width)


def unpacked(batches: list[pa.RecordBatch], width: int):
    t = pa.Table.from_batches(batches).combine_chunks()
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, width)
    return t["id"].to_numpy(), t["label"].to_numpy(), codes, matrix(t["x"].chunk(0), width)


def look_ups(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, cell, anchor): the least and the greatest product of the anchor's component with a value of the cell. Of 32 bits where all sums have room there."""
    low, high = least[:, :, None] * anchors.T[:, None, :], most[:, :, None] * anchors.T[:, None, :]
    low, high = np.minimum(low, high), np.maximum(low, high)
    room = max(np.abs(low).max(1).sum(0).max(initial=0), np.abs(high).max(1).sum(0).max(initial=0)) < 1 << 31
    return (low.astype(np.int32), high.astype(np.int32)) if room else (low, high)


def bounds(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): what scores lie between."""
    below, above = low[0][codes[:, 0]], high[0][codes[:, 0]]
    for d in range(1, len(low)):
        below += low[d][codes[:, d]]
        above += high[d][codes[:, d]]
    return below, above


def scores(x: np.ndarray, anchors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of a row and an anchor."""
    parts = [np.einsum("ij,ij->i", x[row[i : i + 65_536]], anchors[anchor[i : i + 65_536]]) for i in range(0, len(row), 65_536)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column, LEAST where there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], LEAST)


def sides(n: int, most: int):
    return ((i, min(n, i + most)) for i in range(0, n, most))


def positives_in(shared, k: int):
    """A task's first k rows of each anchor's own label; list is the anchor's place in the block."""

    def run(batches):
        ids, labels, anchors, least, most = shared.value[:5]
        first = First(len(ids), k)
        by_label = np.argsort(labels, kind="stable")
        edges = np.searchsorted(labels[by_label], np.unique(labels), "left").tolist() + [len(ids)]
        for own_ids, own_labels, codes, x in blocks_of(batches, anchors.shape[1]):
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                of = np.flatnonzero(own_labels == labels[by_label[start]])
                for a, b in sides(end - start if len(of) else 0, ANCHOR_SIDE):
                    some = by_label[start + a : start + b]
                    low, high = look_ups(anchors[some], least, most)
                    for i, j in sides(len(of), SIDE):
                        rows = of[i:j]
                        below, above = bounds(codes[rows], low, high)
                        other = own_ids[rows, None] != ids[None, some]
                        reach = np.maximum(kth(np.where(other, below, LEAST), k), first.score[some, -1])
                        r, c = np.nonzero(other & (above >= reach))
                        first.add(some[c], scores(x, anchors, rows[r], some[c]), own_ids[rows[r]])
        yield first.rows()

    return run


def negatives_in(shared, k: int):
    """A task's first k rows of another label in each window; list is the anchor's place in the block, times the positives an anchor may have, and the positive's place."""

    def run(batches):
        ids, labels, anchors, least, most, opens, closes = shared.value
        first, slots = First(opens.size, k), opens.shape[1]
        for own_ids, own_labels, codes, x in blocks_of(batches, anchors.shape[1]):
            for a, b in sides(len(ids), ANCHOR_SIDE):
                low, high = look_ups(anchors[a:b], least, most)
                for i, j in sides(len(own_ids), SIDE):
                    below, above = bounds(codes[i:j], low, high)
                    other = own_labels[i:j, None] != labels[None, a:b]
                    open_for, any_open = [], np.zeros(other.shape, bool)
                    for p in range(slots):
                        lists = np.arange(a, b) * slots + p
                        sure = other & (below >= opens[a:b, p]) & (above <= closes[a:b, p])
                        reach = np.maximum(np.maximum(kth(np.where(sure, below, LEAST), k), first.score[lists, -1]), opens[a:b, p])
                        maybe = other & (above >= reach) & (below <= closes[a:b, p])
                        open_for.append((lists, maybe))
                        any_open |= maybe
                    r, c = np.nonzero(any_open)
                    score = scores(x, anchors, r + i, c + a)
                    for p, (lists, maybe) in enumerate(open_for):
                        inside = maybe[r, c] & (score >= opens[c + a, p]) & (score <= closes[c + a, p])
                        first.add(lists[c[inside]], score[inside], own_ids[r[inside] + i])
        yield first.rows()

    return run


def first_of(found: DataFrame, k: int) -> DataFrame:
    """rank, from 1, within each list: the group limit runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor and label (default: the column of that name) may use all of df's columns.

    Scores are inner products of scaled vectors. For each anchor and each of its first positives (rows of its label): the first negatives, rows of other labels with
    low * positive score <= 100 * score <= high * positive score.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stored(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).select("id", "label", "asks", scaled(F.col("v"), scale).alias("x")))
    cuts, least, most = cells(rows)
    width, asking = len(cuts), rows.where("asks")
    n = asking.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    if width * MOST > 1 << 35:
        raise ValueError(f"vectors of {width} components have no room for their products")
    file = approximated(rows.drop("asks"), cuts)
    blocks, out = -(-n // ANCHORS), None
    for block in range(blocks):
        # Dealt by id and content: a block has ANCHORS rows about, whatever repeats.
        own = asking.select("id", "label", "x") if blocks == 1 else asking.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)) == block).select("id", "label", "x")
        t = own.toArrow().combine_chunks()
        if not t.num_rows:
            continue
        at = (t["id"].to_numpy(), t["label"].to_numpy(), matrix(t["x"].chunk(0), width), least, most)
        near = first_of(file.mapInArrow(positives_in(spark.sparkContext.broadcast(at), positives), "list long, id long, score long"), positives).toArrow()
        which, place = near["list"].to_numpy(), near["rank"].to_numpy() - 1
        score = np.zeros((t.num_rows, positives), np.int64)
        opens, closes = np.full(score.shape, MOST_ID), np.full(score.shape, LEAST)
        score[which, place] = near["score"].to_numpy()
        opens[which, place], closes[which, place] = -(-low * score[which, place] // 100), high * score[which, place] // 100
        found = first_of(file.mapInArrow(negatives_in(spark.sparkContext.broadcast((*at, opens, closes)), negatives), "list long, id long, score long"), negatives)
        # What each list stands for: a row for each anchor and positive of the block.
        named = pa.table({"list": which * positives + place, "anchor_id": at[0][which], "positive_id": near["id"], "positive_score": near["score"]})
        found = found.join(F.broadcast(spark.createDataFrame(named)), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out
