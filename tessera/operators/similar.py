"""Threshold join by cosine: pairs of one subject that are at least so similar, exact, whatever a subject's share of all rows.

Vectors of the right side lie in cells, each at its nearest of a few pivots. An angle between two vectors is at least the difference of their angles to any third one, so of each cell
it is known from its nearest and farthest member whether a vector of the left side can have a partner there; and no partner lies in the cell of a pivot that is farther
than the left vector's nearest pivot by more than twice the widest angle asked for. Cells that are left are compared in blocks of BLOCK by BLOCK rows: a matrix product finds pairs near the threshold,
and these are scored by the sums of functions.vector, in the same order, so that a score is the same number wherever it is computed.

Pivots come from a bounded sample (PIVOTS rows by hash): they decide what is skipped, never what is found. Where vectors have no clusters little is skipped, and the work is that of the product.

Cases: rows with a null id or subject, and vectors that are null, empty, of no length, or that have a null or non-finite component, take no part; vectors of different sizes are never
compared; a row isn't its own partner (equal ids); repeated rows are answered each; columns of both sides are returned and must not share names other than subject, nor begin with two underscores;
an empty side gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vector import norm
from tessera.operators import search
from tessera.session import ship
from tessera.sources.tables import written

BLOCK = 4096
PIVOTS = 64
STRIP = 256
SHARE = 64
#: Angles are rounded by far less than this, and so are products of unit vectors by less than MARGIN.
SLACK, MARGIN = 1e-6, 1e-9
#: Keys that get broadcast: those with over 1 / (4 * PARTS) of all rows, of which there are fewer than 4 * PARTS.
PARTS = 500
KEY = ["subject", "__size"]
CELL = [*KEY, "__cell"]


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one size, without nulls, as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)


def angles(vectors: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((vectors / norms[:, None]) @ pivots.T, -1.0, 1.0))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & F.col("subject").isNotNull()).withColumn("__norm", norm(F.col(vector))).where(f"__norm > 0 and __norm < double('infinity') and size({vector}) > 0")
    return rows.withColumn("__size", F.size(vector))


def pivots_of(right: DataFrame, id_col: str, vector: str) -> dict[int, np.ndarray]:
    """Unit vectors of a bounded sample, by size; equal ones once."""
    rows = right.select(F.xxhash64(id_col).alias("h"), F.col(vector).alias("v"), "__norm").orderBy("h").limit(PIVOTS).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["v"]), []).append(np.asarray(r["v"], dtype=np.float64) / r["__norm"])
    return {n: np.unique(np.stack(v), axis=0) for n, v in out.items()}


def placed(df: DataFrame, vector: str, pivots: dict[int, np.ndarray], whole: bool) -> DataFrame:
    """df with angles to all pivots of its size (whole), or with the nearest one as its cell, and the angle to it. Sizes without pivots have one cell, at any angle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            sizes = t["__size"].to_numpy()
            for size in np.unique(sizes):
                part = t.filter(pa.array(sizes == size))
                at = angles(matrix(part[vector], int(size)), part["__norm"].to_numpy(), pivots[size]) if size in pivots else np.zeros((part.num_rows, 1))
                if whole:
                    more = [("__angles", pa.array(list(at), pa.list_(pa.float64())))]
                else:
                    near = at.argmin(1)
                    more = [("__cell", pa.array(near, pa.int32())), ("__angle", pa.array(at[np.arange(len(at)), near], pa.float64()))]
                for name, values in more:
                    part = part.append_column(name, values)
                yield from part.to_batches()

    new = [T.StructField("__angles", T.ArrayType(T.DoubleType()))] if whole else [T.StructField("__cell", T.IntegerType()), T.StructField("__angle", T.DoubleType())]
    return df.mapInArrow(place, T.StructType([*df.schema.fields, *new]))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows beside the row of table (one for each key) that has their key. Rows of keys that hold much of them stay where they are: their few rows of table are broadcast."""
    counts = rows.groupBy(keys).agg(F.count("*").alias("__n"))
    parts = 4 * min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(BLOCK, (counts.agg(F.sum("__n")).first()[0] or 0) // parts)
    many = written(table.join(counts.where(F.col("__n") > share).drop("__n"), keys, "left_semi"))
    hot = rows.join(F.broadcast(many), keys)
    rest = rows.join(F.broadcast(many.select(keys)), keys, "left_anti").join(table, keys)
    return hot.unionByName(rest)


def near(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float, most: int | None = None, left_vector: str = "v", right_vector: str = "w", least: str | None = None) -> DataFrame:
    """Columns of left and right (both have subject) but their vectors, and score: the pairs of one subject with a cosine of threshold (over 0) or more.

    With most, at least each left row's most best ones (ties: smaller right id) are among what is returned, and no block returns more than most for it. least names a column of left: a score known
    to be reached most times at least, or null; cells that can't reach it aren't compared with the row.
    """
    spark = ship(left.sparkSession)
    wide = F.lit(math.acos(min(1.0, max(-1.0, threshold))) + SLACK)
    if least:
        # A cosine rounded down by MARGIN, so that partners with the very same score stay within the angle.
        wide = F.least(wide, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col(least), F.lit(-1.0)) - MARGIN))) + SLACK)
    r = usable(right, right_id, right_vector)
    pivots = pivots_of(r, right_id, right_vector)
    # Written once: cells are counted, then their rows are dealt.
    r = written(placed(r, right_vector, pivots, False).withColumn("__row", F.monotonically_increasing_id()))
    le = written(placed(usable(left, left_id, left_vector), left_vector, pivots, True).withColumn("__row", F.monotonically_increasing_id()))

    up = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    asked = le.groupBy(KEY).agg(up(F.count("*")).alias("__lefts"))
    cells = r.groupBy(CELL).agg(up(F.count("*")).alias("__rights"), F.min("__angle").alias("__lo"), F.max("__angle").alias("__hi"))
    cells = written(cells.join(asked, KEY))
    by_key = cells.groupBy(*KEY, "__lefts").agg(F.collect_list(F.struct("__cell", "__rights", "__lo", "__hi")).alias("__cells"))

    def possible(c):
        at = lambda i: F.col("__angles")[i]
        return (at(c["__cell"]) <= c["__hi"] + wide) & (at(c["__cell"]) >= c["__lo"] - wide) & (at(c["__cell"]) <= F.array_min("__angles") + 2 * wide)

    deal = lambda n: F.pmod(F.xxhash64("__row"), n).cast("int")
    visits = looked_up(le, by_key, KEY).withColumn("__l", deal(F.col("__lefts"))).select("*", F.explode(F.filter("__cells", possible)).alias("__c")).drop("__angles", "__cells", "__lefts")
    visits = visits.select("*", F.col("__c.__cell").alias("__cell"), F.explode(F.sequence(F.lit(0), F.col("__c.__rights") - 1)).alias("__r")).drop("__c", "__row")
    there = looked_up(r.drop("__angle"), cells.drop("__lo", "__hi"), CELL).withColumn("__r", deal(F.col("__rights")))
    there = there.withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("__lefts") - 1))).drop("__rights", "__lefts", "__row")

    own = [f for f in left.schema.fields if f.name != left_vector]
    other = [f for f in right.schema.fields if f.name not in (right_vector, "subject")]
    schema = T.StructType([*own, *other, T.StructField("score", T.DoubleType())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best_of_block(a, b, left_id, right_id, left_vector, right_vector, threshold, most)
        i, j, score = found
        columns = [a[f.name].take(i) for f in own] + [b[f.name].take(j) for f in other] + [pa.array(score, pa.float64())]
        return pa.table(columns, names=schema.names)

    groups = [*CELL, "__l", "__r"]
    return visits.groupBy(groups).cogroup(there.groupBy(groups)).applyInArrow(compare, schema)


def best_of_block(a: pa.Table, b: pa.Table, left_id: str, right_id: str, left_vector: str, right_vector: str, threshold: float, most: int | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Places in a, places in b and scores of a block's pairs."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if a.num_rows and b.num_rows:
        size = a["__size"][0].as_py()
        v, w = matrix(a[left_vector], size), matrix(b[right_vector], size)
        n, m = a["__norm"].to_numpy(), b["__norm"].to_numpy()
        ids, others = a[left_id].to_numpy(), b[right_id].to_numpy()
        order = np.argsort(others, kind="stable")
        v1, w1 = v / n[:, None], (w / m[:, None]).T
        for s in range(0, len(v), STRIP):
            close = v1[s : s + STRIP] @ w1
            close[ids[s : s + STRIP, None] == others[None, :]] = -2.0
            least = np.full(len(close), threshold - MARGIN)
            if most and most < len(others):
                least = np.maximum(least, np.partition(close, -most, axis=1)[:, -most] - MARGIN)
            i, j = np.nonzero(close >= least[:, None])
            i = i + s
            total = np.zeros(len(i))
            for k in range(size):
                total += v[i, k] * w[j, k]
            score = total / (n[i] * m[j])
            good = score >= threshold
            i, j, score = i[good], j[good], score[good]
            if most:
                rank = np.empty(len(others), dtype=np.int64)
                rank[order] = np.arange(len(others))
                sort = np.lexsort((rank[j], -score, i))
                i, j, score = i[sort], j[sort], score[sort]
                first = np.searchsorted(i, i, side="left")
                good = np.arange(len(i)) - first < most
                i, j, score = i[good], j[good], score[good]
            out.append((i, j, score))
    i, j, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.array(i, pa.int64()), pa.array(j, pa.int64()), score


def nearest(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best rows of docs (id, embedding) by positive cosine for each of queries (query_id, vector), ties by id; exact, as search.nearest with a limit.

    A first pass over one row in SHARE, by hash, gives each query a score that k rows reach. With it the second pass leaves out cells that can't hold a better one.
    Cases: as near(); a query's own row is found like any other; query_id must be unique; with fewer than k positive rows in the first pass a query has no such score, and meets all cells.
    """
    asked = queries.where("query_id is not null").select("query_id", "vector")
    right = docs.select("id", F.lit("").alias("subject"), F.col("embedding").alias("w"))
    some = usable(right, "id", "w").where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0).select("id", F.col("w").alias("embedding"))
    reached = search.nearest(some, asked, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("__least")).where(F.col("n") == k).drop("n")
    # near() takes equal ids as one row; a query is none of the rows, and NaN equals no id.
    left = asked.join(reached, "query_id", "left").select(F.col("query_id").alias("__query"), F.lit("").alias("subject"), F.col("vector").alias("v"), "__least", F.lit(float("nan")).alias("__left"))
    found = near(left, right, "__left", "id", 1e-300, k, least="__least")
    return search.top(found.select(F.col("__query").alias("query_id"), "id", "score"), k)
