"""Centroid clustering (operator 13): Lloyd's rounds with Elkan's bounds, exact on whole numbers.

Each vector carries, from round to round, an upper bound of the distance to its centroid and a lower bound to each. After centroids move, bounds widen by how far.
A centroid's distance is only computed where its lower bound, and half the distance between it and the vector's own centroid, both don't exceed the upper bound. Distances are
integers (squared); bounds are doubles, rounded outwards at each step, and a centroid is skipped only where it is strictly farther: ties are always seen, and go to the smaller number.

The vectors with their bounds are a table in the shared folder, written anew each round by a map over the one before: no shuffle of vectors, and a lost executor costs no more than its
tasks. Each task adds up what moved between clusters, as rows of the same table (a cluster's each), so sums are never taken over all vectors again; only they are shuffled, to a row a cluster.

Cases: vectors that are null, of another width, or with a null or non-finite component are left out; a null vec_id is a vector like others (it starts no centroid while others can); rows that
repeat a vec_id are vectors each; fewer vectors than centroids give as many centroids as vectors; of equal first centroids the smaller number takes all; an empty table gives an empty table; other
columns are ignored. Components beyond vectors.MOST, and an inertia beyond 64 bits, are errors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .vectors import matrix, scaled, usable

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
STATE = pa.schema([
    ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("distance", pa.int64()),
    ("of", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
])
DDL = "vec_id long, x array<int>, cluster int, upper double, lower array<double>, distance long, of int, n long, sums array<long>"


def outward(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles that the roots of exact squares surely lie between. Conversion and root err by less than two steps together."""
    root = np.sqrt(squared.astype(np.float64))
    low, high = np.nextafter(np.nextafter(root, -np.inf), -np.inf), np.nextafter(np.nextafter(root, np.inf), np.inf)
    return np.maximum(low, 0), high


def squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = x - center
    return np.einsum("ij,ij->i", d, d)


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower with the nearest of centers, the smaller number among equals. Bounds must hold for these centers; arrays may be changed."""
    between = np.stack([outward(squared(centers, c))[0] for c in centers]) / 2  # at most half the distance
    np.fill_diagonal(between, np.inf)

    def near(rows: np.ndarray) -> np.ndarray:
        """Which centers of these rows aren't surely farther than their own."""
        own = cluster[rows]
        out = (lower[rows] <= upper[rows, None]) & (between[own] <= upper[rows, None])
        out[np.arange(len(rows)), own] = False
        return out

    rows = np.flatnonzero(between.min(1)[cluster] <= upper)
    rows = rows[near(rows).any(1)]
    best = squared(x[rows], centers[cluster[rows]])
    lower[rows, cluster[rows]], upper[rows] = outward(best)
    for c in range(len(centers)):
        which = np.flatnonzero(near(rows)[:, c]) if len(rows) else rows
        at = rows[which]
        d = squared(x[at], centers[c])
        below, above = outward(d)
        lower[at, c] = below
        closer = (d < best[which]) | ((d == best[which]) & (c < cluster[at]))
        cluster[at[closer]], upper[at[closer]], best[which[closer]] = c, above[closer], d[closer]
    return cluster, upper, lower


def a_round(centers: np.ndarray, moved: np.ndarray | None, last: bool):
    """A round's map over the state: moved is how far each center went since the last one at most, None in the first. last: exact distances, too."""
    k, width = centers.shape

    def run(batches):
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if moved is None:
                was, cluster = None, np.zeros(len(x), np.int32)
                upper, lower = np.full(len(x), np.inf), np.zeros((len(x), k))
            else:
                was = batch.column("cluster").to_numpy()
                cluster = was.copy()
                upper = np.nextafter(batch.column("upper").to_numpy() + moved[was], np.inf)
                lower = batch.column("lower").flatten().to_numpy().reshape(len(x), k) - moved
                lower = np.maximum(np.nextafter(lower, -np.inf), 0)
            cluster, upper, lower = reassigned(x, cluster, upper, lower, centers)
            went = np.arange(len(x)) if was is None else np.flatnonzero(cluster != was)
            np.add.at(sums, cluster[went], x[went])
            np.add.at(n, cluster[went], 1)
            if was is not None:
                np.subtract.at(sums, was[went], x[went])
                np.subtract.at(n, was[went], 1)
            none = pa.nulls(len(x))
            distance = pa.array(squared(x, centers[cluster])) if last else none.cast(pa.int64())
            offsets = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            columns = [batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel())), distance]
            yield pa.RecordBatch.from_arrays([*columns, *(none.cast(f.type) for f in list(STATE)[6:])], schema=STATE)
        changed = np.flatnonzero(n.astype(bool) | sums.any(1))
        if len(changed):
            none = pa.nulls(len(changed))
            yield pa.RecordBatch.from_arrays([*(none.cast(f.type) for f in list(STATE)[:6]), pa.array(changed, pa.int32()), pa.array(n[changed]), pa.array(list(sums[changed]), pa.list_(pa.int64()))], schema=STATE)

    return run


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared, of the scaled vectors), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of seed:vec_id; in each round vectors are assigned, then centroids with vectors become floors of their means. After the last round vectors are
    assigned once more. Rounds end early where no centroid moves, as the rest would change nothing.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") == width))
    state = stored(vectors.select("vec_id", scaled(F.col("v"), scale).alias("x")).select(*[F.col(f.name) if f.name in ("vec_id", "x") else F.lit(None).cast(t.split()[1]).alias(f.name) for f, t in zip(STATE, DDL.split(", "), strict=True)]))
    first = state.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k)
    centers = np.array([r["x"] for r in first.collect()], np.int64)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centers):
        return spark.createDataFrame([], result)
    sums, n, moved = [[0] * width for _ in centers], [0] * len(centers), None
    for r in range(rounds + 1):
        new = stored(state.mapInArrow(a_round(centers, moved, r == rounds), DDL))
        forget(state)
        state = new.where("of is null")
        state._stored_at = new._stored_at
        if r == rounds:
            break
        # What moved, a number for each cluster and component. Tasks' rows are summed before they are shuffled.
        moves = new.where("of is not null").select("of", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "s"))
        for of, at, s in moves.groupBy("of", "at").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
            if at == 0:
                n[of] += int(s)
            else:
                sums[of][at - 1] += int(s)
        after = np.array([[s // m for s in own] if m else centers[c].tolist() for c, (own, m) in enumerate(zip(sums, n, strict=True))], np.int64)
        moved = outward(np.einsum("ij,ij->i", after - centers, after - centers))[1] * (after != centers).any(1)
        still, centers = not moved.any(), after
        if still:
            new = stored(state.mapInArrow(a_round(centers, moved, True), DDL))
            forget(state)
            state = new.where("of is null")
            break
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    inertia = {row["cluster"]: int(row["s"]) for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()]  # k at most
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
