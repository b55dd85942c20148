"""Ball k-means: exact k-means that compares a vector with few centroids.

A cluster is a ball: its centroid and the largest distance of a member. In each round

1. the balls follow the centroids that have just moved: a radius grows by the centroid's way at
   most, so no pass over the vectors is spent on it;
2. another centroid is a ball's neighbour only if half of its distance is within the radius; from
   no other can a member be taken;
3. a member nearer to its own centroid than half of the way to the nearest neighbour is in the stable
   core and is compared with none; the rest is split into annuli by the halves of the ways to
   the neighbours in order, and a member of the n-th is compared with the first n neighbours only;
4. Spark adds up the sums, counts and radii that tasks send for the clusters they met.

Components are whole numbers (``floor(scale * x)``), so distances, bounds and sums are exact: where
a half is compared, squares are, and a tie goes to the smaller number. The vectors with their clusters
are written to the shared folder once a round, and the table before is deleted; nothing is shuffled but
a row of sums for each task and cluster. What the driver holds are the centroids.

Defined results for odd input: a vector that is null, of another length, or has a null or
non-finite component is left out; components beyond 2**26 after scaling count as that, so
that distances fit 64 bits; a null vec_id is hashed as no digits; rows that repeat an id are clustered
each and, as first centroids, follow each other in order of their components; fewer vectors than
``k`` give as many centroids, of equal ones the first takes all members; an empty table gives
none; other columns are left out by ``cluster``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settle_at

K, ROUNDS, SEED = 16, 3, 1
DIMENSIONS, SCALE = 64, 64
MOST = 1 << 26
ROWS = 8_192


@dataclass(frozen=True)
class Balls:
    """``centroids``: a row each; ``radii``: bounds of the members' distances, negative where there
    is none; ``near``: per ball its neighbours, the nearest first; ``way``: the squares of their
    distances."""

    centroids: np.ndarray
    radii: np.ndarray
    near: list[np.ndarray]
    way: list[np.ndarray]

    @staticmethod
    def of(centroids: np.ndarray, radii: np.ndarray) -> Balls:
        near, way = [], []
        for i, c in enumerate(centroids):
            square = squares(centroids, c)
            # half of the way within the radius, with a share more than the roots can be off
            mine = np.flatnonzero((np.sqrt(square.astype(float)) <= 2 * radii[i] * (1 + 1e-9) + 1e-6) & (np.arange(len(centroids)) != i))
            mine = mine[np.argsort(square[mine], kind="stable")]
            near.append(mine)
            way.append(square[mine])
        return Balls(centroids, radii, near, way)

    def moved(self, centroids: np.ndarray, reach: np.ndarray) -> Balls:
        """The balls around moved centroids; ``reach``: the squares of the members' largest distances
        to the old ones, -1 without members."""
        step = np.sqrt(squares(centroids, self.centroids).astype(float))
        return Balls.of(centroids, np.where(reach < 0, -1.0, np.sqrt(np.maximum(reach, 0).astype(float)) + step))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in whole numbers."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign(x: np.ndarray, own: np.ndarray | None, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, the square of its distance, and how many distances were
    looked at. ``own``: the clusters so far, None at first."""
    c, n = balls.centroids, 0
    if own is None:
        best, at = squares(x, c[0]), np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            d = squares(x, c[j])
            closer = d < best
            best, at = np.where(closer, d, best), np.where(closer, j, at)
        return at, best, len(x) * len(c)
    at, best = own.copy(), squares(x, c[own])
    n += len(x)
    for i in np.unique(own).tolist():
        mine = np.flatnonzero(own == i)
        d = best[mine]
        # the core is nearer than half of any way; annulus m reaches to the half of the m-th
        annulus = np.searchsorted(balls.way[i], 4 * d, "right")
        for m, j in enumerate(balls.near[i].tolist()):
            ring = mine[annulus > m]
            if not len(ring):
                break
            n += len(ring)
            other = squares(x[ring], c[j])
            closer = (other < best[ring]) | ((other == best[ring]) & (j < at[ring]))
            best[ring[closer]], at[ring[closer]] = other[closer], j
    return at, best, n


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def points(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that count, in whole numbers."""
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of seed and id, in its order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def _assigned(rows: DataFrame, balls: Balls, before: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                at, d, _ = assign(_matrix(b.column("v")), b.column("cluster").to_numpy().astype(np.int64) if before else None, balls)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", *(["cluster"] if before else [])).mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def totals(assigned: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cluster the sums of components, the number of members and the largest distance (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, reach = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64)
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                at, x = b.column("cluster").to_numpy(), _matrix(b.column("v"))
                for i in np.unique(at).tolist():
                    sums[i] += x[at == i].sum(0)
                n += np.bincount(at, minlength=k)
                np.maximum.at(reach, at, b.column("distance").to_numpy())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(reach[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "reach", "sums"])

    sent = assigned.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, reach long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]
    sums, n, reach = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64)
    for r in sent.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), *added).collect():
        n[r["cluster"]], reach[r["cluster"]] = r["n"], r["reach"]
        sums[r["cluster"]] = [r[f"s{i}"] for i in range(dimensions)]
    return sums, n, reach


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, v, cluster, distance`` after ``rounds`` moves of the centroids, and these."""
    spark = vectors.sparkSession
    rows, at_rows = settle_at(points(vectors, dimensions, scale))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), centroids
    balls = Balls(centroids, np.empty(0), [], [])
    for r in range(rounds + 1):
        now, at_now = settle_at(_assigned(rows, balls, r > 0))
        discard(spark, at_rows)
        rows, at_rows = now, at_now
        if r < rounds:
            sums, n, reach = totals(rows, len(centroids), dimensions)
            moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
            balls, centroids = balls.moved(moved, reach), moved
    return rows, centroids


def summary(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clustered`` without components, with the sums of distances over its cluster and over all, and
    the digest of its cluster's centroid; a row a cluster is joined."""
    spark = clustered.sparkSession
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = {r["cluster"]: r["s"] for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in digest]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
