"""Centroid clustering of integer vectors, with a table of pivot distances that spares exact distances.

Vectors become integers and are written once with their distances to a few fixed pivots. In each round, a pivot's distances
to a vector and to a centroid differ by no more than vector and centroid do; the largest difference over the pivots
is a lower bound. A vector is first measured exactly against the centroid of the lowest bound, then against those whose
bound doesn't exceed what it has. So assignments are those of plain search, to the last tie.

Each round is a map over the table: tasks give sums and counts by cluster, Spark adds them, and k centroids come back.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out, as the rule
has it; components beyond +-131,072 count as that, so that distances fit a long; repeated ids are separate vectors; vectors
without an id are assigned but are no first centroid before those with one; fewer vectors than ``k`` start as many centroids; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE, LIMIT = 1024, 1 << 27
PIVOTS, PIVOT_CANDIDATES = 8, 128
#: Vectors that are measured at a time.
STEP = 4096
TABLE = "vec_id long, code binary, pivot_distances binary"


def integers(vector: str, size: int) -> Column:
    """floor(1024 x) of each component, null where the vector doesn't count."""
    inf = float("inf")
    x = F.col(vector).cast("array<double>")
    sound = (F.size(x) == size) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))
    clipped = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c * SCALE).cast("double")))
    return F.when(sound, F.transform(x, lambda c: clipped(c).cast("int")))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (int64) to y, which broadcasts."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def choose_pivots(candidates: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The first candidate, then each time the one farthest from those chosen."""
    if not len(candidates):
        return candidates
    chosen, far = [0], squared(candidates, candidates[0])
    while len(chosen) < min(count, len(candidates)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(candidates, candidates[chosen[-1]]))
    return candidates[chosen]


def nearest(x: np.ndarray, table: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances made) of each row of x, whose pivot distances table holds."""
    own = np.sqrt(squared(centroids[:, None], pivots[None]).astype(float))
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(table[:, p, None] - own[None, :, p]), out=bound)
    # roundings of the roots: a bound is lowered by far more than they amount to
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0) ** 2
    first = bound.argmin(1)
    cluster, best = first.copy(), squared(x, centroids[first])
    made = len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        made += len(rows)
        d = squared(x[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = c, d[better]
    return cluster, best, made


def _arrays(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, pivot distances) of a batch of TABLE."""
    code, dist = (b"".join(b.column(k).to_pylist()) for k in (1, 2))
    return np.frombuffer(code, "<i4").reshape(b.num_rows, size).astype(np.int64), np.frombuffer(dist, "<f8").reshape(b.num_rows, -1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """TABLE of vectors (vec_id, x array<int>), written to the shared folder."""
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, size)
            dist = np.sqrt(squared(x.astype(np.int64)[:, None], shipped.value[None]).astype(float))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (x.astype("<i4"), dist.astype("<f8")))],
                names=["vec_id", "code", "pivot_distances"],
            )

    return stored(vectors.mapInArrow(run, TABLE), "pivots")


def _sums(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty cluster. A row for each cluster and component comes back."""
    shipped = table.sparkSession.sparkContext.broadcast((pivots, centroids))
    size = centroids.shape[1]

    def run(batches):
        pivots, centroids = shipped.value
        sums, counts = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                x, dist = _arrays(b.slice(at, STEP), size)
                cluster, _, _ = nearest(x, dist, pivots, centroids)
                for c in np.unique(cluster):
                    sums[c] += x[cluster == c].sum(0)
                counts += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>")
    single = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    total = single.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(total.collect()):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def clusters(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    size: int = 64,
    seed: str = "3",
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. First centroids are the k vectors of the
    smallest sha256 of "<seed>:<vec_id>"."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(vector, size).alias("x")).where("x IS NOT NULL")
    hashed = kept.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    firsts = hashed.orderBy(F.col("h").asc_nulls_last(), "x").limit(max(k, PIVOT_CANDIDATES)).collect()
    start = np.array([r["x"] for r in firsts], np.int64).reshape(-1, size)
    centroids, pivots = start[:k], choose_pivots(start)
    table = pivot_table(kept, pivots, size)
    for _ in range(rounds if len(start) else 0):
        for c, (n, sums) in _sums(table, pivots, centroids).items():
            centroids[c] = [s // n for s in sums]
    shipped = spark.sparkContext.broadcast((pivots, centroids))

    def assign(batches):
        pivots, centroids = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                cluster, distance, _ = nearest(*_arrays(part, size), pivots, centroids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    assigned = table.mapInArrow(assign, "vec_id long, cluster int, distance long")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    of = {r["cluster"]: int(r["d"]) for r in inertia}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # k rows
    top = (1 << 63) - 1
    known = spark.createDataFrame(
        [(c, min(of[c], top), min(sum(of.values()), top), digest[c]) for c in sorted(of)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    out = assigned.join(F.broadcast(known), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
