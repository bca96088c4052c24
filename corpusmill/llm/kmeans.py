"""Centroid clustering in exact integers by exponion search.

Every vector keeps an upper bound on the distance to its own centroid and a lower
bound on that to any other.  A pass loosens both by how far centroids moved, and
only where they no longer tell the nearest apart does it measure the own centroid
anew and then scan the centroids in a ball around that one: those no further from
it than twice the upper bound plus its own nearest neighbour's distance, found by
bisection in its sorted list of inter-centroid distances.  The ball holds the
nearest and the second nearest centroid; its radius is inclusive and bounds are
widened by more than rounding can take away, so a tie is always measured, and the smaller number wins.

A pass reads the state the last one wrote to the shared folder and writes the next;
sums of components are aggregated by Spark; what the driver sees is one row of sums for each centroid.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part; a vector without ``vec_id`` is assigned but
never starts a centroid, as it has no hash; repeated rows count each and may start several
centroids, of which the first keeps all their vectors; with fewer vectors than centroids there are fewer
centroids; an empty table gives an empty result; components beyond ``LARGEST``
once scaled end the query with an error, as distances would not fit a long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batches, begin, stage, table

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
LARGEST = 1 << 27
EXACT = 1 << 21  # up to here every sum of 64 products is exact in double precision
SLACK = 1e-9  # far above what rounding can move a bound by in a few passes

_STATE = pa.schema(
    [("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("scanned", pa.int64())]
)
_STATE_DDL = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, scanned long"


def integer_vectors(df: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and the components of ``embedding``, each the floor of ``scale`` times it."""
    e = F.col("embedding")
    infinity = F.lit(float("inf"))
    kept = df.filter(F.size(e) == size).filter(F.forall(e, lambda x: F.coalesce((x > -infinity) & (x < infinity), F.lit(False))))
    v = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    too_large = F.exists(v, lambda x: F.abs(x) > LARGEST)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(too_large, F.raise_error(F.lit("a component is too large"))).otherwise(F.transform(v, lambda x: x.cast("int"))).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of ``x`` and of ``c``, both of long."""
    if max(abs(x).max(initial=0), abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


class Centroids:
    """Centroids of one pass with what exponion asks of them: sorted lists of the others by distance, and how far each moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        # a centroid's own place comes first in its list, also where others lie on it
        own = np.arange(len(now))
        self.order = np.stack([np.concatenate([[j], row[row != j]]) for j, row in zip(own, self.order)])
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if len(now) > 1 else np.full(1, np.inf)
        moved = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64))
        self.moved = moved
        others = np.sort(moved)
        self.most_moved = np.where((moved == others[-1]) & (len(now) > 1), others[-2] if len(now) > 1 else 0.0, others[-1])

    def all(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, bounds and squared distance of vectors about which nothing is known."""
        d = squared(x, self.at)
        cluster = d.argmin(1)  # the first of equals
        best = d[np.arange(len(x)), cluster]
        lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
        return cluster, np.sqrt(best.astype(np.float64)), lower, best, np.full(len(x), d.shape[1])

    def step(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measure: bool) -> tuple[np.ndarray, ...]:
        """The same from the bounds of the pass before; ``measure`` asks for every distance."""
        cluster, distance, scanned = cluster.copy(), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = (lower - self.most_moved[cluster]) * np.where(lower > self.most_moved[cluster], 1 - SLACK, 1 + SLACK)
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        loose = np.flatnonzero((upper >= safe) | measure)
        d = np.zeros(len(loose), np.int64)
        for a in np.unique(cluster[loose]):
            rows = np.flatnonzero(cluster[loose] == a)
            d[rows] = squared(x[loose[rows]], self.at[a : a + 1])[:, 0]
        upper[loose], distance[loose] = np.sqrt(d.astype(np.float64)), d
        scanned[loose] += 1
        still = loose[upper[loose] * (1 + SLACK) >= safe[loose]]
        for a in np.unique(cluster[still]):
            rows = still[cluster[still] == a]
            radius = (2 * upper[rows] + self.nearest[a]) * (1 + SLACK)
            inside = np.searchsorted(self.sorted[a], radius, "right")
            near = self.order[a, : inside.max()]
            found = squared(x[rows], self.at[near])
            found[np.arange(len(near)) >= inside[:, None]] = np.iinfo(np.int64).max
            scanned[rows] += inside
            best = found.min(1)
            number = np.where(found == best[:, None], near, len(self.at)).min(1)
            cluster[rows], distance[rows], upper[rows] = number, best, np.sqrt(best.astype(np.float64))
            lower[rows] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(np.float64)) if len(near) > 1 else np.inf
        return cluster, upper, lower, distance, scanned


def _pass(centroids: Centroids, size: int, first: bool, measure: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in parts:
            if not len(b):
                continue
            v = b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            if first:
                cluster, upper, lower, distance, scanned = centroids.all(x)
            else:
                known = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                cluster, upper, lower, distance, scanned = centroids.step(x, *known, measure)
                scanned = scanned + b.column(6).to_numpy(zero_copy_only=False)
            yield batches({"vec_id": b.column(0), "v": v, "cluster": pa.array(cluster, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower), "distance": pa.array(distance), "scanned": pa.array(scanned)}, _STATE)

    return run


def _updated(state: DataFrame, now: np.ndarray, size: int) -> np.ndarray:
    """Every centroid that has vectors moves to the floor of their mean."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(size)]).alias("sums"))
    out = now.copy()
    for r in sums.collect():  # at most one row a centroid
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``v``, ``cluster``, squared ``distance``, ``scanned``) of all integer ``vectors``, and the final centroids.

    ``scanned`` counts the centroids a vector was measured against in all passes; without bounds it would be ``centroids * (rounds + 1)``.
    """
    vectors = stage(vectors, "cluster-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.filter("vec_id IS NOT NULL").select(drawn.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()
    if not starts:
        return vectors.limit(0).select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("scanned")), np.zeros((0, size), np.int64)
    now = np.array([r.v for r in starts], np.int64)
    state = stage(vectors.mapInArrow(_pass(Centroids(now), size, True, False), _STATE_DDL), "cluster-state")
    for k in range(rounds):
        before, now = now, _updated(state, now, size)
        state = stage(state.mapInArrow(_pass(Centroids(now, before), size, False, k == rounds - 1), _STATE_DDL), "cluster-state")
    return state.select("vec_id", "v", "cluster", "distance", "scanned"), now


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in forty clusters, five rounds from centroids drawn by hash."""
    placed, centres = cluster(integer_vectors(table(spark, sf_dir, "embeddings")))
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = placed.agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("whole"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centres.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    about = inertia.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(whole))  # at most a row a centroid, and one row
    return placed.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", F.col("own").cast("long").alias("cluster_inertia"), F.col("whole").cast("long").alias("inertia"), "centroid_sha256"
    )
