"""Clustering and neighbour search against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import kmeans, neighbours

NAN, INF = float("nan"), float("inf")


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (spread * rng.standard_normal(size)).tolist()) for k in range(n)]


def lloyd(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), at


@pytest.mark.parametrize("spread", [1.0, 0.004, 40000.0])
def test_exponion_equals_plain_rounds(spark, spread):
    """Small spreads give few distinct integer vectors, so many ties; large ones leave double precision."""
    rows = vectors(300, 5, 1, spread)
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [1.0] * 4 + [NAN]), (304, [INF] + [0.0] * 4), (305, [None] + [0.0] * 4), (306, [0.0] * 5), (7, rows[7][1]), (None, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(1) for n in ("v", "cluster", "h", "distance", "upper")})
    got, centres = kmeans.cluster(kmeans.integer_vectors(df, size=5), centroids=12, rounds=4, size=5)
    want, at = lloyd(rows, 5, 12, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert centres.tolist() == at


def test_balls_are_smaller_than_all_centroids(spark):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((20, 8)) * 3
    rows = [(k, (middles[k % 20] + 0.05 * rng.standard_normal(8)).tolist()) for k in range(2000)]
    got, _ = kmeans.cluster(kmeans.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=8), centroids=20, rounds=5, size=8)
    assert got.agg(F.avg("scanned")).first()[0] < 0.5 * 20 * 6


def test_too_large_components_and_empty_tables(spark):
    big = spark.createDataFrame([(1, [1e30] * 5)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        kmeans.integer_vectors(big, size=5).collect()
    got, centres = kmeans.cluster(kmeans.integer_vectors(big.limit(0), size=5), size=5)
    assert got.collect() == [] and len(centres) == 0


def usable(rows):
    return sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})


def brute(rows, every, k):
    kept = usable(rows)
    out = []
    for i, v in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i)[:k]
            out += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


AWKWARD = [(900, None), (901, []), (902, [0.0] * 6), (903, [NAN] + [1.0] * 5), (904, [1.0, -INF]), (905, [None, 1.0]), (None, [1.0] * 6), (905, [2.0, 1.0]), (906, [1.0] * 9), (40, [3.0] * 6)]


def test_neighbours_of_one_block_are_exact(spark):
    """Copies, repeated rows, ties, vectors of other lengths and norms, ids of two vectors."""
    rows = vectors(150, 6, 5) + [(k, [0.25] * 6) for k in range(200, 240)] + AWKWARD
    rows += [rows[0], rows[20], (20, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("clash") for n in ("key", "node", "small", "query", "score", "uses")})
    assert found(neighbours.nearest(df, 10, k=7)) == brute(rows, 10, 7)


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 1.0])]
    assert found(neighbours.nearest(spark.createDataFrame(few, schema), 2)) == brute(few, 2, 20)
    assert found(neighbours.nearest(spark.createDataFrame(few[:1], schema), 1)) == []
    assert found(neighbours.nearest(spark.createDataFrame([], schema), 1)) == []


def test_recall_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((12, 24))
    rows = [(k, (middles[k % 12] * 0.5 + rng.standard_normal(24) * (1 + k % 3)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(neighbours.nearest(df, 20, leaf=300)), brute(rows, 20, 20)
    assert len(got) == len(want)
    pairs = {(q, v) for q, _, v, _ in want}
    assert sum((q, v) in pairs for q, _, v, _ in got) >= 0.9 * len(want)
    scores = {r[0]: np.array(r[1]) for r in rows}
    assert all(abs(s - scores[q] @ scores[v]) < 1e-8 for q, _, v, s in got)
