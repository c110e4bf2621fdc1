"""Sort-means against a full scan in Python integers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np

from rankloom.llm import sortmeans

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, dims, rounds, scale=1024, seed=3):
    """Rows of cluster() by comparing every vector with every centroid."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = defaultdict(int)
    for _, d, n in found:
        by[n] += d
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, n, fits(d), fits(by[n]), fits(sum(by.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_a_full_scan(spark):
    r = random.Random(0)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.5, 1.0, r.gauss(0, 1)]) for _ in range(5)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 3 + [(900 + i, rows[9][1]) for i in range(60)]  # repeated rows, many equal vectors
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
        exact = [(i, [float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
        assert got(sortmeans.cluster(df, k=6, dims=5, rounds=6)) == brute(exact, 6, 5, 6)


def test_ties_and_the_strict_stop(spark):
    """On a small grid many vectors are as far from several centroids, at twice the distance and at it exactly."""
    rows = [(i * 7 + j, [float(i), float(j)]) for i in range(7) for j in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 3, 8):
        assert got(sortmeans.cluster(df, k=k, dims=2, scale=1, rounds=5)) == brute(rows, k, 2, 5, 1)


def test_assign_looks_at_no_more_than_it_must():
    r = np.random.default_rng(0)
    x, c = r.integers(-3, 4, (4000, 3)), r.integers(-3, 4, (9, 3))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    for before in (np.zeros(4000, np.int32), r.integers(0, 9, 4000).astype(np.int32)):
        cluster, distance = sortmeans.assign(x, before, c)
        assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_large_integers_stay_exact(spark):
    rows = [(1, [3.0e38, -3.0e38]), (2, [-2.5e38, 1.0]), (3, [1.0, 2.0]), (4, [1.5, 2.0]), (5, [-1.0e9, 4.0]), (6, [1.0e305, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(sortmeans.cluster(df, k=3, dims=2, rounds=4)) == brute(rows, 3, 2, 4)
    near = [(i, [float(i * 10**5), 0.0]) for i in range(40)]  # about the bound of 64-bit arithmetic
    assert got(sortmeans.cluster(spark.createDataFrame(near, "vec_id long, embedding array<double>"), k=3, dims=2, rounds=4)) == brute(near, 3, 2, 4)


def test_rows_that_take_no_part_and_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [3.0, 1.0]), (7, [-float("inf"), 0.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, cluster int, total string, Place int")
    assert got(sortmeans.cluster(df, k=8, dims=2, rounds=3)) == brute(rows, 8, 2, 3)
    empty = sortmeans.cluster(df.filter("false"), k=8, dims=2)
    assert got(empty) == [] and [t for _, t in empty.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


def test_query_equals_its_brute_force(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    from rankloom.llm import registry

    assert got(registry.QUERIES["op11_sort_means"](spark, tiny)) == brute(rows, 8, 64, 10)
