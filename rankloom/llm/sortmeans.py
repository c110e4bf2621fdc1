"""Sort-means: exact k-means in integers that looks only at centroids near the one a vector had before.

Each round orders, for each centroid, the others by their distance from it. A vector is first measured against its
previous centroid; the others are then scanned in that order and the scan stops strictly beyond twice that distance:
by the triangle inequality no later centroid can be nearer or as near. So the clusters are those of a full scan.

A round is one pass over the vectors, which are dealt as they lie, without a shuffle and without a key. It writes each
vector with its cluster, and for each task the sums of its clusters as further rows of the same table, so that the next
centroids come from a few rows. Only centroids (k times dims integers) and their sums reach the driver. The table of the
round before is deleted as soon as the next is written.

Components become floor(scale * x) exactly. Where an integer is so large that a squared distance might not fit 64 bits,
Python's own integers are used for that batch, with the same result.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite component take no
part; among equal hashes (rows that share a vec_id) the vector whose components come first in order starts; rows with a
null vec_id are clustered like others but are the last to start; with fewer vectors than k there are as many centroids as
vectors; a distance or inertia that doesn't fit a long is null; repeated rows are clustered each for itself; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_written, ready, written

K, DIMS, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
_STATE = ["vec_id", "embedding", "cluster", "place", "limb", "total"]
Centroids = list[list[int]]


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    sound = "size(embedding) = {} and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return own.filter("embedding is not null").filter(sound.format(dims))


def fits(dims: int) -> int:
    """Integers below this have squared distances of which four fit 64 bits."""
    return math.isqrt((1 << 62) // (16 * dims))


def integers(column: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, a row a vector; Python integers where 64 bits might not do."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    if not x.size or np.abs(whole).max() < fits(dims):
        return whole.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], object).reshape(-1, dims)


def _array(centroids: Centroids, dims: int) -> np.ndarray:
    small = all(abs(v) < fits(dims) for row in centroids for v in row)
    return np.array(centroids, np.int64 if small else object).reshape(-1, dims)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector; ties go to the smaller number. before: where each was."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    cluster, distance = before.copy(), np.zeros(len(x), x.dtype)
    for old in np.unique(before).tolist():
        rows = np.flatnonzero(before == old)
        apart = _squared(centroids, centroids[old])
        own = _squared(x[rows], centroids[old])
        best, at, going = own.copy(), np.full(len(rows), old), np.arange(len(rows))
        for other in sorted((i for i in range(len(centroids)) if i != old), key=lambda i: (apart[i], i)):
            going = going[(4 * own[going] >= apart[other]).astype(bool)]
            if not len(going):
                break
            d = _squared(x[rows[going]], centroids[other])
            wins = ((d < best[going]) | (d == best[going]) & (other < at[going])).astype(bool)
            best[going[wins]], at[going[wins]] = d[wins], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _step(centroids: Centroids, dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their new cluster, then the task's sums: (cluster, place, limb, total), place -1 for the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centroids, dims)
        totals, kind = np.zeros((len(c), dims + 1), object), None
        for batch in batches:
            kind = batch.schema.field("embedding").type
            x = integers(batch.column("embedding"), dims, scale)
            cluster, _ = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False), c)
            for k in np.unique(cluster).tolist():
                mine = cluster == k
                totals[k, :dims] += x[mine].sum(axis=0)
                totals[k, dims] += int(mine.sum())
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(cluster, pa.int32()), none, none, none.cast(pa.int64())], _STATE)
        if kind is not None:
            sums = [(k, -1 if i == dims else i, *limb) for k in np.flatnonzero(totals[:, dims] > 0).tolist() for i in range(dims + 1) for limb in _limbs(int(totals[k, i]))]
            own = [pa.array(c, t) for c, t in zip(zip(*sums, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.int64()), pa.nulls(len(sums), kind), *own], _STATE)

    return run


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value) of a total in base 2**62, so that sums of any size are added up by Spark."""
    sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
    while rest or not place:
        yield place, sign * (rest & ((1 << 62) - 1))
        rest, place = rest >> 62, place + 1


def starts(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Centroids:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(name.alias("name"), "embedding").orderBy(F.col("name").asc_nulls_last(), "embedding").limit(k).collect()
    return integers(pa.array([list(r.embedding) for r in first], pa.list_(pa.float64())), dims, scale).tolist()


def fit(vectors: DataFrame, centroids: Centroids, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Centroids, DataFrame]:
    """(final centroids, vectors with the cluster each had in the last round); the vectors' table is a written one."""
    dims = len(centroids[0])
    kind = dict(vectors.dtypes)["embedding"]
    state, old = vectors.withColumn("cluster", F.lit(0)), None
    for _ in range(rounds):
        table = written(state.mapInArrow(_step(centroids, dims, scale), f"vec_id long, embedding {kind}, cluster int, place int, limb int, total long"), "vectors")
        if old is not None:
            drop_written(old)
        sums = table.filter("place is not null").groupBy("cluster", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        by: dict[tuple[int, int], int] = defaultdict(int)  # k x (dims + 1) numbers
        for r in sums:
            by[r.cluster, r.place] += int(r.total) << 62 * r.limb
        centroids = [[by[k, i] // by[k, -1] for i in range(dims)] if (k, -1) in by else c for k, c in enumerate(centroids)]
        state, old = table.filter("place is null").select("vec_id", "embedding", "cluster"), table
    return centroids, state


def label(vectors: DataFrame, centroids: Centroids, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of vectors that have a cluster already; a distance that doesn't fit a long is null."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centroids, dims)
        for batch in batches:
            cluster, distance = assign(integers(batch.column("embedding"), dims, scale), batch.column("cluster").to_numpy(zero_copy_only=False), c)
            long = pa.array([v if v < 1 << 63 else None for v in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), long], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = ready(vectors.sparkSession)
    own = kept(vectors, dims)
    first = starts(own, k, dims, scale, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, state = fit(own, first, rounds, scale)
    labelled = written(label(state, centroids, scale), "clusters")
    if rounds:
        drop_written(state)
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.total for r in labelled.groupBy("cluster").agg(whole.alias("total")).collect()}  # k rows
    long = lambda v: int(v) if v is not None and v < 1 << 63 else None
    total = long(sum(sums.values())) if None not in sums.values() else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, long(sums[i]), total, names[i]) for i in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
