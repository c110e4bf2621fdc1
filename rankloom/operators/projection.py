"""Learned projections: metric learning by a supervised contrastive loss, two towers, and projected vectors.

A head is one hidden layer of rectified units and a linear layer, its output scaled to length one. Batches of a few labels
with a few rows each (sampling.label_batches) are rows of a written table. An epoch is one pass over them: every batch is
projected and differentiated where it lies, the gradients are added up by Spark in fixed point, so that the sum doesn't
depend on the order of tasks, and the driver, which holds the weights alone, takes one AdamW step. Validation batches are
measured in the same pass; the weights of the smallest validation loss are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.sources.tables import checkpointed

FIXED = 1 << 34  # parts of one that a gradient is added up in
Weights = list[np.ndarray]


@dataclass
class Head:
    """Standardising, hidden layer, output layer, unit length."""

    mean: np.ndarray
    scale: np.ndarray
    weights: Weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, (np.asarray(x, float) - self.mean) / self.scale)[0]


def first_weights(width: int, hidden: int, output: int, gen: np.random.Generator) -> Weights:
    draw = lambda n, *shape: gen.uniform(-1, 1, shape) / np.sqrt(n)
    return [draw(width, width, hidden), draw(width, hidden), draw(hidden, hidden, output), draw(hidden, output)]


def forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Unit vectors, and what backward() needs."""
    h = np.maximum(x @ w[0] + w[1], 0)
    raw = h @ w[2] + w[3]
    size = np.maximum(np.sqrt((raw * raw).sum(1, keepdims=True)), 1e-12)
    return raw / size, (x, h, raw / size, size)


def backward(w: Weights, kept: tuple, dz: np.ndarray) -> Weights:
    """Gradient of the weights from that of the unit vectors."""
    x, h, z, size = kept
    d = (dz - z * (z * dz).sum(1, keepdims=True)) / size
    dh = (d @ w[2].T) * (h > 0)
    return [x.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]


def contrastive(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, temperature: float, exclude_self: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of anchors a against b and its gradients: the mean over anchors of minus the mean log-probability of the rows of
    their label. Anchors without such a row drop out; exclude_self keeps a row from its own comparison."""
    s = a @ b.T / temperature
    same = la[:, None] == lb[None, :]
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
        np.fill_diagonal(same, False)
    used = same.any(1)
    if not used.any():
        return float("nan"), np.zeros_like(a), np.zeros_like(b)
    top = s.max(1, keepdims=True)
    p = np.exp(s - top)
    total = p.sum(1, keepdims=True)
    wanted = same / np.maximum(same.sum(1, keepdims=True), 1)
    with np.errstate(invalid="ignore"):
        loss = -(np.where(same, s, 0) * wanted).sum(1) + (top + np.log(total))[:, 0]
    ds = np.where(used[:, None], p / total - wanted, 0) / used.sum() / temperature
    return float(loss[used].mean()), ds @ b, ds.T @ a


def batch_gradient(towers: list[Weights], left: np.ndarray, right: np.ndarray | None, labels: np.ndarray, temperature: float) -> tuple[float, list[Weights]]:
    """Loss of one batch and the gradient of each tower. One tower compares rows with each other, two compare left with right both ways."""
    z, kept = forward(towers[0], left)
    if right is None:
        loss, da, db = contrastive(z, z, labels, labels, temperature, True)
        return loss, [backward(towers[0], kept, da + db)]
    y, kept_right = forward(towers[1], right)
    one, a1, b1 = contrastive(z, y, labels, labels, temperature, False)
    two, b2, a2 = contrastive(y, z, labels, labels, temperature, False)
    return (one + two) / 2, [backward(towers[0], kept, (a1 + a2) / 2), backward(towers[1], kept_right, (b1 + b2) / 2)]


def scaling(rows: DataFrame, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation by dimension over all the columns' vectors; a deviation of 0 counts as 1."""
    long = rows.select(F.explode(F.array(*columns)).alias("v")).select(F.posexplode("v").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    found = long.groupBy("d").agg(F.round(F.avg("x"), 10).alias("m"), F.round(F.stddev_pop("x"), 10).alias("s")).orderBy("d").collect()  # a row a dimension
    s = np.array([r.s for r in found])
    return np.array([r.m for r in found]), np.where(s == 0, 1.0, s)


def packed_batches(batches: DataFrame, rows: DataFrame, label: str, row_id: str, left: str, right: str | None = None) -> DataFrame:
    """(batch, labels, left[, right]): each batch of label_batches() as one row, in order of label and slot."""
    columns = [c for c in (left, right) if c]
    joined = batches.select("batch", label, "slot", row_id).join(rows.select(row_id, *columns), row_id)
    members = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "slot", *(F.transform(c, lambda x: x.cast("double")).alias(f"v{i}") for i, c in enumerate(columns)))))
    one = joined.groupBy("batch").agg(members.alias("m"))
    code = F.transform("m", lambda r: F.xxhash64(r["label"]))
    return one.select("batch", code.alias("labels"), *(F.col(f"m.v{i}").alias(n) for i, n in zip(range(len(columns)), ("left", "right"), strict=False)))


def _pass(table: DataFrame, towers: list[Weights], mean: np.ndarray, scale: np.ndarray, temperature: float) -> tuple[np.ndarray, dict[bool, float]]:
    """(mean gradient of the training batches, mean loss by whether a batch is for validation), in one job."""
    size = sum(w.size for t in towers for w in t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 4, np.int64)  # gradient; loss and number of training, then of validation batches
        for batch in batches:
            sides = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("labels", "left", "right", "validation")]
            for labels, left, right, validation in zip(*sides, strict=True):
                x, y = ((np.array(v, float) - mean) / scale if v is not None else None for v in (left, right))
                loss, grads = batch_gradient(towers, x, y, np.array(labels), temperature)
                if not np.isfinite(loss):
                    continue
                at = size + 2 * bool(validation)
                total[at : at + 2] += (round(loss * FIXED), 1)
                if not validation:
                    total[:size] += np.rint(np.concatenate([g.ravel() for t in grads for g in t]) * FIXED).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["at", "value"])

    sums = table.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # a row a weight
    out = np.zeros(size + 4)
    for r in sums:
        out[r["at"]] = float(r["value"])
    losses = {v: out[size + 2 * v] / FIXED / out[size + 2 * v + 1] if out[size + 2 * v + 1] else float("nan") for v in (False, True)}
    return out[:size] / FIXED / max(out[size + 1], 1.0), losses


def fit(
    batches: DataFrame, validation: DataFrame, width: int, mean: np.ndarray, scale: np.ndarray, hidden: int = 32, output: int = 16, temperature: float = 0.1,
    rate: float = 1e-2, decay: float = 1e-4, epochs: int = 40, patience: int = 8, seed: int = 0,
) -> tuple[list[Head], list[tuple[int, float, float]]]:
    """(heads, history of (epoch, training loss, validation loss)) from packed batches; one head, or two where there is a right side."""
    sides = 2 if "right" in batches.columns else 1
    gen = np.random.default_rng(seed)
    towers = [first_weights(width, hidden, output, gen) for _ in range(sides)]
    table = checkpointed(batches.withColumn("validation", F.lit(False)).unionByName(validation.withColumn("validation", F.lit(True))))
    flat = np.concatenate([w.ravel() for t in towers for w in t])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    best, kept, waited, history = np.inf, flat.copy(), 0, []
    for epoch in range(epochs):
        grad, losses = _pass(table, _shaped(flat, towers), mean, scale, temperature)
        history.append((epoch, losses[False], losses[True]))
        if losses[True] < best:
            best, kept, waited = losses[True], flat.copy(), 0
        else:
            waited += 1
            if waited >= patience:
                break
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        step = first / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        flat = flat - rate * (step + decay * flat)
    return [Head(mean, scale, t) for t in _shaped(kept, towers)], history


def _shaped(flat: np.ndarray, like: list[Weights]) -> list[Weights]:
    out, at = [], 0
    for tower in like:
        own = []
        for w in tower:
            own.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        out.append(own)
    return out


def project(df: DataFrame, vector: str, head: Head, out: str = "projected") -> DataFrame:
    """`df` with the projected vector."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(vector))
            there = column.is_valid().to_numpy(zero_copy_only=False)
            flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
            z = head(flat.reshape(-1, len(head.mean))) if len(flat) else np.zeros((0, head.weights[2].shape[1]))
            at = np.r_[0, np.cumsum(there * z.shape[1])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(z.ravel()), mask=pa.array(~there)) if len(there) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def linear(vector: str, matrix: list[list[float]]) -> Column:
    """A column's vectors times a fixed matrix (rows by dimension of the vector)."""
    columns = [F.array(*(F.lit(float(v)) for v in c)) for c in zip(*matrix, strict=True)]
    dot = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)
    return F.array(*(dot(c) for c in columns))
