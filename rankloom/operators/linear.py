"""One pooled linear fit over a table of any size, by Newton's method with distributed sums.

In each round every task adds up the gradient, the Hessian and the loss of its rows; Spark adds the tasks' sums by place and
the driver, which holds the weights alone, solves for the step. Where the loss has risen the step is halved. The results
equal those of models.logistic_fit() and models.svc_fit(), which fit one group in one task. Scores are plain expressions.

Defined results: rows whose features or label are null take no part in a fit and have a null score; a constant feature is
left as it is (deviation 1); a fit of one class raises; the number of features, whose square travels a task, is the
caller's to bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text, vector
from rankloom.operators import metrics
from rankloom.sources.tables import checkpointed


@dataclass
class Fit:
    """Weights of standardised features, the last one the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    kind: str

    def decision(self, features: str) -> Column:
        """The linear value of a row."""
        w = self.weights[:-1] / self.scale
        start = float(self.weights[-1] - (self.mean * w).sum())
        products = F.zip_with(features, F.array(*(F.lit(float(v)) for v in w)), lambda x, v: x.cast("double") * v)
        return F.when(F.col(features).isNotNull(), F.aggregate(products, F.lit(start), lambda s, x: s + x))

    def score(self, features: str) -> Column:
        """Probability of class 1, or the decision value of an svc."""
        z = self.decision(features)
        return z if self.kind == "svc" else F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)))))


def _sums(table: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, kind: str, weight: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the data at w, without the penalty. weight: of rows of class 0 and 1."""
    k = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
            own, t, v = np.where(y == 1, weight[1], weight[0]), 2 * y - 1, z @ w
            if kind == "svc":
                gap = np.maximum(1 - t * v, 0)
                loss, slope, bend = own * gap * gap, -2 * own * t * gap, 2 * own * (gap > 0)
            else:
                p = 1 / (1 + np.exp(-np.clip(v, -35, 35)))
                loss, slope, bend = own * np.logaddexp(0, -t * v), own * (p - y), own * p * (1 - p)
            total += np.concatenate([[loss.sum()], z.T @ slope, ((z * bend[:, None]).T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

    out = np.zeros(1 + k + k * k)
    for r in table.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # (k + 1) squared numbers
        out[r["at"]] = r["v"]
    return out[0], out[1 : 1 + k], out[1 + k :].reshape(k, k)


def fit(rows: DataFrame, features: str, label: str, kind: str = "logistic", c: float = 1.0, balanced: bool | None = None, rounds: int = 100, keep: bool = True) -> Fit:
    """Logistic (free intercept) or svc (squared hinge, penalised intercept, classes balanced unless told otherwise) with L2 penalty 1/c.

    keep: read the rows once into a written table; otherwise every round computes them again.
    """
    if kind not in ("logistic", "svc"):
        raise ValueError(f"unknown model {kind!r}")
    table = rows.select(F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(label).cast("double").alias("y")).filter("x is not null and y is not null")
    table = checkpointed(table) if keep else table
    count = {float(r["y"]): r["count"] for r in table.groupBy("y").count().collect()}
    if set(count) != {0.0, 1.0}:
        raise ValueError(f"a fit needs labels 0 and 1, got {sorted(count)[:5]}")
    n = sum(count.values())
    # two passes over centred values: no cancellation
    long = table.select(F.posexplode("x").alias("d", "v"))
    means = long.groupBy("d").agg(F.avg("v").alias("m"))
    mean = np.array([r.m for r in means.orderBy("d").collect()])
    centred = table.select(F.posexplode(F.zip_with("x", F.array(*(F.lit(float(m)) for m in mean)), lambda a, b: (a - b) * (a - b))).alias("d", "v"))
    scale = np.sqrt(np.array([r.s for r in centred.groupBy("d").agg((F.sum("v") / n).alias("s")).orderBy("d").collect()]))
    scale = np.where(scale == 0, 1.0, scale)
    balanced = kind == "svc" if balanced is None else balanced
    weight = tuple(c * (n / (2 * count[v]) if balanced else 1.0) if kind == "svc" else (n / (2 * count[v]) if balanced else 1.0) for v in (0.0, 1.0))
    penalty = np.ones(len(mean) + 1) if kind == "svc" else np.r_[np.full(len(mean), 1.0 / c), 0.0]
    w = step = np.zeros(len(mean) + 1)
    best, size = np.inf, 1.0
    for _ in range(rounds):
        loss, grad, hessian = _sums(table, mean, scale, w, kind, weight)
        loss, grad = loss + 0.5 * (penalty * w * w).sum(), grad + penalty * w
        if loss > best * (1 + 1e-12) + 1e-12 and size > 1e-8:  # the last step went too far: half of it
            size /= 2
            w = before - size * step
            continue
        if np.abs(grad).max() < 1e-9 * max(1.0, n / 1e4) or size <= 1e-8:
            break
        best, before, size = loss, w, 1.0
        step = np.linalg.solve(hessian + np.diag(penalty + (0.0 if kind == "svc" else 1e-10)), grad)
        w = before - step
    return Fit(mean, scale, w, kind)


PROBES = ("left_only", "right_only")


def shortcut_probes(train: DataFrame, test: DataFrame, left: str, right: str, label: str, group: str, c: float = 1.0) -> DataFrame:
    """(probe, pooled_auroc, macro_auc01, n_scored, n_distinct, gap) of fits that see one side of a pair only.

    gap is the distance of the macro from chance: what a score earns without looking at the pair. Columns of `left` and
    `right` are vectors.
    """
    scored = []
    for probe in PROBES:
        x = vector.pair_features(left, right, probe)
        own = fit(train.withColumn("_x", x), "_x", label, c=c)
        scored.append(test.withColumn("_x", x).select(F.lit(probe).alias("probe"), group, label, F.round(own.score("_x"), 12).alias("score")))
    rows = checkpointed(scored[0].unionByName(scored[1]))
    pooled = metrics.group_metrics(rows, ["probe"], label, "score", cuts=64).select("probe", F.col("auroc").alias("pooled_auroc"))
    macro = metrics.macro(metrics.group_metrics(rows, ["probe", group], label, "score"), group, within=["probe"])
    distinct = rows.groupBy("probe").agg(F.countDistinct("score").alias("n_distinct"))
    out = pooled.join(macro, "probe").join(distinct, "probe")
    return out.select("probe", "pooled_auroc", "macro_auc01", "n_scored", "n_distinct", F.abs(F.col("macro_auc01") - 0.5).alias("gap"))


def pair_classifier(train: DataFrame, test: DataFrame, left: str, right: str, label: str, row_id: str, mode: str = "interactions", c: float = 1.0) -> DataFrame:
    """(row_id, score): decision value of one class-balanced svc on the pair features of all rows."""
    x = vector.pair_features(left, right, mode)
    own = fit(train.withColumn("_x", x), "_x", label, "svc", c)
    return test.withColumn("_x", x).select(row_id, own.score("_x").alias("score"))


def composition_pairs(rows: DataFrame, left: str, right: str, alphabet: str) -> DataFrame:
    """`rows` with _left and _right: letter counts of two texts."""
    return rows.withColumns({"_left": text.composition(left, alphabet), "_right": text.composition(right, alphabet)})
