"""Weight matrices, linear and small network models, fitted where the rows are: one group, one task.

Networks and linear heads are plain numpy with full determinism by seed; each (arm, fold, seed) is a group of its own, so a
grid of fits spreads over the cluster. A group's rows must fit one task; the fits are of bounded evaluation tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import rng, text, vector
from rankloom.functions.text import RESIDUES
from rankloom.sources.tables import checkpointed


def pwm(train: DataFrame, group: str, seq: str, label: str, length: int = 9, alphabet: str = RESIDUES) -> DataFrame:
    """(group, pos, residue, log_odds): log ratio of smoothed residue frequencies in positives and negatives, full grid."""
    spark, k = train.sparkSession, len(alphabet)
    letters = train.select(group, F.col(label).cast("int").alias("y"), F.posexplode(F.split(seq, "")).alias("pos", "residue"))
    counts = letters.groupBy(group, "pos", "residue").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    totals = train.groupBy(group).agg(F.sum(F.col(label).cast("int")).cast("double").alias("np"), F.sum(1 - F.col(label).cast("int")).cast("double").alias("nn"))
    grid = spark.range(length).select(F.col("id").cast("int").alias("pos"), F.explode(F.array(*map(F.lit, alphabet))).alias("residue"))
    full = totals.join(F.broadcast(grid)).join(counts, [group, "pos", "residue"], "left").fillna(0, ["p", "n"])
    odds = F.log(((F.col("p") + F.lit(1.0)) / (F.col("np") + F.lit(float(k)))) / ((F.col("n") + F.lit(1.0)) / (F.col("nn") + F.lit(float(k)))))
    return full.select(group, "pos", "residue", odds.alias("log_odds"))


def pwm_score(test: DataFrame, matrix: DataFrame, group: str, seq: str, row_id: str, source: str | None = None) -> DataFrame:
    """(row_id, score): sum of log odds over the positions; `source` names a column that holds another group's matrix to use."""
    from rankloom.operators.checks import require_none

    key = source or group
    require_none(test.select(F.col(key).alias(group)).distinct().join(matrix, group, "left_anti"), f"no weight matrix for {group}")
    letters = test.select(row_id, F.col(key).alias(group), F.posexplode(F.split(seq, "")).alias("pos", "residue"))
    return letters.join(matrix, [group, "pos", "residue"]).groupBy(row_id).agg(F.sum("log_odds").alias("score"))


def nearest_matrix_transfer(train: DataFrame, test: DataFrame, codes: DataFrame, group: str, seq: str, label: str, row_id: str, length: int, alphabet: str) -> DataFrame:
    """(row_id, group, source, score) of every test row by the weight matrix of another group: of those with both classes in
    training, the one whose code is nearest by Hamming distance, then by name. codes: (group, code)."""
    from rankloom.operators import retrieval
    from rankloom.operators.checks import require_none

    y = F.col(label).cast("int")
    both = train.groupBy(group).agg(F.min(y).alias("lo"), F.max(y).alias("hi")).filter("lo = 0 and hi = 1").select(group)
    sources = retrieval.bounded(codes.join(both, group, "left_semi").select(F.col(group).alias("source"), F.col("code").alias("_s")))
    pairs = codes.select(group, F.col("code").alias("_t")).join(F.broadcast(sources)).filter(F.col(group) != F.col("source"))
    nearest = pairs.groupBy(group).agg(F.min(F.struct(text.hamming(F.col("_t"), F.col("_s")).alias("d"), "source")).alias("b")).select(group, "b.source")
    require_none(test.select(group).distinct().join(nearest, group, "left_anti"), "groups without a source")
    keyed = test.join(nearest, group)
    scored = pwm_score(keyed, pwm(train.join(both, group, "left_semi"), group, seq, label, length, alphabet), group, seq, row_id, "source")
    return keyed.select(row_id, group, "source").join(scored, row_id)


def _scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation, 1 where that is 0."""
    s = x.std(0)
    return x.mean(0), np.where(s == 0, 1.0, s)


def logistic_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 1000) -> Callable[[np.ndarray], np.ndarray]:
    """Standardised inputs, L2 on the weights (sum of losses times c), free intercept; returns the probability of class 1."""
    m, s = _scale(x)
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    ridge = np.r_[np.full(x.shape[1], 1.0 / c), 0.0]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (ridge * w * w).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-10), grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now * (1 + 1e-12) + 1e-12 and size > 1e-8:  # rounding is no rise
            size /= 2
        w = w - size * step
        if np.abs(grad).max() < 1e-9 * max(1.0, len(x) / 1e4) or size <= 1e-8:
            break
    return lambda t: 1 / (1 + np.exp(-np.clip(np.column_stack([(t - m) / s, np.ones(len(t))]) @ w, -35, 35)))


def svc_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True, rounds: int = 200) -> Callable[[np.ndarray], np.ndarray]:
    """Linear classifier with squared hinge loss, the bias penalised like a weight; returns the decision value."""
    m, s = _scale(x)
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    t = 2.0 * y - 1
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) * c if balanced else np.full(len(y), c)
    w = np.zeros(z.shape[1])
    value = lambda w: 0.5 * w @ w + (weight * np.maximum(1 - t * (z @ w), 0) ** 2).sum()
    for _ in range(rounds):
        gap = 1 - t * (z @ w)
        own = gap > 0
        grad = w - 2 * z[own].T @ (weight[own] * t[own] * gap[own])
        if np.abs(grad).max() < 1e-8:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * (z[own] * weight[own, None]).T @ z[own], grad)
        size, now = 1.0, value(w)
        while value(w - size * step) > now and size > 1e-8:
            size /= 2
        w = w - size * step
    return lambda q: np.column_stack([(q - m) / s, np.ones(len(q))]) @ w


AT_ONCE = 1 << 11  # rows made dense at once


class Features:
    """Rows of values, or with a width rows of indices, each a row of 0 with 1 at them; only the rows asked for are made dense."""

    def __init__(self, rows: np.ndarray, width: int | None = None):
        self.rows, self.width = rows, width

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, pick: np.ndarray | slice = slice(None)) -> np.ndarray:
        own = self.rows[pick]
        if self.width is None:
            return own.astype(float)
        out = np.zeros((len(own), self.width))
        out[np.arange(len(own))[:, None], own] = 1.0
        return out

    @functools.cached_property
    def counts(self) -> np.ndarray:
        """Rows with a 1, by column; an index that a row has twice counts once."""
        total = np.zeros(self.width, np.int64)
        for a in range(0, len(self), AT_ONCE):
            own = np.sort(self.rows[a : a + AT_ONCE], axis=1)
            new = np.ones(own.shape, bool)
            new[:, 1:] = own[:, 1:] != own[:, :-1]
            total += np.bincount(own[new], minlength=self.width)
        return total

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """As _scale() of all rows."""
        if self.width is None:
            return _scale(self.rows)
        m = self.counts / len(self)
        s = np.sqrt(m * (1 - m) ** 2 + (1 - m) * m**2)
        return m, np.where(s == 0, 1.0, s)

    def varying(self, mean: np.ndarray) -> np.ndarray:
        """The columns in which some row of indices differs from the mean; of rows of values all."""
        if self.width is None:
            return np.arange(len(mean))
        return np.flatnonzero(~(((self.counts == 0) & (mean == 0)) | ((self.counts == len(self)) & (mean == 1))))


class Scaled:
    """Some columns of Features, standardised, and a last one of 1; a row of indices holds the places of its ones among those columns only."""

    def __init__(self, x: Features, mean: np.ndarray, scale: np.ndarray, columns: np.ndarray):
        self.width, self.rows = len(columns), x.rows
        self.mean, self.scale, self.indexed = mean[columns], scale[columns], x.width is not None
        if self.indexed:
            at = np.full(x.width, self.width, np.int16 if self.width < 1 << 15 else np.int32)  # the rest goes to the last column
            at[columns] = np.arange(self.width)
            places = [p for p in (at[c] for c in x.rows.T) if (p < self.width).any()]
            self.rows = np.column_stack(places) if places else np.zeros((len(x), 0), at.dtype)
            self.low, self.high = (np.r_[(v - self.mean) / self.scale, 1.0] for v in (0.0, 1.0))

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, pick: np.ndarray | slice) -> np.ndarray:
        own = self.rows[pick]
        if not self.indexed:
            return np.column_stack([(own.astype(float) - self.mean) / self.scale, np.ones(len(own))])
        out = np.empty((len(own), self.width + 1))
        out[:] = self.low
        out.ravel()[own + np.arange(0, out.size, self.width + 1)[:, None]] = self.high[own]
        return out


def _features(x: np.ndarray | Features) -> Features:
    return x if isinstance(x, Features) else Features(x)


def mlp_fit(x: np.ndarray | Features, y: np.ndarray, vx: np.ndarray | Features, vy: np.ndarray, hidden: int, seed: int, output: str = "sigmoid_mse", rate: float = 1e-3, decay: float = 0.0, dropout: float = 0.0, batch: int = 128, epochs: int = 200, patience: int = 20) -> Callable[[np.ndarray], np.ndarray]:
    """One ReLU layer by Adam with early stopping on the validation loss, best weights restored.

    output: `sigmoid_mse` fits values in [0, 1] by squared error; `logit_bce` fits classes and returns logits. decay is
    decoupled from the gradient. The scaler sees the fitted rows only. A one-hot column that is constant in them is 0 in every
    batch, so without decay its weights never move: it takes no part in the steps, and in scores where it differs only.
    """
    gen = np.random.default_rng(seed)
    x, vx = _features(x), _features(vx)
    m, s = x.scale()
    bound = lambda n, k: gen.uniform(-1, 1, (n, k)) / np.sqrt(n)
    first, *rest = bound(len(m), hidden), bound(1, hidden)[0] / np.sqrt(len(m)), bound(hidden, 1)[:, 0], np.zeros(1)
    moving = np.arange(len(m)) if decay else x.varying(m)
    rows = Scaled(x, m, s, moving)

    def views(flat: np.ndarray) -> list[np.ndarray]:
        """Weights of the hidden layer, its bias in the last row, those of the output and its bias."""
        return [flat[: -hidden - 1].reshape(-1, hidden), flat[-hidden - 1 : -1], flat[-1:]]

    flat = np.concatenate([first[moving].ravel(), *rest])
    mean, square, slope, spare = (np.zeros_like(flat) for _ in range(4))
    w, g, count = views(flat), views(slope), 0

    def scorer(q: Features) -> Callable[[], np.ndarray]:
        columns = np.union1d(moving, q.varying(m)) if q.width else moving
        own = Scaled(q, m, s, columns)

        def forward() -> np.ndarray:
            first[moving] = w[0][:-1]
            top, out = np.vstack([first[columns], w[0][-1]]), np.empty(len(own))
            for a in range(0, len(own), AT_ONCE):
                h = own.dense(slice(a, a + AT_ONCE)) @ top
                out[a : a + AT_ONCE] = np.maximum(h, 0, out=h) @ w[1] + w[2][0]
            return out

        return forward

    check = scorer(vx)

    def loss() -> float:
        z = check()
        return float(np.mean((1 / (1 + np.exp(-z)) - vy) ** 2) if output == "sigmoid_mse" else np.mean(np.logaddexp(0, z) - vy * z))

    best, kept, waited = np.inf, flat.copy(), 0
    block = max(AT_ONCE // 2 // batch, 1) * batch
    for _ in range(epochs):
        order = gen.permutation(len(x))
        for a in range(0, len(x), batch):
            if a % block == 0:
                many, truth = rows.dense(order[a : a + block]), y[order[a : a + block]]
            q, t = many[a % block : a % block + batch], truth[a % block : a % block + batch]
            h = q @ w[0]
            live = (h > 0).astype(float)
            if dropout:
                live *= (gen.random(h.shape) >= dropout) / (1 - dropout)
            h *= live
            z = h @ w[1] + w[2][0]
            p = 1 / (1 + np.exp(-np.minimum(np.maximum(z, -35), 35)))
            dz = (2 * (p - t) * p * (1 - p) if output == "sigmoid_mse" else p - t) / len(q)
            np.dot(dz, h, out=g[1])
            g[2][0] = dz.sum()
            live *= dz[:, None]
            np.dot(q.T, live, out=g[0])
            g[0][:] *= w[1]
            count += 1
            # Adam on all weights at once, in place
            mean *= 0.9
            mean += np.multiply(slope, 0.1, out=spare)
            square *= 0.999
            np.multiply(slope, 0.001, out=spare)
            square += np.multiply(spare, slope, out=spare)
            np.sqrt(square, out=spare)
            spare *= 1 / np.sqrt(1 - 0.999**count)
            spare += 1e-8
            np.divide(mean, spare, out=spare)
            spare *= rate / (1 - 0.9**count)
            if decay:
                flat *= 1 - rate * decay
            flat -= spare
        now = loss()
        if now < best - 1e-12:
            best, waited = now, 0
            kept[:] = flat
        else:
            waited += 1
            if waited >= patience:
                break
    flat[:] = kept
    return lambda q: (lambda z: 1 / (1 + np.exp(-z)) if output == "sigmoid_mse" else z)(scorer(_features(q))())


def _dense(column: pd.Series, width: int | None) -> np.ndarray:
    """Feature rows of a column of lists; with a width, rows of indices become rows of 0 and 1."""
    if not len(column):
        return np.zeros((0, width or 1))
    return Features(np.stack(column.tolist()), width).dense()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    own = column.combine_chunks()
    if own.null_count:
        raise ValueError("rows without features")
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def _fit_one(table: pa.Table, features: str, label: str, row_id: str, side: str, default: float, model: str, width: int | None = None, threshold: float = 0.5, **settings) -> tuple[pa.Array, np.ndarray]:
    """(row ids, scores) of the test rows of one fit. Of a row numbers are held only, and it is made dense in a batch at a time."""
    order = np.argsort(table.column(row_id).to_numpy(), kind="stable")
    sides = table.column(side).combine_chunks().dictionary_encode()
    names, code = sides.dictionary.to_pylist(), sides.indices.to_numpy(zero_copy_only=False)[order]
    part = {n: order[np.isin(code, [i for i, x in enumerate(names) if x in v])] for n, v in {"fit": ["train", "fit"], "val": ["validation"], "test": ["test"]}.items()}
    value = table.column(label).to_numpy().astype(float)
    y = value[part["fit"]]
    score = np.full(len(part["test"]), default)
    if len(part["test"]) and len(np.unique(y > threshold)) == 2:
        rows = _matrix(table.column(features))
        x, t = Features(rows[part["fit"]], width), Features(rows[part["test"]], width)
        if model == "mlp":
            v = part["val"] if len(part["val"]) else part["fit"]
            f = mlp_fit(x, y, Features(rows[v], width), value[v], **settings)
            score = f(t)
        else:
            score = {"logistic": logistic_fit, "svc": svc_fit}[model](x.dense(), y, **settings)(t.dense())
    return table.column(row_id).combine_chunks().take(pa.array(part["test"])), score


def fit_and_score(rows: DataFrame, group: list[str], features: str, label: str, row_id: str, side: str = "side", model: str = "logistic", default: float = 0.0, **settings) -> DataFrame:
    """(group, row_id, score): in each group, fit on side `train` or `fit` (and `validation`) and score side `test`.

    A group that can't be fitted (one class) keeps the default score.
    """
    return fit_grid(rows, [{"model": model, **settings}], group, features, label, row_id, side, default).drop("setting")


def fit_grid(rows: DataFrame, settings: list[dict], group: list[str], features: str, label: str, row_id: str, side: str = "side", default: float = 0.0) -> DataFrame:
    """(group, setting, row_id, score): every setting fitted in every group, all fits as groups of one stage.

    A setting names its model and the arguments of its fit; `width` makes features rows of indices that are set to 1, so that
    wide one-hot rows travel and are held as a few numbers. Rows travel once for each setting; a group's rows must fit one task.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i,) for i in range(len(settings))], "setting int")
    own = rows.select(*group, row_id, features, F.col(label).cast("double").alias(label), side)
    grid = own.join(F.broadcast(listed))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, score = _fit_one(table, features, label, row_id, side, default, **settings[key[-1].as_py()])
        keys = [pa.array([k.as_py()] * len(score), table.schema.field(c).type) for c, k in zip([*group, "setting"], key, strict=True)]
        return pa.Table.from_arrays([*keys, ids, pa.array(score, pa.float64())], [*group, "setting", row_id, "score"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + f", setting int, `{row_id}` {kinds[row_id]}, score double"
    return grid.groupBy(*group, "setting").applyInArrow(run, schema)


WIDTHS, SEEDS = (55, 66), (0, 1, 2, 3, 4)


def networks(hidden: list[int] | tuple[int, ...] = WIDTHS, seeds: list[int] | tuple[int, ...] = SEEDS, **settings) -> list[dict]:
    """The settings of an ensemble: a network of every width and seed."""
    return [{"model": "mlp", "hidden": h, "seed": s, **settings} for h in hidden for s in seeds]


def ensemble(rows: DataFrame, features: str, label: str, row_id: str, partition: str, hidden: list[int] | tuple[int, ...] = WIDTHS, seeds: list[int] | tuple[int, ...] = SEEDS, side: str = "side", **settings) -> DataFrame:
    """(partition, row_id, score): mean over networks of every width and seed, each fitted in a task of its own."""
    return fit_grid(rows, networks(hidden, seeds, **settings), [partition], features, label, row_id, side).groupBy(partition, row_id).agg(F.avg("score").alias("score"))


AT_A_TIME = 256  # rows of a packed block


def packed(rows: DataFrame, keys: list[str], features: str, label: str, row_id: str, kind: str) -> DataFrame:
    """(keys, _ids, _v, _x): blocks of rows of the same keys, with the indices of all their rows as one value of numpy's `kind`."""
    own = rows.select(*keys, row_id, F.col(label).cast("double").alias("_v"), features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                c = b.column(k).dictionary_encode("encode")
                code = np.unique(code * (len(c.dictionary) + 1) + c.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                for at in (part[a : a + AT_A_TIME] for a in range(0, len(part), AT_A_TIME)):
                    take = b.take(pa.array(at))
                    x = np.ascontiguousarray(_matrix(pa.chunked_array([take.column(features)])), kind)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), take.column(c)) for c in (row_id, "_v")]
                    yield pa.RecordBatch.from_arrays([*(take.column(k).slice(0, 1) for k in keys), *lists, pa.array([x.tobytes()], pa.binary())], [*keys, "_ids", "_v", "_x"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", _ids array<{kinds[row_id]}>, _v array<double>, _x binary")


def arm_ensembles(rows: DataFrame, arm: str, partition: str, features: str, label: str, row_id: str, widths: dict[str, int], hidden: list[int] | tuple[int, ...] = WIDTHS, seeds: list[int] | tuple[int, ...] = SEEDS, side: str = "side", **settings) -> DataFrame:
    """(partition, row_id, arm, score) of one ensemble an arm; rows are by arm, with features as indices below the arm's width.

    Rows are written once, in blocks; blocks and not rows travel to the fits, and the fits are dealt to more partitions than
    there are fits, so that few share one.
    """
    every = [{"arm": a, "width": w, **s} for a, w in widths.items() for s in networks(hidden, seeds, **settings)]
    kind = "int16" if max(widths.values()) < 1 << 15 else "int32"
    blocks = checkpointed(packed(rows, [arm, partition, side], features, label, row_id, kind))
    listed = rows.sparkSession.createDataFrame([(i, s["arm"]) for i, s in enumerate(every)], f"setting int, `{arm}` string")
    options = [{k: v for k, v in s.items() if k != "arm"} for s in every]
    fits = blocks.select(arm, partition).distinct().join(F.broadcast(listed), arm).count()
    grid = blocks.join(F.broadcast(listed), arm).repartition(max(1, min(4 * fits, 1 << 13)), arm, partition, "setting")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = {c: table.column(c).combine_chunks() for c in ("_ids", "_v", side)}
        names = lists[side].dictionary_encode()
        sides = pa.DictionaryArray.from_arrays(np.repeat(names.indices.to_numpy(), lists["_ids"].value_lengths().to_numpy()), names.dictionary)
        ids, x = lists["_ids"].flatten(), np.frombuffer(b"".join(table.column("_x").to_pylist()), kind)
        x = pa.FixedSizeListArray.from_arrays(pa.array(x), len(x) // len(ids))
        own = pa.table([ids, x, lists["_v"].flatten(), sides], [row_id, features, label, side])
        ids, score = _fit_one(own, features, label, row_id, side, 0.0, **options[key[-1].as_py()])
        keys = [pa.array([k.as_py()] * len(score), table.schema.field(c).type) for c, k in zip([arm, partition], key, strict=False)]
        return pa.Table.from_arrays([*keys, ids, pa.array(score, pa.float64())], [arm, partition, row_id, "score"])

    kinds = dict(rows.dtypes)
    found = grid.groupBy(arm, partition, "setting").applyInArrow(run, f"`{arm}` {kinds[arm]}, `{partition}` {kinds[partition]}, `{row_id}` {kinds[row_id]}, score double")
    return found.groupBy(partition, row_id, arm).agg(F.avg("score").alias("score"))


def hot(seq: str, length: int, alphabet: str, start: int = 0) -> Column:
    """Index of each of the first `length` letters in a one-hot row that begins at `start`; letters unknown to it count as the first."""
    place = F.expr(f"transform(sequence(1, {length}), i -> greatest(instr('{alphabet}', substring(`{seq}`, i, 1)), 1) - 1 + (i - 1) * {len(alphabet)} + {start})")
    return place.cast("array<int>")


def layer_sweep(rows: DataFrame, model: str, layer: str, group: str, features: str, label: str, row_id: str, side: str = "side", c: float = 1.0) -> DataFrame:
    """(model, layer, n_scored, macro_auroc, chosen): a logistic fit of every model and layer, and each model's best layer on the rows of side `test`."""
    from rankloom.operators import metrics

    scored = fit_and_score(rows, [model, layer], features, label, row_id, side, "logistic", c=c)
    joined = scored.join(rows.filter(F.col(side) == "test").select(model, layer, row_id, group, label), [model, layer, row_id])
    by = metrics.macro(metrics.group_metrics(joined, [model, layer, group], label, "score"), group, "auroc", [model, layer]).drop("skipped")
    best = best_setting(by.filter("macro_auroc is not null"), model, layer, "macro_auroc").select(model, F.col(layer).alias("_best"))
    return by.join(best, model, "left").select(model, layer, "n_scored", "macro_auroc", F.coalesce(F.col(layer) == F.col("_best"), F.lit(False)).alias("chosen"))


def info_nce(batch: DataFrame, batch_id: str, row_id: str, label: str, vec: str, temperature: float = 0.1, exclude_self: bool = True) -> DataFrame:
    """(batch, loss): supervised contrastive loss; every other row of the label is a positive, anchors without one drop out."""
    a = batch.select(batch_id, F.col(row_id).alias("i"), F.col(label).alias("li"), F.col(vec).alias("vi"))
    b = batch.select(batch_id, F.col(row_id).alias("j"), F.col(label).alias("lj"), F.col(vec).alias("vj"))
    pairs = a.join(b, batch_id).withColumn("s", vector.cosine("vi", "vj") / temperature)
    pairs = pairs.filter("i <> j") if exclude_self else pairs
    w = Window.partitionBy(batch_id, "i")
    anchors = pairs.withColumn("_top", F.max("s").over(w)).withColumn("_den", F.log(F.sum(F.exp(F.col("s") - F.col("_top"))).over(w)) + F.col("_top"))
    per = anchors.filter((F.col("li") == F.col("lj")) & (F.col("i") != F.col("j"))).groupBy(batch_id, "i").agg((-F.avg(F.col("s") - F.col("_den"))).alias("l"))
    return per.groupBy(batch_id).agg(F.avg("l").alias("loss"))


def hashed_embedding(df: DataFrame, seq: str, width: int = 32, k: int = 3, out: str = "vec") -> DataFrame:
    """Distinct sequences with a deterministic k-mer hash embedding: a stand-in where no network weights are at hand."""
    d = df.select(seq).distinct()
    kmers = F.expr(f"transform(sequence(1, greatest(length(`{seq}`) - {k - 1}, 1)), i -> substring(`{seq}`, i, {k}))")
    slots = F.transform("_k", lambda x: F.pmod(F.xxhash64(x), F.lit(width)))
    counts = F.array(*((F.size("_s") - F.size(F.array_remove("_s", F.lit(j).cast("long")))).cast("double") for j in range(width)))
    d = d.withColumn("_k", kmers).withColumn("_s", slots).withColumn("_n", counts).withColumn("_l", vector.norm("_n"))
    unit = F.transform("_n", lambda x: F.when(F.col("_l") == 0, F.lit(float("nan"))).otherwise(x / F.col("_l")))  # normalise() with the norm taken once
    return d.withColumn(out, unit).drop("_k", "_s", "_n", "_l")


def residue_embedding(df: DataFrame, seq: str, table: dict[str, list[float]], out: str = "residues") -> DataFrame:
    """Distinct sequences with one vector a residue from a given table."""
    m = F.create_map(*(x for r, v in table.items() for x in (F.lit(r), F.array(*(F.lit(float(z)) for z in v)))))
    return df.select(seq).distinct().withColumn(out, F.transform(F.split(seq, ""), lambda r: F.element_at(m, r)))


def two_tower_fit(p: np.ndarray, t: np.ndarray, y: np.ndarray, width: int = 16, seed: int = 0, rate: float = 0.05, epochs: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Two linear projections whose inner product predicts the label, by full-batch gradient steps on the logistic loss."""
    gen = np.random.default_rng(seed)
    a, b = gen.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], width)), gen.normal(0, 1 / np.sqrt(t.shape[1]), (t.shape[1], width))
    for _ in range(epochs):
        u, v = p @ a, t @ b
        d = (1 / (1 + np.exp(-np.clip((u * v).sum(1), -35, 35))) - y)[:, None] / len(y)
        a, b = a - rate * (p.T @ (d * v) * len(y) ** 0.5 + ridge * a), b - rate * (t.T @ (d * u) * len(y) ** 0.5 + ridge * b)
    return a, b


def attention_score(query: np.ndarray, keys: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Forward pass of one attention head: softmax over the real rows, then the weighted mean."""
    s = np.where(mask, keys @ query / np.sqrt(len(query)), -np.inf)
    w = np.exp(s - s.max())
    return (w / w.sum()) @ keys


def best_setting(grid: DataFrame, group: str, setting: str, value: str) -> DataFrame:
    """The setting of largest value of each group; of ties the smallest."""
    return grid.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("v"), setting)).alias("b")).select(group, f"b.{setting}", (-F.col("b.v")).alias(value))


def random_scores(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    return df.withColumn("score", rng.unit(seed, "random", F.col(row_id)))
