"""Bootstrap intervals for macro metrics: over groups in SQL, over rows or both through resampling.samples()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rng
from rankloom.operators import ordering, resampling, stats
from rankloom.sources.tables import checkpointed


def group_draws(groups: DataFrame, group: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, group, times): as many draws with replacement as there are groups, in every replicate."""
    from pyspark.sql import Window

    from rankloom.operators.retrieval import bounded

    g = bounded(groups.select(group).distinct()).withColumn("_pos", F.row_number().over(Window.orderBy(group)) - 1)
    n = g.count()
    slots = g.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    slots = slots.withColumn("_pos", rng.bounded_int(rng.unit(seed, "group", F.col("replicate"), F.col("slot")), n))
    return slots.join(F.broadcast(g), "_pos").groupBy("replicate", group).agg(F.count(F.lit(1)).alias("times"))


def macro_over_groups(by_group: DataFrame, group: str, metric: str, replicates: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, value): the macro metric of every group resample; all values of `by` share the draws."""
    ok = by_group.filter(F.col(metric).isNotNull())
    draws = group_draws(ok, group, replicates, seed)
    return ok.join(draws, group).groupBy(*(by or []), "replicate").agg((F.sum(F.col(metric) * F.col("times")) / F.sum("times")).alias("value"))


def paired_over_groups(by_group: DataFrame, group: str, arm: str, metric: str, first: str, second: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, value): macro difference first - second on the groups both arms can score, with shared draws."""
    wide = by_group.filter(F.col(metric).isNotNull()).groupBy(group).pivot(arm, [first, second]).agg(F.first(metric))
    common = wide.dropna().select(group, (F.col(f"`{first}`") - F.col(f"`{second}`")).alias("_d"))
    if common.isEmpty():
        raise ValueError("the two arms have no group in common that both can score")
    return macro_over_groups(common, group, "_d", replicates, seed)


PART, SLOTS, TOGETHER = 1 << 16, 1 << 18, 32  # points of a part, slots drawn at once, replicates that go to one task


def correlation_over_points(points: DataFrame, row_id: str, x: str, y: list[str] | str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, r...): Pearson r of x with each y under resampled points; undefined replicates are null.

    Points are numbered in order of row_id and packed in parts. Slots of a replicate are drawn SLOTS at a time, and what falls
    into a part travels there as packed positions, to meet the points; six sums a y leave each meeting. So no pair of
    replicate and point is a row, and no task holds more than a part and the slots of one replicate.
    """
    ys = [y] if isinstance(y, str) else y
    values = [f"v{i}" for i in range(len(ys) + 1)]
    own = points.select(F.col(row_id).alias("id"), *(F.col(c).cast("double").alias(v) for c, v in zip([x, *ys], values, strict=True)))
    centre = own.agg(*(F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias(v) for v in values)).first()  # keeps the sums small
    numbered = checkpointed(ordering.numbered(own.select("id", *((F.col(v) - centre[v]).alias(v) for v in values)), "id"))
    count = numbered.count()
    spark = points.sparkSession
    rows = F.array_sort(F.collect_list(F.struct("pos", *values))).alias("rows")
    packed = numbered.groupBy(F.floor(F.col("pos") / PART).cast("int").alias("part")).agg(rows)
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // TOGETHER))).alias("chunk")
    held = packed.select("part", chunks, F.lit(-1).cast("long").alias("r"), "rows", F.lit(None).cast("binary").alias("drawn"))
    blocks = max(1, -(-count // SLOTS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                r, block = divmod(number, blocks)
                at = np.sort(rng.slots(seed, r, count, block * SLOTS, min(count, (block + 1) * SLOTS)))
                parts, first = np.unique(at // PART, return_index=True)
                own = [x.astype("<u2").tobytes() for x in np.split(at % PART, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), r), pa.int64()), pa.array(own, pa.binary())], ["part", "r", "drawn"])

    asked = spark.range(0, replicates * blocks, 1, max(1, min(replicates * blocks, 4 * spark.sparkContext.defaultParallelism)))
    sent = asked.mapInArrow(draw, "part int, r long, drawn binary").select("part", F.floor(F.col("r") / TOGETHER).cast("int").alias("chunk"), "r", F.lit(None).cast(dict(packed.dtypes)["rows"]).alias("rows"), "drawn")
    sizes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(sent).repartition(sizes, "part", "chunk").sortWithinPartitions("part", "chunk", "r")
    names = ["replicate", "i", "n", "x", "y", "xx", "yy", "xy", "xl", "xh", "yl", "yh"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: list[np.ndarray] = []
        for batch in batches:
            found = []
            for k, r in enumerate(batch.column("r").to_pylist()):
                if r < 0:
                    v = [batch.column("rows")[k].values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in values]
                    continue
                t = np.bincount(np.frombuffer(batch.column("drawn")[k].as_py(), "<u2"), minlength=len(v[0]))
                for i, w in enumerate(v[1:]):
                    some = (t > 0) & ~np.isnan(v[0]) & ~np.isnan(w)
                    a, b, n = v[0][some], w[some], t[some]
                    ends = (a.min(), a.max(), b.min(), b.max()) if len(a) else (None,) * 4
                    found.append((r, i, int(n.sum()), *(float(n @ c) for c in (a, b, a * a, b * b, a * b)), *ends))
            if found:
                kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 9]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    sums = dealt.mapInArrow(meet, "replicate long, i int, n long, " + ", ".join(f"{c} double" for c in names[3:]))
    ends = [f(c).alias(c) for f, c in ((F.min, "xl"), (F.max, "xh"), (F.min, "yl"), (F.max, "yh"))]
    total = sums.groupBy("replicate", "i").agg(*(F.sum(c).alias(c) for c in names[2:8]), *ends)
    r = F.expr("case when n >= 2 and xl < xh and yl < yh then (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) end")
    wide = total.withColumn("r", r).groupBy("replicate").pivot("i", list(range(len(ys)))).agg(F.first("r"))
    return wide.select("replicate", *(F.col(f"`{i}`").alias(f"r_{c}") for i, c in enumerate(ys)))


def block_metrics(p: np.ndarray, n: np.ndarray, fpr: float = 0.1) -> tuple[float, float, float]:
    """(auroc, ap, auc01) of positives and negatives by block of falling score; NaN for one class."""
    pos, neg = p.sum(), n.sum()
    if pos <= 0 or neg <= 0:
        return (np.nan,) * 3
    tp, fp = np.cumsum(p), np.cumsum(n)
    t1, f1 = tp / pos, fp / neg
    t0, f0 = t1 - p / pos, f1 - n / neg
    area = (f1 - f0) * (t0 + t1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(f1 <= fpr, area, np.where(f0 < fpr, (fpr - f0) * (2 * t0 + (t1 - t0) * (fpr - f0) / (f1 - f0)) / 2, 0.0))
        ap = np.where(tp + fp > 0, p / pos * tp / (tp + fp), 0.0).sum()
    low = fpr * fpr / 2
    return float(area.sum()), float(ap), float(0.5 * (1 + (part.sum() - low) / (fpr - low)))


def replicates(rows: DataFrame, group: str, label: str, arms: list[str], row_id: str, n: int, mode: str = "both", metric: str = "auc01", seed: int = 0, masks: dict[str, str] | None = None, own_rows: bool = False) -> DataFrame:
    """(replicate, one column an arm): the macro metric under resampled rows, groups or both.

    All arms share the drawn groups and rows; `masks` names a boolean column by arm, so an arm can be a regime that keeps
    only some of the rows; own_rows lets arms with different rows draw from their own (see resampling).
    """
    drawn = resampling.macro_samples(resampling.samples(rows, group, label, arms, row_id, n, mode, seed, masks, own_rows=own_rows), arms)
    whole = rows.sparkSession.range(n).select(F.col("id").alias("replicate"))
    wide = drawn.groupBy("replicate").pivot("arm", arms).agg(F.first(metric))
    return whole.join(wide, "replicate", "left").select("replicate", *(F.col(f"`{a}`") for a in arms))


def attenuation(samples: DataFrame, baseline: str, regimes: list[str]) -> DataFrame:
    """(replicate, regime, absolute, proportional): loss against the baseline, and its share of the baseline's gain over 0.5."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), F.col(f"`{r}`").alias("v")) for r in regimes)))
    long = samples.select("replicate", F.col(f"`{baseline}`").alias("_b"), each.alias("r")).select("replicate", "_b", "r.*")
    lost = F.col("_b") - F.col("v")
    return long.select("replicate", "regime", lost.alias("absolute"), F.when(F.col("_b") != 0.5, lost / (F.col("_b") - 0.5)).alias("proportional"))


def matched_subsets(rows: DataFrame, wanted: DataFrame, group: str, label: str, score: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """(replicate, group, auc01): metric of subsets with given positive and negative counts (columns n_pos, n_neg), drawn without replacement."""

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id, kind="stable")
        y, s = pdf[label].to_numpy(float), pdf[score].to_numpy(float)
        block = np.unique(-s, return_inverse=True)[1]
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        a, b = int(pdf["n_pos"].iloc[0]), int(pdf["n_neg"].iloc[0])
        if a > len(pos) or b > len(neg):
            raise ValueError(f"group {key[0]} has {len(pos)} positives and {len(neg)} negatives, fewer than asked for")
        gen = np.random.default_rng([seed, *str(key[0]).encode()])
        out = []
        for k in range(n):
            w = np.zeros(len(y))
            w[gen.choice(pos, a, replace=False)] = 1
            w[gen.choice(neg, b, replace=False)] = 1
            out.append((k, key[0], block_metrics(np.bincount(block, w * y), np.bincount(block, w * (1 - y)))[2]))
        return pd.DataFrame(out, columns=["replicate", group, "auc01"])

    kind = dict(rows.dtypes)[group]
    joined = rows.select(group, label, score, row_id).join(F.broadcast(wanted.select(group, "n_pos", "n_neg")), group)
    return joined.groupBy(group).applyInPandas(draw, f"replicate long, `{group}` {kind}, auc01 double")
