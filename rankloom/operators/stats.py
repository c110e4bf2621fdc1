"""Correlation, slopes, within-group normalisation and decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, group: str, value: str, out: str = "z") -> DataFrame:
    """Less the group mean, over the sample deviation; 0 where that is 0 or undefined."""
    m = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return df.join(m, group).withColumn(out, z).drop("_m", "_s")


def rank_normalise(df: DataFrame, group: str, value: str, out: str = "rank_norm") -> DataFrame:
    """Average rank over group size. Ranks are taken over distinct values."""
    blocks = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(group)
    upto = F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = blocks.withColumn(out, (upto - (F.col("_k") - 1) / 2) / F.sum("_k").over(w)).drop("_k")
    return df.join(ranks, [group, value])


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, r); r is null for fewer than two points or where one side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull()).withColumns({"_x": a, "_y": b})
    grouped = both.groupBy(*by) if by else both.groupBy()
    ok = (F.count(F.lit(1)) >= 2) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("_x", "_y")).alias("r"))


def weighted_pearson(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """(mean_x, mean_y, r) under weights."""
    w_, x_, y_ = (F.col(c).cast("double") for c in (w, x, y))
    means = df.agg((F.sum(w_ * x_) / F.sum(w_)).alias("mean_x"), (F.sum(w_ * y_) / F.sum(w_)).alias("mean_y"))
    dx, dy = x_ - F.col("mean_x"), y_ - F.col("mean_y")
    return df.join(F.broadcast(means)).groupBy("mean_x", "mean_y").agg((F.sum(w_ * dx * dy) / F.sqrt(F.sum(w_ * dx * dx) * F.sum(w_ * dy * dy))).alias("r"))


def leave_one_out_pearson(df: DataFrame, row_id: str, x: str, y: str) -> DataFrame:
    """(row_id, r): correlation without that row, from centred sums."""
    means = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = df.join(F.broadcast(means)).select(row_id, (F.col(x) - F.col("_mx")).alias("x"), (F.col(y) - F.col("_my")).alias("y"))
    sums = c.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    d = c.join(F.broadcast(sums)).selectExpr(f"`{row_id}`", "n - 1 as m", "sx - x as sx", "sy - y as sy", "sxx - x * x as sxx", "syy - y * y as syy", "sxy - x * y as sxy")
    cov, vx, vy = "sxy - sx * sy / m", "sxx - sx * sx / m", "syy - sy * sy / m"
    return d.select(row_id, F.expr(f"case when m >= 2 and {vx} > 0 and {vy} > 0 then ({cov}) / sqrt(({vx}) * ({vy})) end").alias("r"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, stderr, low, high, r2): least squares with a 1.96 standard error interval; r2 is 0 for constant y.

    Fewer than three points or a constant x raise.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.select(a.alias("x"), b.alias("y")).agg(
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"),
    )
    wrong = F.raise_error(F.lit("a slope needs three points and two values of x")).cast("double")
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    out = out.withColumn("stderr", F.when((F.col("n") < 3) | (F.col("_sxx") <= 0), wrong).otherwise(F.sqrt(residual / (F.col("n") - 2) / F.col("_sxx"))))
    r2 = F.when(F.col("_syy") == 0, 0.0).otherwise(1 - residual / F.col("_syy"))
    return out.select("n", "slope", "intercept", "stderr", (F.col("slope") - 1.96 * F.col("stderr")).alias("low"), (F.col("slope") + 1.96 * F.col("stderr")).alias("high"), r2.alias("r2"))


def slope_rule(low: Column, high: Column, reference: Column) -> Column:
    """`novelty_effect` for a flat slope above the reference, `intrinsic_difficulty` if the interval holds it, else `mixed`."""
    flat = (low <= 0) & (high >= 0)
    return F.when(flat & (reference < low), "novelty_effect").when((reference >= low) & (reference <= high), "intrinsic_difficulty").otherwise("mixed")


def predictive(low: Column) -> Column:
    return low > 0.5


def sufficient(low: Column, difference_high: Column, margin: float = 0.02) -> Column:
    """Predictive, and at most a margin behind."""
    return predictive(low) & (difference_high < margin)


def primary(low_a: Column, low_b: Column) -> Column:
    return (low_a > 0) & (low_b > 0)


def probe_verdict(by_probe: DataFrame, macro: str, most: float = 0.05) -> DataFrame:
    """(worst, passes): largest distance of a shortcut probe from chance."""
    worst = F.max(F.abs(F.col(macro) - 0.5))
    return by_probe.agg(worst.alias("worst"), (worst <= most).alias("passes"))


def seed_spread(runs: DataFrame, arm: str, seed: str, value: str) -> DataFrame:
    """(arm, mean, low, high, representative): the seed closest to the mean, the smallest of several."""
    m = runs.groupBy(arm).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return runs.join(m, arm).groupBy(arm, "mean", "low", "high").agg(F.min(F.struct(F.abs(F.col(value) - F.col("mean")).alias("d"), F.col(seed).alias("s"))).alias("_b")).select(arm, "mean", "low", "high", F.col("_b.s").alias("representative"))


def require_floor(by_arm: DataFrame, arm: str, value: str, floor: float = 0.6) -> None:
    from rankloom.operators.checks import require_none

    require_none(by_arm.filter(F.col(value) < floor).select(arm, value), f"arms under {floor}")


def require_drift(slope: float, reference: float, tolerance: float = 0.15) -> None:
    if abs(slope - reference) > tolerance:
        raise ValueError(f"slope {slope} is more than {tolerance} from {reference}")


def interval(samples: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """(by, low, high, n_replicates): exact percentiles of the finite samples, with linear interpolation."""
    tail = (1 - level) / 2
    ok = samples.filter(F.col(value).isNotNull() & ~F.isnan(value))
    grouped = ok.groupBy(*by) if by else ok.groupBy()
    return grouped.agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.count(F.lit(1)).alias("n_replicates"))


def two_sided_p(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, p): twice the smaller share of finite samples on one side of 0, zeros on both, at most 1; null without any."""
    ok = samples.withColumn("_v", F.when(~F.isnan(value), F.col(value)))  # in Spark NaN counts as larger than all
    grouped = ok.groupBy(*by) if by else ok.groupBy()
    n = F.count("_v")
    return grouped.agg(F.when(n > 0, F.least(F.lit(1.0), 2.0 * F.least(F.count_if(F.col("_v") <= 0), F.count_if(F.col("_v") >= 0)) / n)).alias("p"))


def correlation_block(df: DataFrame, row_id: str, x: str, y: str, support: str, least: int) -> DataFrame:
    """(n, r, low, high, n_supported, r_supported): r, its range when one point is left out, and r of points with enough support."""
    one = leave_one_out_pearson(df, row_id, x, y).agg(F.min("r").alias("low"), F.max("r").alias("high"))
    few = pearson(df.filter(F.col(support) >= least), x, y).select(F.col("n").alias("n_supported"), F.col("r").alias("r_supported"))
    return pearson(df, x, y).join(one).join(few)  # one row each


def correlation_difference(samples: DataFrame, first: str, second: str) -> DataFrame:
    """(low, high, n_replicates, p) of the paired difference of two resampled correlations; undefined replicates don't count."""
    d = samples.select((F.col(first) - F.col(second)).alias("d"))
    return interval(d, "d").join(two_sided_p(d, "d"))  # one row each
