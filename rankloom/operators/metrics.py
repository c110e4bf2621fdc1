"""Tie-exact ranking metrics by group, as window plans over tie blocks.

Rows of a group with one score meet in a partial aggregate first, so windows see distinct scores only. For a group with
very many distinct scores pass `cuts`: the group is split at that many quantiles, prefix sums are taken within each part
and the small table of part totals supplies the offset, so no task holds a whole group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FPR = 0.1


def _key(groups: list[str]) -> list[Column]:
    return [F.col(g) for g in groups]


def tie_blocks(df: DataFrame, groups: list[str], label: str, score: str, weight: str | None = None, cuts: int | None = None) -> DataFrame:
    """(groups, score, p, n, tp, fp, pos, neg): weights of positives and negatives by distinct score, with running sums."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    blocks = df.groupBy(*groups, F.col(score).cast("double").alias("s")).agg(F.sum(w * y).alias("p"), F.sum(w * (1 - y)).alias("n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    if cuts is None:
        order = whole.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        return blocks.withColumns({"tp": F.sum("p").over(order), "fp": F.sum("n").over(order), "pos": F.sum("p").over(whole), "neg": F.sum("n").over(whole)})
    at = [i / cuts for i in range(1, cuts)]
    marks = blocks.groupBy(*groups).agg(F.percentile_approx("s", at, 1000).alias("_cuts"))
    parted = (blocks.join(marks, groups) if groups else blocks.join(F.broadcast(marks))).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("s")))).drop("_cuts")
    totals = parted.groupBy(*groups, "_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = whole.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in ("_p", "_n")), F.sum("_p").over(whole).alias("pos"), F.sum("_n").over(whole).alias("neg"))
    inside = Window.partitionBy(*groups, "_part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    joined = parted.join(totals, [*groups, "_part"])
    return joined.withColumns({"tp": F.col("_p0") + F.sum("p").over(inside), "fp": F.col("_n0") + F.sum("n").over(inside)}).drop("_part", "_p0", "_n0")


def group_metrics(df: DataFrame, groups: list[str] | str, label: str, score: str, weight: str | None = None, fpr: float = FPR, cuts: int | None = None) -> DataFrame:
    """(groups, n_pos, n_neg, auroc, ap, auc01): ROC area, average precision and standardised partial area to `fpr`.

    A group of one class has null metrics; it is reported, never dropped.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    b = tie_blocks(df, groups, label, score, weight, cuts)
    ok = (F.col("pos") > 0) & (F.col("neg") > 0)
    pos, neg = (F.when(ok, F.col(c)) for c in ("pos", "neg"))
    b = b.withColumns({"f0": (F.col("fp") - F.col("n")) / neg, "f1": F.col("fp") / neg, "t0": (F.col("tp") - F.col("p")) / pos, "t1": F.col("tp") / pos})
    b = b.withColumn("ok", ok)
    area = f"(f1 - f0) * (t0 + t1) / 2e0"
    cut = f"({fpr}e0 - f0)"
    part = f"case when f1 <= {fpr}e0 then {area} when f0 < {fpr}e0 then {cut} * (t0 + (t0 + (t1 - t0) * {cut} / (f1 - f0))) / 2e0 else 0e0 end"
    out = b.groupBy(*groups).agg(
        F.max("pos").alias("n_pos"), F.max("neg").alias("n_neg"),
        F.expr(f"sum(case when ok then {area} end)").alias("auroc"),
        F.expr("sum(case when ok and tp + fp > 0 then p / pos * tp / (tp + fp) end)").alias("ap"),
        F.expr(f"sum(case when ok then {part} end)").alias("_pauc"),
    )
    low = fpr * fpr / 2
    return out.withColumn("auc01", 0.5 * (1 + (F.col("_pauc") - low) / (fpr - low))).drop("_pauc")


def pooled_metrics(df: DataFrame, label: str, score: str, weight: str | None = None, cuts: int | None = 64) -> DataFrame:
    """One row of metrics over all rows."""
    return group_metrics(df, [], label, score, weight, cuts=cuts)


def macro(by_group: DataFrame, group: str, metric: str = "auc01", within: list[str] | None = None) -> DataFrame:
    """Unweighted mean over groups with both classes, with the groups left out listed."""
    aggs = [F.avg(metric).alias(f"macro_{metric}"), F.count(metric).alias("n_scored"), F.sort_array(F.collect_list(F.when(F.col(metric).isNull(), F.col(group)))).alias("skipped")]
    return by_group.groupBy(*within).agg(*aggs) if within else by_group.agg(*aggs)


def strict_group_metrics(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """group_metrics() that raises for a group of one class."""
    from rankloom.operators.checks import require_none

    out = group_metrics(df, group, label, score)
    require_none(out.filter("auc01 is null").select(group), "groups with one class only")
    return out


def diagnostics(df: DataFrame, group: str, score: str) -> DataFrame:
    """n_rows, n_distinct finite scores, n_nonfinite, modal_fraction over all rows (1 if none is finite), n_constant_groups."""
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    marked = df.select(F.col(group).alias("g"), F.when(finite, s).alias("s"))
    counts = marked.groupBy("g", "s").agg(F.count(F.lit(1)).alias("k"))
    by_score = counts.groupBy("s").agg(F.sum("k").alias("k")).agg(
        F.sum("k").cast("long").alias("n_rows"), F.count("s").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("k"))), F.lit(0)).cast("long").alias("n_nonfinite"),
        F.max(F.when(F.col("s").isNotNull(), F.col("k"))).alias("_mode"),
    )
    constant = counts.groupBy("g").agg(F.count("s").alias("k")).agg(F.count_if(F.col("k") <= 1).alias("n_constant_groups"))
    modal = F.coalesce(F.col("_mode").cast("double") / F.col("n_rows"), F.lit(1.0))
    return by_score.join(F.broadcast(constant)).select("n_rows", "n_distinct", "n_nonfinite", modal.alias("modal_fraction"), "n_constant_groups")


TIE_HEAVY = 0.25


def apply_policy(diagnosed: DataFrame, policy: str = "warn") -> dict:
    """Row of diagnostics() as a dict with `degenerate` and `tie_heavy`; a degenerate score warns or raises by policy."""
    import warnings

    if policy not in ("ignore", "warn", "raise"):
        raise ValueError(f"unknown policy {policy!r}")
    row = diagnosed.first().asDict()
    row["degenerate"] = row["n_distinct"] <= 1 or row["n_nonfinite"] > 0
    row["tie_heavy"] = row["modal_fraction"] >= TIE_HEAVY
    if row["degenerate"] and policy == "raise":
        raise ValueError(f"degenerate scores: {row}")
    if row["degenerate"] and policy == "warn":
        warnings.warn(f"degenerate scores: {row}", stacklevel=2)
    return row


def wide_by_arm(by_group_arm: DataFrame, group: str, arm: str, arms: list[str], metric: str = "auc01") -> DataFrame:
    """One row a group: one metric column an arm, the group's n_pos and n_neg, and what can be compared.

    scorable: the metric of every arm is there, so the group counts in paired comparisons. same_rows: all arms were scored
    on as many rows of either class; where they weren't, the counts are those of the first arm. best: the arm of the largest
    metric, the first listed of equals, null without any.
    """
    out = by_group_arm.groupBy(group).pivot(arm, arms).agg(F.first(metric).alias("m"), F.first("n_pos").alias("p"), F.first("n_neg").alias("n"))
    of = lambda c: [F.col(f"`{a}_{c}`") for a in arms]
    every = lambda conditions: functools.reduce(lambda x, y: x & y, conditions)
    top = F.greatest(*of("m")) if len(arms) > 1 else of("m")[0]
    same = every([F.coalesce((p == of("p")[0]) & (n == of("n")[0]), F.lit(False)) for p, n in zip(of("p"), of("n"), strict=True)])
    return out.select(
        group, *(m.alias(f"{a}_{metric}") for a, m in zip(arms, of("m"), strict=True)),
        F.coalesce(*of("p")).cast("long").alias("n_pos"), F.coalesce(*of("n")).cast("long").alias("n_neg"),
        every([m.isNotNull() for m in of("m")]).alias("scorable"), same.alias("same_rows"),
        F.coalesce(*(F.when(m == top, F.lit(a)) for a, m in zip(arms, of("m"), strict=True))).alias("best"),
    )
