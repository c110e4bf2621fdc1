import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import bootstrap, metrics

TOY = [("A", y, s) for y, s in zip([1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [0.9, 0.5, 0.8, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05], strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, s double")


def one(spark, rows, **options):
    return {r.g: r for r in metrics.group_metrics(frame(spark, rows), "g", "y", "s", **options).collect()}


@pytest.mark.parametrize("cuts", [None, 4])
def test_hand_values(spark, cuts):
    r = one(spark, TOY, cuts=cuts)["A"]
    assert (r.auroc, r.ap, r.auc01) == (pytest.approx(13 / 16), pytest.approx(0.7), pytest.approx(14 / 19))
    worst = [("W", int(i == 9), 1 - i / 9) for i in range(10)]
    assert one(spark, worst, cuts=cuts)["W"].auc01 == pytest.approx(9 / 19)
    flat = one(spark, [("F", y, 0.3) for _, y, _ in TOY], cuts=cuts)["F"]
    assert (flat.auroc, flat.ap, flat.auc01) == (pytest.approx(0.5), pytest.approx(0.2), pytest.approx(0.5))


def test_macro_reports_single_class_groups(spark):
    rows = TOY + [("B", y, s) for y, s in zip([1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5], strict=True)]
    by = metrics.group_metrics(frame(spark, rows + [("N", 0, 0.1)] * 3 + [("P", 1, 0.1)] * 2), "g", "y", "s")
    r = metrics.macro(by, "g").first()
    assert r.macro_auc01 == pytest.approx((14 / 19 + 1) / 2)
    assert (r.n_scored, r.skipped) == (2, ["N", "P"])
    with pytest.raises(ValueError, match="one class"):
        metrics.strict_group_metrics(frame(spark, [("N", 0, 0.1)]), "g", "y", "s")


def test_fpr_cap(spark):
    scores = [0.99, 0.98, 0.97, 0.50, 0.40] + [0.96, 0.95] + [0.60] * 8 + [0.45] * 5 + [0.10] * 5
    r = one(spark, [("C", int(i < 5), s) for i, s in enumerate(scores)])["C"]
    assert (r.auc01, r.auroc) == (pytest.approx(0.7894736842105263), pytest.approx(0.75))


@pytest.mark.parametrize("cuts", [None, 8])
def test_against_thresholds(spark, cuts):
    r = random.Random(4)
    rows = [("R", int(r.random() < 0.3), r.randrange(40) / 10) for _ in range(400)]
    y, s = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    pos, neg = y.sum(), (1 - y).sum()
    auroc = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]) / pos / neg
    got = one(spark, rows, cuts=cuts)["R"]
    assert got.auroc == pytest.approx(auroc)
    order = np.unique(-s, return_inverse=True)[1]
    kernel = bootstrap.block_metrics(np.bincount(order, y), np.bincount(order, 1 - y))
    assert (got.auroc, got.ap, got.auc01) == tuple(pytest.approx(k, abs=1e-9) for k in kernel)


def test_weights_are_repeated_rows(spark):
    rows = [(g, y, s, i % 3) for i, (g, y, s) in enumerate(TOY)]
    df = spark.createDataFrame(rows, "g string, y int, s double, w int")
    again = [(g, y, s) for g, y, s, w in rows for _ in range(w)]
    a = metrics.group_metrics(df, "g", "y", "s", weight="w").first()
    assert a.auc01 == pytest.approx(one(spark, again)["A"].auc01)


def test_diagnostics_and_policy(spark):
    rows = TOY + [("B", 1, float("nan")), ("B", 0, None), ("C", 1, 0.5)]
    got = metrics.diagnostics(frame(spark, rows), "g", "s").first()
    assert (got.n_rows, got.n_distinct, got.n_nonfinite, got.n_constant_groups) == (13, 10, 2, 2)
    assert got.modal_fraction == pytest.approx(2 / 13)
    none = metrics.diagnostics(frame(spark, [("A", 1, float("nan"))]), "g", "s")
    assert none.first().modal_fraction == 1.0
    with pytest.raises(ValueError, match="degenerate"):
        metrics.apply_policy(none, "raise")
    with pytest.warns(UserWarning):
        assert metrics.apply_policy(none, "warn")["degenerate"]


def test_replicates_pair_arms_and_repeat(spark):
    r = random.Random(0)
    rows = [(f"g{i % 6}", int(r.random() < 0.4), i) for i in range(360)]
    df = spark.createDataFrame(rows, "g string, y int, i int").withColumns({"a": F.col("y") + F.rand(1), "b": F.col("y") + F.rand(1) * 0, "c": F.rand(2)})
    df = spark.createDataFrame(df.collect(), df.schema)
    got = bootstrap.replicates(df.withColumn("a2", F.col("a")), "g", "y", ["a", "a2", "b", "c"], "i", 40, seed=3).collect()
    assert all(x.a == x.a2 for x in got) and all(x.b == pytest.approx(1.0) for x in got)
    again = bootstrap.replicates(df, "g", "y", ["c"], "i", 40, seed=3).collect()
    assert {x.replicate: x.c for x in got} == {x.replicate: x.c for x in again}
    assert np.mean([x.b - x.c > 0.1 for x in got]) > 0.95
    assert not any(math.isnan(x.c) for x in got)
    with pytest.raises(ValueError, match="unknown mode"):
        bootstrap.replicates(df, "g", "y", ["c"], "i", 2, mode="neither")


def test_wide_table_flags(spark):
    """One arm without a class, an arm that is missing, other rows in an arm, equal metrics, no metric at all."""
    rows = [("both", "a", 2, 3, 0.6), ("both", "b", 2, 3, 0.7), ("tie", "a", 1, 1, 0.5), ("tie", "b", 1, 1, 0.5), ("only", "b", 4, 4, 0.9), ("rows", "a", 2, 2, 0.8), ("rows", "b", 2, 5, 0.4), ("none", "a", 3, 0, None), ("none", "b", 3, 0, None)]
    df = spark.createDataFrame(rows, "g string, arm string, n_pos long, n_neg long, auc01 double")
    got = {r.g: tuple(r)[1:] for r in metrics.wide_by_arm(df, "g", "arm", ["a", "b"]).collect()}
    assert got == {
        "both": (0.6, 0.7, 2, 3, True, True, "b"), "tie": (0.5, 0.5, 1, 1, True, True, "a"), "only": (None, 0.9, 4, 4, False, False, "b"),
        "rows": (0.8, 0.4, 2, 2, True, False, "a"), "none": (None, None, 3, 0, False, True, None),
    }
    one_arm = {r.g: (r.scorable, r.best) for r in metrics.wide_by_arm(df, "g", "arm", ["a"]).collect()}
    assert one_arm["both"] == (True, "a") and one_arm["only"] == (False, None)
