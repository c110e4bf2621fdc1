"""The distributed bootstrap against plain resampling of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import bootstrap, resampling
from rankloom.plans import experiment


def metrics_of(y, s):
    """(auroc, ap, auc01) of rows, by blocks of one row set."""
    block = np.unique(-s, return_inverse=True)[1]
    return bootstrap.block_metrics(np.bincount(block, y), np.bincount(block, 1 - y))


def table(spark, n=900, groups=7, seed=0, ties=True):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.3).astype(int)
    a = np.round(r.normal(size=n) + y, 1 if ties else 9)
    b = np.round(r.normal(size=n), 1 if ties else 9)
    g = np.array([f"g{i}" for i in r.integers(0, groups, n)])
    y[g == "g0"] = 0  # a group of one class
    rows = [(int(i), str(g[i]), int(y[i]), float(a[i]), float(b[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i long, g string, y int, a double, b double").repartition(4), (g, y, a, b)


def test_kernel_over_many_draws_equals_single_draws():
    r = np.random.default_rng(1)
    p, n = r.integers(0, 3, (50, 12)), r.integers(0, 4, (50, 12))
    p[0] = 0
    got = resampling.block_metrics(p, n)
    assert np.isnan(got[0]).all()
    for k in range(1, 50):
        assert np.allclose(got[k], bootstrap.block_metrics(p[k], n[k]))


@pytest.mark.parametrize("ties", [True, False])
def test_groups_mode_equals_the_drawn_groups(spark, ties):
    """Without draws of rows everything follows from how often each group was drawn."""
    df, (g, y, a, b) = table(spark, ties=ties)
    n = 60
    found = resampling.samples(df, "g", "y", ["a", "b"], "i", n, "groups", 5, every_group=True, pooled=True)
    names = df.select(F.col("g")).distinct()
    times = {(x.r, x.g): x.t for x in resampling.group_times(names, n, "groups", 5).collect()}
    macro = {(x.replicate, x.arm): x for x in resampling.macro_samples(found, ["A", "B"]).collect()}
    pooled = {(x.replicate, x.arm): x for x in resampling.pooled_samples(found, ["A", "B"], n).collect()}
    assert len(macro) == len(pooled) == 2 * n
    for r in range(n):
        drawn = [k for k in np.unique(g) for _ in range(times.get((r, k), 0))]
        assert len(drawn) == 7
        for arm, s in (("A", a), ("B", b)):
            each = [metrics_of(y[g == k], s[g == k]) for k in drawn if 0 < y[g == k].sum() < (g == k).sum()]
            want = np.mean(each, axis=0)
            got = macro[r, arm]
            assert np.allclose([got.auroc, got.ap, got.auc01], want)
            at = np.concatenate([np.flatnonzero(g == k) for k in drawn])
            whole = metrics_of(y[at], s[at])
            assert np.allclose([pooled[r, arm].auroc, pooled[r, arm].ap], whole[:2])


@pytest.mark.parametrize("mode", ["rows", "both"])
def test_rows_are_drawn_as_plain_resampling_draws_them(spark, mode):
    df, (g, y, a, b) = table(spark, 600, 4)
    n = 600
    found = resampling.samples(df, "g", "y", ["a", "b"], "i", n, mode, 3, every_group=True, pooled=True)
    macro = {arm: np.array([[x.auroc, x.ap, x.auc01] for x in sorted(resampling.macro_samples(found, ["a", "b"]).filter(F.col("arm") == arm).collect())], float) for arm in "ab"}
    pooled = np.array([[x.auroc, x.ap] for x in resampling.pooled_samples(found, ["a", "b"], n).filter("arm = 'a'").collect()], float)
    r, names = np.random.default_rng(0), np.unique(g)
    want, whole, paired = [], [], []
    for _ in range(n):
        drawn = r.choice(names, len(names)) if mode == "both" else names
        rows = [(lambda own: own[r.integers(0, len(own), len(own))])(np.flatnonzero(g == k)) for k in drawn]
        each = [(metrics_of(y[i], a[i]), metrics_of(y[i], b[i])) for i in rows if 0 < y[i].sum() < len(i)]
        if each:
            want.append(np.mean([e[0] for e in each], axis=0))
            paired.append(np.mean([e[0][2] - e[1][2] for e in each]))
        whole.append(metrics_of(y[np.concatenate(rows)], a[np.concatenate(rows)])[:2])
    for got, plain in ((macro["a"], np.array(want)), (pooled, np.array(whole))):
        got, plain = got[~np.isnan(got).any(1)], plain[~np.isnan(plain).any(1)]
        assert np.abs(got.mean(0) - plain.mean(0)).max() < 4 * (plain.std(0) / n**0.5).max() * 1.5
        assert np.abs(got.std(0) / plain.std(0) - 1).max() < 0.2
    difference = macro["a"][:, 2] - macro["b"][:, 2]
    assert abs(np.nanstd(difference) / np.nanstd(paired) - 1) < 0.2  # arms share their rows


def test_same_draws_whatever_the_partitions(spark):
    df, _ = table(spark, 400, 3)
    one = {(x.replicate, x.arm): (x.auroc, x.auc01) for x in resampling.macro_samples(resampling.samples(df, "g", "y", ["a", "b"], "i", 40, "both", 1), ["a", "b"]).collect()}
    two = {(x.replicate, x.arm): (x.auroc, x.auc01) for x in resampling.macro_samples(resampling.samples(df.repartition(9), "g", "y", ["a", "b"], "i", 40, "both", 1), ["a", "b"]).collect()}
    assert one == two
    copies = bootstrap.replicates(df.withColumn("c", F.col("a")), "g", "y", ["a", "c"], "i", 30, "both")
    assert all(x.a == x.c for x in copies.collect())


def test_rows_travel_as_codes_of_cells(spark, monkeypatch):
    """What goes to the chunks is pieces with one byte a row, however they are cut; the draws are those of the rows."""
    df, (g, y, a, b) = table(spark, 900, 3)
    rows = resampling.evaluation_rows(df.withColumns({"a": F.floor("a"), "b": F.floor("b")}), "g", "y", ["a", "b"], "i")
    whole = {(x.replicate, x.arm): (x.auroc, x.ap, x.auc01) for x in resampling.macro_samples(resampling.samples(df, "g", "y", ["a", "b"], "i", 60, "both", 2), ["a", "b"]).collect()}
    packed = resampling.pieces(rows, 2)
    assert packed.count() <= 3 * 4 and packed.agg(F.sum(F.length("code"))).first()[0] == 900
    monkeypatch.setattr(resampling, "PIECE", 16)
    for k in np.unique(g):
        own = resampling.pieces(rows, 2).filter(F.col("g") == str(k)).orderBy("part", "seq").collect()
        assert len(own) >= (g == k).sum() / 16
        for c, kind, want in (("y", "<i4", y), ("s0", "<f8", np.floor(a)), ("s1", "<f8", np.floor(b))):
            got = np.concatenate([np.frombuffer(x[c], kind)[np.frombuffer(x["code"], "u1")] for x in own])
            assert (got == want[g == k]).all()
    cut = {(x.replicate, x.arm): (x.auroc, x.ap, x.auc01) for x in resampling.macro_samples(resampling.samples(df, "g", "y", ["a", "b"], "i", 60, "both", 2), ["a", "b"]).collect()}
    assert cut == whole


def test_arms_of_other_rows_draw_their_own(spark):
    df, _ = table(spark, 700, 4)
    df = df.withColumns({"c": F.col("a"), "few": F.col("i") % 3 > 0, "every": F.col("i") >= 0})
    shared = bootstrap.replicates(df, "g", "y", ["a", "c"], "i", 300, "rows", masks={"c": "few"}).toPandas()
    own = bootstrap.replicates(df, "g", "y", ["a", "c"], "i", 300, "rows", masks={"c": "few"}, own_rows=True).toPandas()
    assert shared.corr().loc["a", "c"] > 0.6 and abs(own.corr().loc["a", "c"]) < 0.2
    same = bootstrap.replicates(df, "g", "y", ["a", "c"], "i", 30, "rows", masks={"c": "every"}, own_rows=True).toPandas()
    assert (same["a"] == same["c"]).all()
    kept = df.filter("few")
    one = bootstrap.replicates(df, "g", "y", ["a", "b"], "i", 40, "rows", masks={"a": "few", "b": "few"}, own_rows=True).toPandas()
    two = bootstrap.replicates(kept, "g", "y", ["a", "b"], "i", 40, "rows").toPandas()
    assert np.allclose(one.sort_values("replicate").to_numpy(), two.sort_values("replicate").to_numpy())


def test_evaluate_in_one_call(spark):
    df, (g, y, a, b) = table(spark, 800, 5)
    got = {(x.arm, x.metric): x for x in experiment.evaluate(df, "g", "y", {"A": "a", "B": "b"}, "i", 200).collect()}
    assert len(got) == 6
    for k, m in enumerate(resampling.METRICS):
        x = got["A", m]
        assert x.pooled == pytest.approx(metrics_of(y, a)[k], abs=1e-9)
        assert x.low < x.macro < x.high and x.n_replicates == 200 and (x.n_scored, x.n_skipped) == (4, 1)
        assert (x.pooled_low is None) == (m == "auc01") and (m == "auc01" or x.pooled_low < x.pooled < x.pooled_high)
        assert x.n_distinct == len(np.unique(a)) and not x.degenerate and not x.tie_heavy
    with pytest.raises(ValueError, match="nothing to evaluate"):
        experiment.evaluate(df.filter("false"), "g", "y", {"A": "a"}, "i", 5)
    with pytest.raises(ValueError, match="degenerate"):
        experiment.evaluate(df.withColumn("a", F.lit(1.0)), "g", "y", {"A": "a"}, "i", 5, policy="raise")
    with pytest.raises(ValueError, match="no group"):
        experiment.compare(df.filter("g = 'g0'"), "g", "y", "a", "b", "i", 5)
    one = experiment.evaluate(df.filter("g = 'g0'"), "g", "y", {"A": "a"}, "i", 5).filter("metric = 'auroc'").first()
    assert one.pooled is None and one.macro is None and one.low is None and one.n_replicates == 0


def test_what_known_rows_add(spark):
    """Known rows are scored by their label, the others at random: all the skill comes from them."""
    df, (g, y, a, b) = table(spark, 900, 5)
    df = df.withColumn("known", F.col("i") % 2 == 0).withColumn("s", F.when(F.col("known"), F.col("y") + F.col("b") / 100).otherwise(0.5 + F.col("b") / 100))
    got = experiment.lookup_decomposition(df, "g", "y", "s", "known", "i", 200).first()
    assert got.low > 0.05 and got.low < got.difference < got.high and got.p < 0.05 and got.n_groups == 4 and got.share_exact == 0.5
    none = experiment.lookup_decomposition(df.withColumn("known", F.lit(False)), "g", "y", "s", "known", "i", 20).first()
    assert none.difference == 0 and none.low == none.high == 0 and none.share_exact == 0


def test_correlations_by_moments(spark, monkeypatch):
    """Over several parts and blocks of slots, against the slots drawn one by one."""
    from rankloom.functions import rng

    monkeypatch.setattr(bootstrap, "PART", 64)
    monkeypatch.setattr(bootstrap, "SLOTS", 50)
    r = np.random.default_rng(2)
    x, w = r.normal(size=230) + 1e6, r.normal(size=230)
    z = [None if i % 11 == 0 else float(v) for i, v in enumerate(x + w)]
    df = spark.createDataFrame([(i * 3, float(x[i]), float(w[i]), z[i], 1.0) for i in range(230)], "k long, x double, y double, z double, one double").repartition(5)
    got = {v.replicate: v for v in bootstrap.correlation_over_points(df, "k", "x", ["y", "z", "one"], 40, seed=9).collect()}
    assert len(got) == 40
    for n in range(40):
        at = rng.slots(9, n, 230, 0, 230)
        assert got[n].r_y == pytest.approx(np.corrcoef(x[at], w[at])[0, 1], abs=1e-9)
        some = np.array([i for i in at if z[i] is not None])
        assert got[n].r_z == pytest.approx(np.corrcoef(x[some], [z[i] for i in some])[0, 1], abs=1e-9) and got[n].r_one is None
