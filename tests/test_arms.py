"""Grids of fits, fold and transfer arms against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import models
from rankloom.plans import experiment


@pytest.fixture(scope="module")
def rows(spark):
    """Three groups, four folds; sequences of four letters whose first letter and group give the value."""
    r = np.random.default_rng(0)
    data = []
    for i in range(360):
        g, s = f"g{i % 3}", "".join(r.choice(list("abcd"), 4))
        v = {"a": 0.9, "b": 0.7, "c": 0.3, "d": 0.1}[s[0]] if g != "g2" else {"a": 0.1, "b": 0.3, "c": 0.7, "d": 0.9}[s[0]]
        data.append((i, g, s, float(np.clip(v + r.normal() * 0.05, 0, 1)), int(v > 0.5), int(r.integers(4))))
    return spark.createDataFrame(data, "i long, g string, seq string, v double, y int, fold int").repartition(3)


CODES = [("g0", "aabb"), ("g1", "aabc"), ("g2", "ddcc")]
FEW = {"hidden": [8], "seeds": [0, 1], "epochs": 60, "rate": 0.02, "batch": 32}


def test_a_grid_equals_single_fits(spark, rows):
    own = rows.withColumn("x", models.hot("seq", 4, "abcd")).withColumn("side", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "validation").otherwise("train"))
    settings = models.networks([5, 7], [0, 3], epochs=15, width=16)
    got = {(x.g, x.setting, x.i): x.score for x in models.fit_grid(own, settings, ["g"], "x", "v", "i").collect()}
    pdf = own.toPandas().sort_values("i")
    dense = lambda p: models._dense(p["x"], 16)
    assert dense(pdf).sum(1).tolist() == [4.0] * 360 and dense(pdf)[0].argmax() == "abcd".index(pdf["seq"].iloc[0][0])
    n = 0
    for g, part in pdf.groupby("g"):
        a, v, t = (part[part["side"] == k] for k in ("train", "validation", "test"))
        for k, s in enumerate(settings):
            f = models.mlp_fit(dense(a), a["v"].to_numpy(), dense(v), v["v"].to_numpy(), s["hidden"], s["seed"], epochs=15)
            for i, want in zip(t["i"], f(dense(t)), strict=True):
                assert got[g, k, i] == pytest.approx(want, abs=1e-12)
                n += 1
    assert n == len(got)
    mean = {(x.g, x.i): x.score for x in models.ensemble(own, "x", "v", "i", "g", [5, 7], [0, 3], epochs=15, width=16).collect()}
    assert all(mean[g, i] == pytest.approx(np.mean([got[g, k, i] for k in range(4)])) for g, i in mean)


def test_a_fit_holds_indices_and_not_dense_rows():
    """60,000 one-hot rows of 400 columns: 192 MB if dense, which a fit must not hold."""
    import tracemalloc

    r = np.random.default_rng(4)
    rows, y = r.integers(0, 400, (60_000, 1)).astype(np.int32), r.random(60_000)
    m, s = models.Features(rows, 400).scale()
    share = np.bincount(rows[:, 0], minlength=400) / 60_000
    assert np.allclose(m, share) and np.allclose(s, np.sqrt(share * (1 - share)))
    tracemalloc.start()
    models.mlp_fit(models.Features(rows, 400), y, models.Features(rows[:100], 400), y[:100], 4, 0, epochs=1, batch=2048)(models.Features(rows, 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180e6


def test_arms_fit_their_own_rows(spark, rows):
    long = rows.withColumn("side", F.when(F.col("fold") == 0, "test").otherwise("train")).withColumn("p", F.lit(1))
    each = F.explode(F.array(F.struct(F.lit("seq").alias("arm"), models.hot("seq", 4, "abcd").alias("x")), F.struct(F.lit("none").alias("arm"), F.array(F.lit(0)).alias("x")))).alias("a")
    both = long.select("p", "i", "v", "side", each).select("p", "i", "v", "side", "a.*")
    got = models.arm_ensembles(both, "arm", "p", "x", "v", "i", {"seq": 16, "none": 1}, [6], [0], epochs=80)
    spread = {x.arm: x.s for x in got.groupBy("arm").agg(F.stddev("score").alias("s")).collect()}
    assert spread["seq"] > 0.05 and spread["none"] < 1e-9


def auroc(rows, score):
    p = rows.toPandas()
    a, b = p[p["y"] == 1][score].to_numpy(), p[p["y"] == 0][score].to_numpy()
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def test_fold_arms_score_every_row_once(spark, rows):
    codes = spark.createDataFrame(CODES, "g string, code string")
    got = experiment.fold_arms(rows, "fold", "g", "seq", "y", "i", 4, "abcd", codes=codes, target="v", **FEW)
    assert got.groupBy("arm").count().collect() and {(x.arm, x["count"]) for x in got.groupBy("arm").count().collect()} == {(a, 360) for a in experiment.FOLD_ARMS}
    wide = got.groupBy("i").pivot("arm").agg(F.first("score")).join(rows, "i")
    for arm in ("mlp_pseudo_sequence", "mlp_one_hot", "matrix"):
        assert auroc(wide, arm) > 0.9, arm
    assert abs(auroc(wide, "random") - 0.5) < 0.1


def test_transfer_arms_and_comparisons(spark, rows):
    """g0 and g1 behave alike and have near codes; g2 is the other way round."""
    codes = spark.createDataFrame(CODES, "g string, code string")
    scores = experiment.transfer_scores(rows, rows.select("g").distinct(), "g", "seq", "y", "i", 4, "abcd", codes=codes, target="v", **FEW)
    assert scores.count() == 360 and set(experiment.TRANSFER_ARMS) <= set(scores.columns)
    assert scores.filter(" or ".join(f"{a} is null" for a in experiment.TRANSFER_ARMS)).isEmpty()
    first = scores.filter("partition_id = 'g0'")
    assert auroc(first, "nearest_matrix") > 0.9 and auroc(first, "pseudo_sequence") > 0.8
    assert auroc(first, "pseudo_sequence") > auroc(first, "shuffled_mapping")
    report = {(x.arm, x.metric): x for x in experiment.transfer(scores, "y", "i", 50, "ignore").collect()}
    assert len(report) == 21 and report["nearest_matrix", "auc01"].n_scored == 3
    compared = {x.reference: x for x in experiment.transfer_comparisons(scores, "y", "i", 50).collect()}
    assert set(compared) == set(experiment.REFERENCES) and all(x.n_groups == 3 and x.low <= x.high for x in compared.values())


def test_layer_sweep_chooses_by_validation(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 300)
    data = [(i, m, k, f"g{i % 2}", int(y[i]), [float(r.normal() + y[i] * best)], "test" if i % 3 == 0 else "train") for i in range(300) for m, k, best in (("m1", 0, 0.0), ("m1", 1, 3.0), ("m2", 0, 3.0), ("m2", 1, 0.5))]
    df = spark.createDataFrame(data, "i long, model string, layer int, g string, y int, x array<double>, side string")
    got = {(x.model, x.layer): x for x in models.layer_sweep(df, "model", "layer", "g", "x", "y", "i").collect()}
    assert {k for k, x in got.items() if x.chosen} == {("m1", 1), ("m2", 0)} and got["m1", 1].macro_auroc > 0.95 and got["m1", 0].n_scored == 2


def test_constant_columns_take_no_part_in_the_steps():
    """20,000 one-hot columns of which the fitted rows use twelve: 330 MB a block of 2,048 rows if dense, which a fit must not make."""
    import tracemalloc

    r = np.random.default_rng(6)
    rows = np.stack([r.integers(0, 10, 4000), r.integers(19_000, 19_002, 4000), np.full(4000, 500)], 1).astype(np.int32)
    y = np.clip(0.1 * rows[:, 0] + r.normal(0, 0.05, 4000), 0, 1)
    other = rows[3000:].copy()
    other[:, 1:] = [19_500, 501]  # the scored rows have ones where the fitted have none, and the other way round
    tracemalloc.start()
    got = models.mlp_fit(models.Features(rows[:2000], 20_000), y[:2000], models.Features(rows[2000:3000], 20_000), y[2000:3000], 5, 0, epochs=20)(models.Features(other, 20_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    # columns beyond 600 are folded into a narrow dense table, with the same start of the weights
    narrow = lambda x: np.where(x == 19_000, 520, np.where(x == 19_001, 521, np.where(x == 19_500, 522, x)))
    few = [models.Features(narrow(x).astype(np.int32), 600) for x in (rows[:2000], rows[2000:3000], other)]
    sparse = models.mlp_fit(few[0], y[:2000], few[1], y[2000:3000], 5, 0, epochs=20)(few[2])
    dense = models.mlp_fit(few[0].dense(), y[:2000], few[1].dense(), y[2000:3000], 5, 0, epochs=20)(few[2].dense())
    assert np.allclose(sparse, dense, atol=1e-9) and got.std() > 0.01


def test_a_logistic_fit_ends_where_rounding_hides_the_loss(monkeypatch):
    """Counts of letters that add up to a constant, classes at random: the loss is flat to its last digit before the gradient is small."""
    steps, solve = [], np.linalg.solve
    monkeypatch.setattr(models.np.linalg, "solve", lambda *a: steps.append(1) or solve(*a))
    r = np.random.default_rng(0)
    d = r.integers(0, 10, (10_000, 5))
    x = np.column_stack([np.full(10_000, 9.0), *((d == k).sum(1) + 4 * (k == 0) for k in range(10))])
    p = models.logistic_fit(x, (r.random(10_000) < 0.5).astype(float))(x)
    assert len(steps) < 20 and 0.3 < p.min() < p.max() < 0.7


def test_packed_blocks_hold_every_row_once(spark, rows):
    """Rows travel to the fits as blocks of one arm and side with their indices as one value, whatever their order."""
    own = rows.withColumn("x", models.hot("seq", 4, "abcd")).withColumn("side", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, None).otherwise("train"))
    got = models.packed(own.repartition(2, "i"), ["g", "side"], "x", "v", "i", "int16").collect()
    want = {x.i: (x.g, x.side, x.v, x.x) for x in own.collect()}
    seen = {}
    for b in got:
        x = np.frombuffer(b["_x"], "int16").reshape(len(b["_ids"]), 4)
        assert len(b["_ids"]) == len(b["_v"]) <= models.AT_A_TIME
        seen |= {i: (b.g, b.side, v, r.tolist()) for i, v, r in zip(b["_ids"], b["_v"], x, strict=True)}
    assert seen == want and sum(len(b["_ids"]) for b in got) == 360 and len(got) <= 2 * 9 + 2
    with pytest.raises(Exception, match="rows without features"):
        models.packed(own.withColumn("x", F.when(F.col("i") > 3, F.col("x"))), ["g"], "x", "v", "i", "int16").collect()


def test_hashed_embedding_takes_its_counts_and_norm_once(spark):
    """As by the plain formula, bit for bit, without a filter for each place and a norm for each value of a vector."""
    from rankloom.functions import vector

    df = spark.createDataFrame([("",), ("a",), ("abcabc",), ("000000123",)], "seq string")
    own = models.hashed_embedding(df, "seq")
    slots = F.expr("transform(sequence(1, greatest(length(seq) - 2, 1)), i -> pmod(xxhash64(substring(seq, i, 3)), 32))")
    plain = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.size(F.filter(slots, lambda x: x == j)).cast("double"))
    want = {x.seq: x.v for x in df.withColumn("n", plain).select("seq", vector.normalise("n").alias("v")).collect()}
    assert {x.seq: x.vec for x in own.collect()} == want
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and plan.lower().count("sqrt(") <= 2, plan
