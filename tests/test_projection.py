"""Metric learning, two towers and retrieval in a projected space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vector
from rankloom.operators import projection, retrieval, sampling


def numeric(f, w, eps=1e-6):
    """Gradient of f by central differences."""
    out = []
    for part in w:
        g = np.zeros_like(part)
        for i in np.ndindex(part.shape):
            kept = part[i]
            part[i] = kept + eps
            up = f()
            part[i] = kept - eps
            g[i] = (up - f()) / (2 * eps)
            part[i] = kept
        out.append(g)
    return out


@pytest.mark.parametrize("two", [False, True])
def test_gradients_equal_finite_differences(two):
    r = np.random.default_rng(0)
    towers = [projection.first_weights(5, 4, 3, r) for _ in range(1 + two)]
    left, right, labels = r.normal(size=(9, 5)), r.normal(size=(9, 5)) if two else None, np.array([0, 0, 0, 1, 1, 2, 2, 2, 3])
    _, found = projection.batch_gradient(towers, left, right, labels, 0.3)
    for tower, own in zip(towers, found, strict=True):
        want = numeric(lambda: projection.batch_gradient(towers, left, right, labels, 0.3)[0], tower)
        for a, b in zip(own, want, strict=True):
            assert np.allclose(a, b, atol=1e-6)


def test_loss_by_hand_and_anchors_without_a_partner():
    z = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    loss, _, _ = projection.contrastive(z, z, np.array([0, 0, 1]), np.array([0, 0, 1]), 1.0, True)
    e = np.exp
    want = [-(0 - np.log(e(0) + e(1))), -(0 - np.log(e(0) + e(0)))]  # the third row has no partner
    assert loss == pytest.approx(np.mean(want))
    assert np.isnan(projection.contrastive(z, z, np.arange(3), np.arange(3), 1.0, True)[0])


def planted(spark, n=400, noise=1.0):
    """Labels show in two of twelve dimensions, the others are louder."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(n):
        k = i % 8
        x = r.normal(size=12) * 3
        x[:2] = np.array([np.cos(k * np.pi / 4), np.sin(k * np.pi / 4)]) * 2 + r.normal(size=2) * 0.2 * noise
        rows.append((i, k, [float(v) for v in x]))
    return spark.createDataFrame(rows, "i long, label int, v array<float>")


def fitted(spark, rows, epochs=25, **kw):
    mean, scale = projection.scaling(rows, "v")
    packed = []
    for part, n, seed in ((rows.filter("i % 5 > 1"), 12, 0), (rows.filter("i % 5 = 1"), 4, 1)):
        packed.append(projection.packed_batches(sampling.label_batches(part, "label", "i", n, 8, 8, seed), part, "label", "i", "v"))
    return projection.fit(*packed, 12, mean, scale, hidden=16, output=4, epochs=epochs, rate=0.03, **kw)


def share_right(df, v, **options):
    """Share of held-out rows whose nearest other row has their label."""
    q = df.filter("i % 5 = 0").select(F.lit(1).alias("g"), "i", "label", v)
    e = df.filter("i % 5 > 0").select(F.lit(1).alias("g"), F.col("i").alias("entry"), F.col(v).alias("w"))
    near = retrieval.nearest_vectors(q, e, "g", "i", v, "w", **options).withColumn("j", F.col("nearest").cast("long"))
    names = df.select(F.col("i").alias("j"), F.col("label").alias("other"))
    return near.join(names, "j").agg(F.avg((F.col("label") == F.col("other")).cast("double"))).first()[0]


def test_learned_space_ranks_better_and_is_the_same_again(spark):
    rows = planted(spark).repartition(3)
    heads, history = fitted(spark, rows)
    assert history[-1][1] < history[0][1] - 0.5 and min(h[2] for h in history) < history[0][2] - 0.5
    learned = projection.project(rows, "v", heads[0])
    assert share_right(learned, "projected") > share_right(rows, "v") + 0.2
    again, other = fitted(spark, rows.repartition(2), epochs=3)
    assert np.allclose([h[1:] for h in other], [h[1:] for h in history[:3]], atol=1e-9)
    unit = learned.select(F.max(F.abs(vector.norm("projected") - 1)).alias("d")).first().d
    assert unit < 1e-9


def test_early_stop_keeps_the_best_weights(spark):
    heads, history = fitted(spark, planted(spark, 200), epochs=30, patience=2, temperature=0.02)
    best = min(range(len(history)), key=lambda k: history[k][2])
    assert len(history) <= best + 3
    short, _ = fitted(spark, planted(spark, 200), epochs=best + 1, patience=2, temperature=0.02)
    assert all(np.allclose(a, b) for a, b in zip(heads[0].weights, short[0].weights, strict=True))


def test_blocked_retrieval_equals_row_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, f"g{i % 3}" if i % 50 else "lonely", [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(900, "g0", [0.0] * 4), (901, None, [1.0] * 4), (902, "g1", None), (903, "nobody", [1.0] * 4)]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>")
    q = df.filter("i % 4 = 0 or i > 899")
    e = df.filter("i % 4 <> 0 and i < 900").select("g", F.col("i").alias("entry"), F.col("v").alias("w"))
    names = ["i", "score", "nearest", "has_database", "database_size"]
    by_hand = {}
    held = {}
    for i, g, v in rows:
        if i % 4 and i < 900:
            held.setdefault(g, []).append((i, np.array(v)))
    for i, g, v in [x for x in rows if x[0] % 4 == 0 or x[0] > 899]:
        own = held.get(g, []) if g and v is not None else []
        cos = [(round(float(np.array(v) @ w / np.sqrt(np.array(v) @ np.array(v)) / np.sqrt(w @ w)), 12), -j) for j, w in own if any(v) and w.any()] if own else []
        best = max(cos, default=None)
        by_hand[i] = (best[0] if best else 0.0, str(-best[1]) if best else "", bool(own), len(own))
    for block in (7, 64, 5000):
        got = {x.i: tuple(x)[1:] for x in retrieval.nearest_vectors(q, e, "g", "i", "v", "w", block=block).select(*names).collect()}
        assert got.keys() == by_hand.keys()
        for i, want in by_hand.items():
            assert got[i][0] == pytest.approx(want[0], abs=1e-9) and got[i][1:] == want[1:], i
    top = {x.i: x.score for x in retrieval.nearest_vectors(q, e, "g", "i", "v", "w", top_k=3, block=20).collect()}
    i, g, v = rows[4]
    cos = sorted((float(np.array(v) @ w / np.sqrt(np.array(v) @ np.array(v)) / np.sqrt(w @ w)) for j, w in held[g] if w.any()), reverse=True)
    assert top[4] == pytest.approx(np.mean(cos[:3]), abs=1e-9)


def test_identity_projection_gives_the_plain_answers(spark):
    rows = planted(spark, 120)
    eye = [[float(i == k) for k in range(12)] for i in range(12)]
    assert share_right(rows.withColumn("w2", projection.linear("v", eye)), "w2") == share_right(rows, "v")
