"""Distributed linear fits against those of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import linear, models


def rows(n, d, seed, spread=1.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.r_[np.full(d - 1, spread), 0] + 3  # the last feature is constant
    y = (r.random(n) < 1 / (1 + np.exp(-np.clip(x[:, 0] - x[:, 1], -30, 30)))).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, f"g{i % 7}", a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, g string, x array<double>, y int").repartition(5)


@pytest.mark.parametrize(("n", "d", "c"), [(60, 3, 1.0), (500, 6, 1.0), (500, 6, 0.01), (40, 9, 100.0)])
def test_weights_equal_those_of_one_task(spark, n, d, c):
    x, y = rows(n, d, n + d)
    df = frame(spark, x, y)
    got = linear.fit(df, "x", "y", c=c)
    z = df.select("i", got.score("x").alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert np.abs(z - models.logistic_fit(x, y.astype(float), c)(x)).max() < 1e-8
    got = linear.fit(df, "x", "y", "svc", c=c)
    z = df.select("i", got.score("x").alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert np.abs(z - models.svc_fit(x, y.astype(float), c)(x)).max() < 1e-8


def test_far_scales_and_separable_classes(spark):
    x, y = rows(300, 4, 1, spread=1e6)
    df = frame(spark, x, y)
    assert np.isfinite(linear.fit(df, "x", "y").weights).all()
    clear = np.column_stack([y * 10.0 - 5, np.ones(300)])
    got = linear.fit(frame(spark, clear, y), "x", "y")
    want = models.logistic_fit(clear, y.astype(float))(clear)
    z = frame(spark, clear, y).select("i", got.score("x").alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert np.abs(z - want).max() < 1e-8


def test_nulls_one_class_and_unknown_models(spark):
    x, y = rows(80, 3, 2)
    df = frame(spark, x, y)
    odd = df.unionByName(spark.createDataFrame([(900, "g", None, 1), (901, "g", [1.0, 1.0, 1.0], None)], df.schema))
    assert np.allclose(linear.fit(odd, "x", "y").weights, linear.fit(df, "x", "y").weights, atol=1e-9)
    assert odd.filter("i = 900").select(linear.fit(df, "x", "y").score("x").alias("p")).first().p is None
    with pytest.raises(ValueError, match="labels 0 and 1"):
        linear.fit(df.filter("y = 1"), "x", "y")
    with pytest.raises(ValueError, match="unknown model"):
        linear.fit(df, "x", "y", "forest")


def test_shortcut_probes_find_the_side_that_gives_the_label_away(spark):
    r = np.random.default_rng(5)
    data = [(i, f"g{i % 6}", [float(v) for v in r.normal(size=3)], [float(v) for v in r.normal(size=3)]) for i in range(900)]
    df = spark.createDataFrame(data, "i long, g string, a array<double>, b array<double>").withColumn("y", (F.col("b")[0] > 0).cast("int"))
    got = {x.probe: x for x in linear.shortcut_probes(df.filter("i % 3 > 0"), df.filter("i % 3 = 0"), "a", "b", "y", "g").collect()}
    assert got["right_only"].pooled_auroc > 0.97 and got["right_only"].gap > 0.4
    assert abs(got["left_only"].pooled_auroc - 0.5) < 0.1 and got["left_only"].n_distinct == 300 and got["left_only"].n_scored == 2
    both = linear.pair_classifier(df.filter("i % 3 > 0"), df.filter("i % 3 = 0"), "a", "b", "y", "i").join(df, "i")
    right = both.agg(F.avg(((F.col("score") > 0).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.9 and both.count() == 300
