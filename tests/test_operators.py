import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import rng, text, vector
from rankloom.operators import checks, models, retrieval, sampling, splits, stats
from rankloom.sources import io

TRAIN = [("AAAAAAAAA", "CASSLGQ", 1), ("AAAAAAAAA", "CASSLGF", 1), ("AAAAAAAAA", "CASSLGQ", 1), ("CCCCCCCCC", "CWWWWWW", 1), ("AAAAAAAAA", "XX", 0)]


def nearest(spark, queries, **options):
    train = spark.createDataFrame(TRAIN, "g string, seq string, y int")
    q = spark.createDataFrame(queries, "g string, seq string")
    return {(r.g, r.seq): r for r in retrieval.nearest_positive(q, retrieval.database(train, "g", "seq", "y"), "g", "seq", **options).collect()}


def test_nearest_positive(spark):
    got = nearest(spark, [("AAAAAAAAA", "CASSLGQ"), ("AAAAAAAAA", "CASSLG"), ("ZZZ", "CASS")])
    assert (got["AAAAAAAAA", "CASSLGQ"].score, got["AAAAAAAAA", "CASSLGQ"].nearest, got["AAAAAAAAA", "CASSLGQ"].database_size) == (1.0, "CASSLGQ", 2)
    assert got["AAAAAAAAA", "CASSLG"].nearest == "CASSLGF"  # a tie goes to the smaller entry
    z = got["ZZZ", "CASS"]
    assert (z.score, z.nearest, z.has_database, z.database_size) == (0.0, "", False, 0)


def test_nearest_leave_out_and_top_k(spark):
    got = nearest(spark, [("AAAAAAAAA", "CASSLGQ"), ("CCCCCCCCC", "CWWWWWW")], leave_out_exact=True)
    assert got["AAAAAAAAA", "CASSLGQ"].nearest == "CASSLGF"
    c = got["CCCCCCCCC", "CWWWWWW"]
    assert (c.score, c.nearest, c.has_database, c.database_size) == (0.0, "", True, 1)
    top = nearest(spark, [("AAAAAAAAA", "CASSLGQ")], top_k=5)["AAAAAAAAA", "CASSLGQ"]
    assert top.score == pytest.approx((1 + 6 / 7) / 2)
    left = nearest(spark, [("AAAAAAAAA", "CASSLGQ")], top_k=5, leave_out_exact=True)["AAAAAAAAA", "CASSLGQ"]
    assert left.score == pytest.approx(6 / 7)
    with pytest.raises(ValueError, match="top_k"):
        nearest(spark, [], top_k=0)


def test_text_functions(spark):
    df = spark.createDataFrame([(" cassfsgntgelff\n", "abc", "abd"), ("", "", "")], "a string, b string, c string")
    rows = df.select(text.strip_anchors("a"), text.edit_similarity("b", "c"), text.hamming("b", "c"), text.composition("a", "SF"), text.rounded_distance(F.lit(0.5), 5)).collect()
    assert tuple(rows[0])[:3] == ("ASSFSGNTGELF", pytest.approx(2 / 3), 1)
    assert (rows[1][1], rows[1][2], rows[0][4]) == (1.0, 0, 2)
    with pytest.raises(Exception, match="equal length"):
        df.select(text.hamming("a", "b")).collect()
    matrix = {"A": [1.0, 2.0], "B": [3.0, 4.0]}
    one = spark.createDataFrame([("AB",), ("",)], "s string").select(text.residue_encode("s", matrix)).collect()
    assert [r[0] for r in one] == [[1.0, 2.0, 3.0, 4.0], []]
    d = text.derangement(spark.createDataFrame([("x", "b"), ("y", "a"), ("z", "c")], "k string, v string"), "k", "v").collect()
    assert {r.k: r.shifted for r in d} == {"y": "b", "x": "c", "z": "a"}
    with pytest.raises(ValueError, match="two different"):
        text.derangement(spark.createDataFrame([("x", "b")], "k string, v string"), "k", "v")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [[2.0], [4.0]], [0.0, 0.0])], "a array<double>, b array<double>, r array<array<double>>, z array<double>")
    padded, mask = vector.pad("r", 3, 1)
    row = df.withColumns({"p": padded, "m": mask}).select(vector.cosine("a", "b"), vector.masked_mean("p", "m"), vector.cosine("a", "z"), F.size("p"), vector.pair_features("a", "b", "interactions")).first()
    assert row[0] == pytest.approx(math.sqrt(0.5)) and row[1] == [3.0] and math.isnan(row[2]) and row[3] == 3
    assert row[4] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0] and vector.feature_width("interactions", 2) == 8


PAIRS = [("AAAAAAAAA", "CASSA"), ("AAAAAAAAV", "CASSB"), ("CCCCCCCCC", "CASSC"), ("DDDDDDDDD", "CASSD"), ("EEEEEEEEE", "CASSE"), ("AAAAAAAAA", "CASSX"), ("CCCCCCCCC", "CASSX")]


@pytest.mark.parametrize("strategy", ["shuffle", "matched", "hard", "uniform"])
def test_negatives_hit_no_known_pair(spark, strategy):
    df = spark.createDataFrame([(i, g, s, f"H{g[0]}", 1) for i, (g, s) in enumerate(PAIRS)], "i int, g string, seq string, hla string, label int")
    out = sampling.sample(df, "g", "seq", "i", strategy, 2.0, attribute="hla").collect()
    assert out and not {(r.g, r.seq) for r in out} & set(PAIRS)
    assert len({(r.source_row_id, r.g) for r in out}) == len(out)
    assert all(r.label == 0 and r.hla == f"H{r.g[0]}" and r.seq == PAIRS[r.source_row_id][1] for r in out)
    if strategy == "uniform":
        assert {(r.g, r.seq) for r in out} == {(g, s) for g, _ in PAIRS for _, s in PAIRS} - set(PAIRS)
    else:
        per = {i: sum(r.source_row_id == i for r in out) for i in range(7)}
        assert per == dict.fromkeys(range(7), 2)
    if strategy == "hard":
        assert ("AAAAAAAAV", 0) in {(r.g, r.source_row_id) for r in out}


def test_sampling_guards(spark):
    df = spark.createDataFrame([(i, g, s, 1) for i, (g, s) in enumerate(PAIRS)], "i int, g string, seq string, label int")
    with pytest.raises(ValueError, match="ratio"):
        sampling.sample(df, "g", "seq", "i", "shuffle", 0)
    with pytest.raises(ValueError, match="unknown strategy"):
        sampling.sample(df, "g", "seq", "i", "best")
    with pytest.raises(ValueError, match="exceed"):
        sampling.uniform(df, *sampling.context(df, "g", "seq"), "g", "seq", "i", guard=3)
    with pytest.raises(ValueError, match="missing columns"):
        sampling.sample(df.drop("seq"), "g", "seq", "i")
    with pytest.raises(ValueError, match="short of negatives"):
        sampling.evaluation_set(df, df.limit(0), "g", "seq", "i", 5, 5)


def test_components_and_split(spark):
    edges = [("P1", "A"), ("P1", "B"), ("P2", "B"), ("P2", "C"), ("P3", "D"), ("P4", "E"), ("P4", "F")]
    df = spark.createDataFrame(edges, "p string, c string")
    labels = {r.node: r.component for r in splits.component_labels(df, "p", "c").collect()}
    assert len(set(labels.values())) == 3 and labels["l|P1"] == labels["l|P2"] == labels["r|C"] == "l|P1"
    sides = splits.component_split(splits.row_components(df, "p", "c"), 0.3).collect()
    by = {}
    for r in sides:
        by.setdefault(r.component, set()).add(r.side)
    assert all(len(s) == 1 for s in by.values()) and by["l|P1"] == {"train"} and "test" in {x for s in by.values() for x in s}
    with pytest.raises(ValueError, match="fraction"):
        splits.component_split(df, 1.0)


def test_holdout_preflight_and_strata(spark):
    rows = [(i, f"a{i % 3}", f"s{i % 4}", i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "i int, g string, seq string, y int")
    parts = splits.holdout(df, df.select("g").distinct(), "g")
    assert parts.count() == 72
    with pytest.raises(ValueError, match="both sides"):
        splits.preflight(parts, "g", "seq", "y")
    strat = splits.stratified_split(df, ["g", "y"], "i", 0.25).groupBy("g", "y", "side").count().collect()
    assert {(r.side, r["count"]) for r in strat} == {("validation", 1), ("fit", 3)}


def test_complete_linkage(spark):
    rows = [("a", "AAAA"), ("b", "AAAC"), ("c", "CCCC"), ("d", "CCCA"), ("e", "GGGG")]
    got = {r.name: (r.cluster, r.cut) for r in splits.complete_linkage(spark.createDataFrame(rows, "n string, s string"), "n", "s").collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and len({v[0] for v in got.values()}) == 3 and got["a"][1] == 1


def test_pwm_hand_value(spark):
    train = spark.createDataFrame([("H", "AAAAAAAAA", 1), ("H", "CAAAAAAAA", 1), ("H", "DAAAAAAAA", 0)], "g string, seq string, y int")
    test = spark.createDataFrame([(1, "H", "AAAAAAAAA")], "i int, g string, seq string")
    matrix = models.pwm(train, "g", "seq", "y")
    want = math.log((2 / 22) / (1 / 21)) + 8 * math.log((3 / 22) / (2 / 21))
    assert models.pwm_score(test, matrix, "g", "seq", "i").first().score == pytest.approx(want)
    with pytest.raises(ValueError, match="no weight matrix"):
        models.pwm_score(test.withColumn("g", F.lit("Z")), matrix, "g", "seq", "i")


def test_linear_models_separate():
    gen = np.random.default_rng(0)
    x = gen.normal(size=(200, 3))
    y = (x[:, 0] + 0.1 * gen.normal(size=200) > 0).astype(float)
    assert ((models.logistic_fit(x, y)(x) > 0.5) == y).mean() > 0.95
    assert ((models.svc_fit(x, y)(x) > 0) == y).mean() > 0.95
    p = models.mlp_fit(x, y, x, y, 16, 0, epochs=60)
    assert ((p(x) > 0.5) == y).mean() > 0.9
    assert (models.mlp_fit(x, y, x, y, 16, 0, epochs=5)(x) == models.mlp_fit(x, y, x, y, 16, 0, epochs=5)(x)).all()


def test_logistic_optimum():
    x, y = np.array([[-1.0], [1.0]]), np.array([0.0, 1.0])
    p = models.logistic_fit(x, y, c=1.0)(x)[1]
    w = math.log(p / (1 - p))
    assert w == pytest.approx(2 * (1 - p), abs=1e-6)  # the gradient of 2 log-losses and w^2/2 vanishes


def test_slope_and_rule(spark):
    df = spark.createDataFrame([(0.1, 0.8), (0.2, 0.6), (0.3, 0.4), (0.4, 0.2)], "x double, y double")
    r = stats.ols(df, "x", "y").first()
    assert (r.slope, r.intercept, r.r2) == (pytest.approx(-2), pytest.approx(1), pytest.approx(1))
    with pytest.raises(Exception, match="three points"):
        stats.ols(df.limit(2), "x", "y").collect()
    cases = spark.createDataFrame([(-0.09, 0.11), (-1.30, -0.70), (-0.61, -0.29)], "lo double, hi double")
    got = [x[0] for x in cases.select(stats.slope_rule(F.col("lo"), F.col("hi"), F.lit(-1.0315))).collect()]
    assert got == ["novelty_effect", "intrinsic_difficulty", "mixed"]


def test_rng_is_uniform_and_order_free(spark):
    u = [r[0] for r in spark.range(4000).repartition(7).select(rng.unit(1, "x", F.col("id")).alias("u"), "id").orderBy("id").select("u").collect()]
    assert abs(np.mean(u) - 0.5) < 0.02 and 0 < min(u) and max(u) < 1
    assert u[:5] == [r[0] for r in spark.range(5).coalesce(1).select(rng.unit(1, "x", F.col("id"))).collect()]


def test_checks(spark, tmp_path):
    with pytest.raises(checks.ContractError, match="missing \\['b'\\], unexpected \\['c'\\]"):
        checks.require_counts("n", {"a": 1, "b": 2}, {"a": 1, "c": 2})
    rows, scores = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(1, "a", 0.5)], "i int, arm string, score double")
    with pytest.raises(ValueError, match="without a score"):
        checks.scored_once(rows, scores, "i", "arm", "score")
    with pytest.raises(ValueError, match="not finite"):
        checks.scored_once(rows, scores.withColumn("score", F.lit(float("nan"))), "i", "arm", "score")
    good = {"arms": {"x": {"macro": 0.5, "by_group": {"a": 0.4, "b": 0.6}}, "r": {"macro": 0.5, "by_group": {"a": 0.5}}}, "differences": {"d": {"arm": "x", "reference": "r", "difference": 0.0}}}
    checks.check_evaluation(good)
    good["arms"]["x"]["macro"] = 0.51
    with pytest.raises(ValueError, match="mean over its groups"):
        checks.check_evaluation(good)
    with pytest.raises(ValueError, match="should be int"):
        checks.check_record({"n": True}, {"n": int})
    with pytest.raises(ValueError):
        io.write_json({"x": float("nan")}, str(tmp_path / "x.json"))


def fold_lines(k):
    return [f"AAAAAAAA{c} {a} HLA-A02:01" for c, a in zip("ACDE", ("0.500", "0.427", "0.426", "0.010"), strict=True)] + [f"CCCCCCCCCC 0.{k} BoLA-1:00901"]


def test_fold_reader(spark, tmp_path):
    names = ["c000_ba", "c001_ba"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text("\n".join(fold_lines(k)) + "\n")
    (tmp_path / "c000_el").write_text("not read\n")
    rows = io.read_folds(spark, str(tmp_path), names)
    assert rows.count() == 10 and rows.filter("Target").count() == 4
    assert rows.filter("RowType = 'artificial_negative'").count() == 2
    assert io.nine_mers(rows).count() == 8
    with pytest.raises(ValueError, match="unexpected"):
        io.read_folds(spark, str(tmp_path), names[:1])
    for bad in ("AAAA 0.5", "AAAXAAAAA 0.5 H", "AAAAAAAAA 1.5 H", "AAAAAAAAA x H", "", "AAAAAAAAA nan H"):
        (tmp_path / names[1]).write_text("\n".join([*fold_lines(1)[:2], bad, fold_lines(1)[2]]) + "\n")
        with pytest.raises(ValueError, match="c001_ba', 3"):
            io.read_folds(spark, str(tmp_path), names)


def test_csv_vectors_and_pseudo_sequences(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="fetch"):
        io.read_csv(spark, str(tmp_path / "none.csv"), hint="fetch it first")
    (tmp_path / "p.txt").write_text(f"HLA-A0201 {'A' * 34}\n\nHLA-A0201 {'C' * 34}\n")
    alleles = spark.createDataFrame([("HLA-A02:01",)], "Allele string")
    assert io.load_pseudo_sequences(spark, str(tmp_path / "p.txt"), alleles).first().sequence == "C" * 34
    expected = spark.createDataFrame([("AC",), ("CA",)], "sequence string")
    build = lambda e: models.residue_embedding(e, "sequence", {"A": [1.0], "C": [3.0]}).select("sequence", vector.mean_pool("residues").alias("vec"))
    got = io.load_or_build_vectors(spark, str(tmp_path / "v"), "m", 1, expected, build)
    assert {r.sequence: r.vec for r in got.collect()} == {"AC": [2.0], "CA": [2.0]}
    with pytest.raises(ValueError, match="missing on the left"):
        io.validate_vectors(got, spark.createDataFrame([("AC",), ("CA",), ("AA",)], "sequence string"))
