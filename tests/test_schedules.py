"""Schedules of held-out keys with diagnostics, and the ragged residue store."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vector
from rankloom.operators import checks, splits, stats
from rankloom.plans import catalog
from rankloom.sources import io
from tests.test_catalog import duck, test_query_equals_sql  # noqa: F401


def rows(seed=0, n=300):
    r = random.Random(seed)
    return [(i, f"k{r.randrange(6)}", f"v{r.randrange(40)}") for i in range(n)]


CODES = {"k0": "aaaa", "k1": "aaab", "k2": "aabb", "k3": "bbbb", "k4": "bbba", "k5": "cccc"}


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(rows(), "i long, k string, v string").repartition(3)
    held = spark.createDataFrame([("p", "k0"), ("p", "k3"), ("q", "k5")], "partition_id string, k string")
    return df, held, spark.createDataFrame(list(CODES.items()), "k string, code string")


@pytest.mark.parametrize("shared", [False, True])
def test_partitions_of_several_keys(tables, shared):
    df, held, codes = tables
    parts = {"p": {"k0", "k3"}, "q": {"k5"}}
    got = {(x.partition_id, x.i): x.side for x in splits.schedule(df, held, "k", "v" if shared else None).collect()}
    want = {}
    for p, keys in parts.items():
        gone = {v for _, k, v in rows() if k in keys} if shared else set()
        want |= {(p, i): "test" if k in keys else "train" for i, k, v in rows() if k in keys or v not in gone}
    assert got == want
    found = {x.partition_id: x for x in splits.schedule_diagnostics(df, held, "k", "v", codes, shared).collect()}
    for p, keys in parts.items():
        own = {i: (k, v) for i, k, v in rows() if (p, i) in want}
        test, train = {v for i, (k, v) in own.items() if want[p, i] == "test"}, {v for i, (k, v) in own.items() if want[p, i] == "train"}
        far = lambda a, b: sum(x != y for x, y in zip(CODES[a], CODES[b], strict=True))
        near = min(((far(a, b), b) for a in keys for b in {own[i][0] for i in own if want[p, i] == "train"}), default=(None, None))
        x = found[p]
        assert (x.n_keys, x.n_values, x.n_shared, x.distance, x.source) == (len(keys), len(test), len(test & train), *near)
        assert (x.n_test, x.n_train) == (sum(s == "test" for k, s in want.items() if k[0] == p), sum(s == "train" for k, s in want.items() if k[0] == p))
        assert x.n_shared == 0 or not shared


def test_bad_schedules_raise(spark, tables):
    df, held, _ = tables
    with pytest.raises(checks.ContractError, match="without rows"):
        splits.schedule(df, held.unionByName(spark.createDataFrame([("q", "none")], held.schema)), "k")
    with pytest.raises(checks.ContractError, match="held out twice"):
        splits.schedule(df, held.unionByName(spark.createDataFrame([("q", "k0")], held.schema)), "k")


def test_orders_of_the_three_schedules(spark, tables):
    df, _, codes = tables
    first = {}
    for i, k, _ in rows():
        first.setdefault(k, i)
    got = [x.k for x in splits.key_schedule(df, "k", "i").orderBy("position").collect()]
    assert got == sorted(first, key=first.get) and got != sorted(first)
    assert [x.k for x in splits.key_schedule(df, "k").orderBy("position").collect()] == sorted(first)
    clusters = splits.complete_linkage(codes, "k", "code")
    held = splits.cluster_schedule(clusters, "k").collect()
    assert {x.k for x in held} == set(CODES) and len({(x.position, x.partition_id) for x in held}) == len({x.position for x in held})
    for x in held:
        assert x.partition_id == "+".join(sorted(y.k for y in held if y.position == x.position))


def test_floor_and_drift_raise(spark):
    by = spark.createDataFrame([("a", 0.7), ("b", 0.55)], "arm string, v double")
    with pytest.raises(checks.ContractError, match="under 0.6"):
        stats.require_floor(by, "arm", "v")
    stats.require_floor(by, "arm", "v", 0.5)
    with pytest.raises(ValueError, match="more than"):
        stats.require_drift(0.1, 0.3)


def test_ragged_store(spark, tmp_path):
    r = random.Random(1)
    data = [("m", 3 + k % 2, f"s{i:04d}", [[float(r.randrange(-9, 9)) for _ in range(5)] for _ in range(1 + r.randrange(7))]) for i in range(600) for k in range(2)]
    df = spark.createDataFrame(data, "model string, layer int, sequence string, residues array<array<float>>").repartition(3)
    path = f"file://{tmp_path}/store"
    io.write_residues(df, path, rows_a_group=50)
    want = {s: v for m, layer, s, v in data if layer == 3}
    assert {x.sequence: x.residues for x in io.read_residues(spark, path, "m", 3).collect()} == want
    some = io.read_residues(spark, path, "m", 3, ["s0007", "s0300", "s0007"])
    assert {x.sequence: x.residues for x in some.collect()} == {s: want[s] for s in ("s0007", "s0300")}
    plan = some._jdf.queryExecution().toString()
    assert "In(sequence" in plan and "PartitionFilters" in plan  # skips files of other layers and row groups of other sequences
    for f in (tmp_path / "store" / "model=m" / "layer=3").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        ends = [(meta.row_group(k).column(0).statistics.min, meta.row_group(k).column(0).statistics.max) for k in range(meta.num_row_groups)]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False)) and all(meta.row_group(k).num_rows <= 50 for k in range(meta.num_row_groups))
    pooled = {x.sequence: x.m for x in io.read_residues(spark, path, "m", 3).select("sequence", vector.mean_pool("residues").alias("m")).collect()}
    for s, v in want.items():
        assert pooled[s] == pytest.approx([sum(c) / len(v) for c in zip(*v, strict=True)], rel=1e-6)
    joined = io.read_residues(spark, path, "m", 4, spark.createDataFrame([("s0001",), ("s0002",)], "sequence string"))
    assert joined.count() == 2
    with pytest.raises(io.ContractError, match="holds no residues"):
        io.read_residues(spark, path, "m", 9)
    with pytest.raises(checks.ContractError, match="without residues"):
        io.read_residues(spark, path, "m", 3, ["nobody"])
    with pytest.raises(checks.ContractError, match="different width"):
        io.write_residues(spark.createDataFrame([("m", 1, "s", [[1.0], [1.0, 2.0]])], df.schema), f"{path}2")


def test_every_rule_of_the_preflight(spark, tables):
    r = random.Random(4)
    df = spark.createDataFrame([(i, k, f"w{k}{i % 5}", r.randrange(2)) for i, k, _ in rows(n=240)], "i long, k string, v string, y int")
    held, codes = tables[1], tables[2]
    expected = held.select("k")
    parts = splits.schedule(df, held, "k")
    ask = lambda parts=parts, held=held, expected=expected, codes=codes, shared="v": {(x.rule, x.partition_id, x.key) for x in splits.preflight_faults(parts, held, expected, codes, "k", "y", 4, shared).collect()}
    assert ask() == set()
    assert splits.preflight_schedule(parts, held, expected, codes, "k", "y", 4, "v").count() == parts.count()
    add = lambda df, *new: df.unionByName(spark.createDataFrame(list(new), df.schema))
    assert ("no partitions", None, None) in ask(parts.filter("false"))
    assert ask(expected=expected.filter("k <> 'k0'")) == {("held-out key is not expected", "p", "k0")}
    assert ask(expected=add(expected, ("k1",))) == {("expected key is not held out", None, "k1")}
    assert ("key held out twice", None, "k0") in ask(held=add(held, ("q", "k0")))
    assert {("test rows of another key", "p", "k0"), ("held-out key in training", "p", "k1")} <= ask(held=held.replace("k0", "k1", "k"))
    assert ("held-out key without test rows", "q", "none") in ask(held=add(held, ("q", "none")))
    assert ask(codes=codes.filter("k <> 'k2'")) == {("key without a code", p, "k2") for p in "pq"}
    assert ask(codes=add(codes, ("k2", "zzzz"))) == {("key with several codes", None, "k2")}
    assert ask(codes=codes.replace("aabb", "aab", "code")) == {("code of another length", None, "k2")}
    assert ask(codes=codes.withColumn("code", F.lit("aaaa"))) == {("codes that can't be exchanged", None, None)}
    one = parts.withColumn("y", F.when((F.col("partition_id") == "p") & (F.col("side") == "train"), 1).otherwise(F.col("y")))
    assert ask(one) == {("training of one class", "p", None), ("no source of both classes", "p", None)}
    assert ask(parts.filter("k <> 'k3' or side = 'train' or y = 1")) == {("test key of one class", "p", "k3")}
    apart = parts.filter("side = 'test' or (k in ('k1', 'k2') and y = 0) or (k = 'k4' and y = 1)")
    assert {x for x in ask(apart)} == {("no source of both classes", "p", None), ("no source of both classes", "q", None)}
    few = parts.filter("k = 'k2' and y = 1 and side = 'train'").agg(F.min("i")).first()[0]
    assert ask(parts.filter(f"k <> 'k2' or y = 0 or i = {few}")) == {("a single training row of a class", p, "k2") for p in "pq"}
    assert ask(parts.withColumn("v", F.lit("same"))) == {("v on both sides", p, None) for p in "pq"}
    with pytest.raises(checks.ContractError, match="not expected"):
        splits.preflight_schedule(parts, held, expected.filter("k <> 'k0'"), codes, "k", "y", 4)


def test_guards_that_must_raise(spark):
    df = spark.createDataFrame([(f, g, y) for f in (0, 1) for g in "ab" for y in (0, 1)], "f int, g string, y int")
    assert checks.require_class_presence(df, "f", "g", "y").count() == 4
    with pytest.raises(checks.ContractError, match="without both classes"):
        checks.require_class_presence(df.filter("not (f = 0 and g = 'a' and y = 1)"), "f", "g", "y")
    supported = spark.createDataFrame([("a",)], "g string")
    assert io.external_predictions(df, supported, "g", "y", 1, 0.5).columns == ["f", "g", "y", "score"]
    for least in ((2, 0.0), (0, 0.6)):
        with pytest.raises(checks.ContractError, match="too few"):
            io.external_predictions(df, supported, "g", "y", *least)
    template = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "id int, place int")
    scores = spark.createDataFrame([(1, -4.0), (2, 0.5), (3, 9.0)], "id int, score double")
    assert [tuple(x) for x in io.submission(template, scores, ["id"], "id", order="place").collect()] == [(3, 1.0), (1, 0.0), (2, 0.5)]
    with pytest.raises(checks.ContractError, match="without a score"):
        io.submission(template, scores.filter("id > 1"), ["id"], "id")


NEW = ["R07_projected_nearest", "E18_correlation_difference", "C07_nearest_levenshtein", "C08_nearest_hamming", "F07_feature_width", "N08_strategies", "E15_kernels_agree", "M14_record_check", "P08_schedule_order", "P10_schedule_diagnostics", "P10_joint_diagnostics", "A10_ragged_store", "P09_preflight_faults", "W01_tie_block_starts", "D15_score_distinctness", "W05_neighbour_ranks", "S02_top_k_mean", "S07_shuffled", "E32_uplift", "M02_nearest_matrix_transfer"]


@pytest.mark.parametrize("name", NEW)
def test_new_queries_equal_sql(spark, tiny, duck, name):  # noqa: F811
    assert name in catalog.QUERIES
    test_query_equals_sql(spark, tiny, duck, name)
