"""Every registered query against its SQL, and the entry point."""

import math

import duckdb
import pytest

from rankloom.plans import catalog, catalog_rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


QUICK = ["E03_auc01_by_group", "E06_weighted_auc01", "E10_score_diagnostics", "E07_bootstrap_groups_macro", "R02_nearest_positive_edit", "R05_nearest_topk", "P07_joint_novelty", "M01_pwm_scores", "W04_group_rank_norm"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)


WHOLE = ["N03_negatives_shuffle", "N04_negatives_matched", "N05_negatives_hard", "N06_negatives_uniform", "N10_negative_summary", "C09_distance_eligible", "N11_evaluation_set", "E17_corr_bootstrap", "R09_nearest_training_distance", "F11_derangement", "F12_label_encode", "D16_surviving_support", "E33_wide_by_arm", "E33_wide_flags"]


@pytest.mark.parametrize("name", [n for n in WHOLE])
def test_whole_table_query_equals_sql(spark, tiny, duck, name):
    test_query_equals_sql(spark, tiny, duck, name)


def test_whole_table_queries_leave_no_row_out(spark, tiny, duck):
    n, groups = duck.sql("select count(*), count(distinct c_nationkey) from customer").fetchall()[0]
    for name in ("shuffle", "matched", "hard"):
        number = {"shuffle": 3, "matched": 4, "hard": 5}[name]
        rows = catalog.QUERIES[f"N0{number}_negatives_{name}"](spark, tiny).collect()
        assert len(rows) == len(set(rows)) == 3 * n and len({r.source_row_id for r in rows}) == n
    assert catalog.QUERIES["N06_negatives_uniform"](spark, tiny).count() == n * (groups - 1)


def test_components_of_all_edges(spark, tiny, duck):
    edges = duck.sql("select l_suppkey, l_orderkey from lineitem").fetchall()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(f"l|{a}"), find(f"r|{b}")
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    assert {r.node: r.component for r in catalog.QUERIES["P01_component_labels"](spark, tiny).collect()} == want
    rows = catalog.QUERIES["P02_component_split"](spark, tiny).collect()
    assert sorted((r.l_suppkey, r.l_orderkey) for r in rows) == sorted(edges)
    assert all(r.component == want[f"l|{r.l_suppkey}"] for r in rows) and len({(r.component, r.side) for r in rows}) == len(set(want.values()))


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_rows.__name__])
def test_row_query_equals_sql(spark, tiny, duck, name):
    test_query_equals_sql(spark, tiny, duck, name)
