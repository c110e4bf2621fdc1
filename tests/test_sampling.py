"""Successive draws against a plain sequential sampler with the same random numbers, and against the chances it should have."""

import collections
import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import rng
from rankloom.operators import retrieval, sampling

SCHEMA = "i long, g string, seq string, label int"


def digest(*keys):
    return hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()


def place(n, *keys):
    return min(int(int(digest(*keys)[:13], 16) / 2**52 * n), n - 1)


def unit(*keys):
    return (int(digest(*keys)[:8], 16) + 0.5) / 2**32


def plain(rows, strategy, k, seed):
    """{row: groups} by drawing one after the other."""
    known, weight = {(g, s) for _, g, s, _ in rows}, collections.Counter(g for _, g, _, _ in rows)
    places = sorted(weight) if strategy == "shuffle" else [g for _, g, _, _ in sorted(rows)]
    out = {}
    for i, _, s, _ in rows:
        got = []
        for t in range(2 * (k + 1) + 6):
            g = places[place(len(places), seed, strategy, i, t)]
            if len(got) < k and g not in got and (g, s) not in known:
                got.append(g)
        u = {g: unit(seed, f"{strategy} rest", i, g) for g in weight}
        key = {g: -u[g] if strategy == "shuffle" else math.log(weight[g]) - math.log(-math.log(u[g])) for g in weight}
        rest = sorted((g for g in weight if g not in got and (g, s) not in known), key=lambda g: (-key[g], g))
        out[i] = set(got) | set(rest[: k - len(got)])
    return out


@pytest.mark.parametrize("strategy", ["shuffle", "matched"])
@pytest.mark.parametrize("k", [1, 4, 9])
def test_draws_equal_a_sequential_sampler(spark, strategy, k):
    """Sequences with many positives, one group with most rows, repeated pairs, and a pool smaller than some rows ask for."""
    r = random.Random(k)
    rows = [(i, "hot" if r.random() < 0.6 else f"g{r.randrange(8)}", f"s{int(r.random() ** 3 * 30)}", 1) for i in range(150)]
    out = sampling.sample(spark.createDataFrame(rows, SCHEMA).repartition(5), "g", "seq", "i", strategy, float(k), seed=7)
    got = collections.defaultdict(list)
    for x in out.collect():
        got[x.source_row_id].append(x.g)
    want = plain(rows, strategy, k, 7)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {i: set(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert any(len(v) < k for v in want.values()) or k == 1


@pytest.mark.parametrize("strategy,crowded", [("shuffle", False), ("matched", False), ("matched", True)])
def test_chances_of_two_draws(spark, strategy, crowded):
    """Pairs of groups come as often as by drawing without replacement, also where a row's positives hold nearly all of the pool."""
    weights = {g: n * (1 if crowded else 200) for g, n in {"a": 1, "b": 2, "c": 4, "d": 8}.items()} | {"own": 3000}
    rows = [(g, f"{g}{j}") for g, n in weights.items() for j in range(n)]
    rows = [(i, g, s, 1) for i, (g, s) in enumerate(rows)]
    out = sampling.sample(spark.createDataFrame(rows, SCHEMA), "g", "seq", "i", strategy, 2.0, seed=1)
    own = spark.createDataFrame(rows, SCHEMA).filter("g = 'own'").select(F.col("i").alias("source_row_id"))
    pairs = collections.Counter(tuple(sorted(x.gs)) for x in out.join(own, "source_row_id").groupBy("source_row_id").agg(F.collect_list("g").alias("gs")).collect())
    w = {g: (1 if strategy == "shuffle" else weights[g]) for g in "abcd"}
    total, n = sum(w.values()), sum(pairs.values())
    assert n == 3000
    chance = {(a, b): w[a] / total * w[b] / (total - w[a]) + w[b] / total * w[a] / (total - w[b]) for a, b in itertools.combinations("abcd", 2)}
    chi = sum((pairs[p] - n * c) ** 2 / (n * c) for p, c in chance.items())
    assert chi < 20.5, (pairs, chance)  # 5 degrees of freedom: exceeded once in 1,000 seeds


def test_nearest_draws_equal_a_full_ranking(spark):
    r = random.Random(3)
    groups = sorted({"".join(r.choice("abc") for _ in range(r.randrange(2, 6))) for _ in range(25)})
    rows = [(i, r.choice(groups), f"s{int(r.random() ** 4 * 25)}", 1) for i in range(120)]
    out = sampling.sample(spark.createDataFrame(rows, SCHEMA), "g", "seq", "i", "hard", 3.0)
    got = collections.defaultdict(set)
    for x in out.collect():
        got[x.source_row_id].add(x.g)
    names, known = {g for _, g, _, _ in rows}, {(g, s) for _, g, s, _ in rows}
    distance = {(x.name, x.other): x.distance for x in retrieval.neighbour_ranks(spark.createDataFrame([(g,) for g in names], "n string"), "n", 10**6).collect()}
    for i, g, s, _ in rows:
        free = sorted((o for o in names if o != g and (o, s) not in known), key=lambda o: (distance[g, o], o))
        assert got[i] == set(free[:3]), (i, g, s)


def test_nulls_and_an_empty_table(spark):
    rows = [(0, "a", "s", 1), (1, None, "s", 1), (2, "b", None, 1), (3, "c", "t", 1)]
    for strategy in ("shuffle", "matched", "hard"):
        out = sampling.sample(spark.createDataFrame(rows, SCHEMA), "g", "seq", "i", strategy, 2.0).collect()
        assert {x.g for x in out} <= {"a", "b", "c"} and {0, 3} <= {x.source_row_id for x in out}
        assert {x.g for x in out if x.source_row_id == 0} == {"b", "c"}
        assert sampling.sample(spark.createDataFrame([], SCHEMA), "g", "seq", "i", strategy, 2.0).count() == 0


def test_positions_are_even_beyond_32_bits(spark):
    n = 10**12
    got = [x.p for x in spark.range(2000).select(rng.position(n, 3, "p", F.col("id")).alias("p")).collect()]
    assert got == [place(n, 3, "p", i) for i in range(2000)] and 0.45 * n < sum(got) / 2000 < 0.55 * n
    assert len({p % 1000 for p in got}) > 800
