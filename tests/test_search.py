"""Segment index, global order, greedy batches and component splits against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import ordering, retrieval, sampling, splits, summary


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(seed, n, letters="abc", most=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(most))) for _ in range(n)})


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_all_pairs_within_edits(spark, k):
    a, b = texts(1, 150) + ["aaaaaaaaaaaaaaaaaaaa", "é" * 5], texts(2, 150) + ["aaaaaaaaaaaaaaaaaab", "é" * 4]
    got = retrieval.within_edits(column(spark, [*a, None, a[0]], "x"), column(spark, [*b, None], "y"), "x", "y", k)
    rows = [(r.x, r.y, r.distance) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(x, y, levenshtein(x, y)) for x in a for y in b if levenshtein(x, y) <= k}


def test_long_texts_find_each_other_by_their_pieces(spark):
    r = random.Random(3)
    base = ["".join(r.choice("acgt") for _ in range(60)) for _ in range(40)]
    edited = []
    for t in base:
        for _ in range(3):
            i = r.randrange(len(t))
            t = r.choice([t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "y" + t[i + 1 :]])
        edited.append(t)
    got = {(x.seq, x.distance) for x in retrieval.nearest_levenshtein(column(spark, edited, "seq"), column(spark, base, "seq"), "seq", 3).collect()}
    assert got == {(t, min(min(levenshtein(t, b) for b in base), 4)) for t in edited}


def test_nearest_of_one_length_at_any_radius(spark):
    q, e = texts(4, 120, most=12), texts(5, 60, most=11)
    far = lambda x: min((sum(a != b for a, b in zip(x, y, strict=True)) for y in e if len(y) == len(x)), default=retrieval.FAR)
    for radii in ((1, 3, 7), (0,), ()):
        got = {r.seq: r.distance for r in retrieval.nearest_hamming(column(spark, q, "seq"), column(spark, e, "seq"), "seq", radii).collect()}
        assert got == {x: far(x) for x in q}


def test_distances_of_blocks(monkeypatch):
    q, e = texts(11, 60) + ["é🙂" * 3, "x" * 300], texts(12, 50) + ["", "🙂é", "x" * 299 + "y"]
    want = [[levenshtein(a, b) for b in e] for a in q]
    assert retrieval.edit_distances(q, e).tolist() == want
    monkeypatch.setattr(retrieval, "CELLS", 40)
    assert retrieval.edit_distances(q, e).tolist() == want


@pytest.mark.parametrize("options", [{}, {"top_k": 3}, {"leave_out_exact": True}, {"leave_out_exact": True, "top_k": 2}, {"other_fold": "f"}, {"other_fold": "f", "top_k": 2}])
def test_nearest_positive_in_blocks(spark, options, monkeypatch):
    r = random.Random(13)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 6)))
    q = sorted({(r.choice("ghi"), word(), r.randrange(3)) for _ in range(60)} | {("none", "ab", 0), ("one", "aa", 1)})
    e = sorted({(r.choice("gh"), word(), r.randrange(3)) for _ in range(40)} | {("one", "aa", 1)})
    fold = "other_fold" in options
    queries = spark.createDataFrame(q, "g string, seq string, f int")
    entries = spark.createDataFrame(e, "g string, entry string, f int")
    entries = entries if fold else entries.select("g", "entry").distinct()
    inner = retrieval._nearest_texts
    for block in (3, 1024):
        monkeypatch.setattr(retrieval, "_nearest_texts", lambda *a, b=block: inner(*a, block=b))
        got = {(x.g, x.seq, x.f): (round(x.score, 9), x.nearest, x.has_database, x.database_size) for x in retrieval.nearest_positive(queries, entries, "g", "seq", **options).collect()}
        for g, t, f in q:
            own = {b for a, b, k in e if a == g and (not fold or k != f)}
            sims = sorted(((-(1 - levenshtein(t, b) / max(len(t), len(b))), b) for b in own if not (options.get("leave_out_exact") and b == t)))
            k = options.get("top_k", 1)
            score = 0.0 if not sims else -sum(s for s, _ in sims[:k]) / k if len(sims) >= min(k, len(own)) and len(sims) >= k else -sims[0][0] if k > len(sims) and len(sims) < len(own) else -sum(s for s, _ in sims[:k]) / min(k, len(sims))
            assert got[g, t, f] == (round(score, 9), sims[0][1] if sims else "", bool(own), len(own)), (g, t, f)


@pytest.mark.parametrize("fold", [None, "f"])
def test_nearest_positive_looks_up_texts_one_edit_apart(spark, fold, monkeypatch):
    """Both ways give the same, and less than half of the queries are left to the comparison in blocks."""
    r = random.Random(17)
    q = [(r.choice("gh"), f"{r.randrange(500):05d}"[r.randrange(2) :], r.randrange(3)) for _ in range(300)] + [("g", "", 0), ("g", "x", 1), ("h", "é🙂" * 40, 1), ("none", "1", 0)]
    e = [(r.choice("gh"), f"{r.randrange(500):05d}", r.choice([0, 1, 2, None])) for _ in range(300)] + [("g", "", 1), ("g", "y", 2), ("h", "é🙂" * 40, 0), ("h", None, 0)]
    queries = spark.createDataFrame(sorted(set(q)), "g string, seq string, f int")
    entries = spark.createDataFrame(e, "g string, entry string, f int").distinct()
    entries = entries if fold else entries.select("g", "entry").distinct()
    found = lambda: sorted(tuple(x) for x in retrieval.nearest_positive(queries, entries, "g", "seq", other_fold=fold).collect())
    want, left, inner = found(), [], retrieval._compared
    monkeypatch.setattr(retrieval, "MANY_PAIRS", 0)
    monkeypatch.setattr(retrieval, "_compared", lambda rest, *a: (left.append(rest.count()), inner(rest, *a))[1])
    assert found() == want
    assert left[0] < queries.count() / 2


def test_eligible_beyond_a_distance(spark):
    groups = ["alpha", "alpho", "alphxyz", "beta", "bexa", "gamma"]
    r = random.Random(6)
    pairs = sorted({(r.choice(groups), f"s{r.randrange(12)}") for _ in range(20)})
    df = spark.createDataFrame(pairs, "g string, seq string")
    for beyond in (0, 1, 3):
        got = {tuple(x) for x in sampling.distance_eligible(df, df, df, "g", "seq", beyond).select("g", "seq").collect()}
        targets, seqs = {g for g, _ in pairs}, {s for _, s in pairs}
        assert got == {(t, s) for t in targets for s in seqs if all(levenshtein(g, t) > beyond for g, x in pairs if x == s)}


def test_pair_guard_raises_unless_lifted(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", f"s{i}") for i in range(9)], "i long, g string, seq string")
    known, pool = sampling.context(df, "g", "seq")
    with pytest.raises(ValueError, match="exceed 5 pairs"):
        sampling.uniform(df, known, pool, "g", "seq", "i", guard=5)
    assert sampling.uniform(df, known, pool, "g", "seq", "i", guard=None).count() == 18


def test_order_by_ranges(spark):
    r = random.Random(7)
    rows = [(r.randrange(50), f"k{i}", r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, n int").repartition(6)
    got = {x.b: x.pos for x in ordering.numbered(df, "a", "b").collect()}
    assert got == {b: i for i, (_, b, _) in enumerate(sorted(rows, key=lambda x: (x[0], x[1])))}
    total, want = 0, {}
    for a, b, n in sorted(rows, key=lambda x: (-x[0], x[1])):
        total += n
        want[b] = total
    assert {x.b: x.running for x in ordering.running_sum(df, "n", F.desc("a"), F.col("b")).collect()} == want
    assert ordering.numbered(df.filter("false"), "a", "b").collect() == []


def greedy(values, budget, padding=2):
    batches, current = [], []
    for t in sorted(set(values), key=lambda x: (len(x), x)):
        if current and (len(current) + 1) * (len(t) + padding) > budget:
            batches.append(current)
            current = []
        current = [*current, t]
    return [*batches, current] if current else batches


@pytest.mark.parametrize("budget", [1, 12, 40, 100, 10_000])
def test_batches_equal_a_greedy_pass(spark, budget):
    r = random.Random(budget)
    values = ["".join(r.choice("abcdef") for _ in range(r.choice([0, 1, 2, 3, 3, 3, 7, 8, 20, 60]))) for _ in range(400)]
    got = {x.seq: x.batch for x in summary.length_batches(column(spark, [*values, None], "seq"), "seq", budget).collect()}
    want = {t: i for i, batch in enumerate(greedy(values, budget)) for t in batch}
    assert got == want
    assert summary.length_batches(column(spark, [None], "seq"), "seq", budget).collect() == []


def test_component_split_takes_whole_components(spark):
    r = random.Random(8)
    rows = [(min(int(r.expovariate(0.3)), 12), i) for i in range(400)]
    df = spark.createDataFrame(rows, "component int, i int").repartition(3)
    got = splits.component_split(df, 0.3).collect()
    sides = {}
    for x in got:
        sides.setdefault(x.component, set()).add(x.side)
    sizes = {c: sum(1 for a, _ in rows if a == c) for c in sides}
    assert len(got) == 400 and all(len(s) == 1 for s in sides.values())
    assert sides[max(sizes, key=lambda c: (sizes[c], -c))] == {"train"}
    test = sum(n for c, n in sizes.items() if sides[c] == {"test"})
    assert 120 <= test < 120 + max(sizes.values())


def test_surviving_support(spark):
    rows = [("g", "s1", 1, True, True), ("g", "s1", 0, True, False), ("g", "s2", 1, False, False), ("g", None, 0, True, True), ("h", "s1", 1, None, True), ("h", "s3", 1, True, True)]
    df = spark.createDataFrame(rows, "g string, seq string, y int, near boolean, far boolean")
    got = {(r.regime, r.g): tuple(r)[2:] for r in retrieval.surviving_support(df, "g", "seq", "y", ["near", "far"], 2).collect()}
    assert got == {
        ("near", "g"): (4, 3, 2, 1, 1, 2, True, True), ("far", "g"): (4, 2, 2, 1, 1, 1, True, True),
        ("near", "h"): (2, 1, 2, 1, 1, 0, False, True), ("far", "h"): (2, 2, 2, 2, 2, 0, False, True),
    }
    assert not any(r.below for r in retrieval.surviving_support(df, "g", "seq", "y", ["near"], 1).filter("g = 'g'").collect())
    assert retrieval.surviving_support(df.limit(0), "g", "seq", "y", ["near"]).count() == 0


def test_training_distance_in_blocks(spark):
    r = random.Random(8)
    drawn = lambda n: [("".join(r.choice("abcd") for _ in range(r.randrange(0, 9))),) for _ in range(n)]
    q, e = drawn(60) + [(None,)], drawn(90) + [(None,)]
    got = {x.seq: x.distance for x in retrieval.nearest_training_distance(spark.createDataFrame(q, "seq string"), spark.createDataFrame(e, "seq string"), "seq").collect()}
    assert set(got) == {t for (t,) in q} and got[None] is None
    for (t,) in q[:-1]:
        assert got[t] == pytest.approx(min(levenshtein(t, x) / max(len(t), len(x), 1) for (x,) in e[:-1])), t
    none = retrieval.nearest_training_distance(spark.createDataFrame(q, "seq string"), spark.createDataFrame([], "seq string"), "seq").collect()
    assert {x.seq for x in none} == set(got) and not any(x.distance is not None for x in none)


def test_codes_and_derangement_skip_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", None, "a", "c", "b"])], "i int, v string")
    assert {(x.i, x.code) for x in text.label_encode(df, "v").collect()} == {(0, 1), (2, 0), (3, 2), (4, 1)}
    assert {(x.i, x.shifted) for x in text.derangement(df, "i", "v").collect()} == {(0, "c"), (2, "b"), (3, "a"), (4, "c")}
