"""Leakage-free splits: graph components, strata, held-out keys, and clusters of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import rng, text
from rankloom.operators import ordering
from rankloom.operators.checks import require_columns, require_none
from rankloom.sources.tables import checkpointed, drop


def component_labels(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) over the two-sided graph; nodes are prefixed l| and r|, a component is named by its smallest node.

    Every node points to a smaller one of its component. In a round a node, and the node it points to, take the smallest
    second pointer among the node's neighbours, and each skips one pointer ahead, so rounds grow with the logarithm of the
    graph. Every round is a written table, which goes as soon as the next one is there.
    """
    e = edges.select(F.concat(F.lit("l|"), F.col(left).cast("string")).alias("a"), F.concat(F.lit("r|"), F.col(right).cast("string")).alias("b")).dropna().distinct()
    both = checkpointed(e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"))))

    def two_ahead(points: DataFrame) -> DataFrame:
        return checkpointed(points.join(points.select(F.col("node").alias("next"), F.col("next").alias("after")), "next"))

    nodes = two_ahead(both.groupBy("node").agg(F.least("node", F.min("other")).alias("next")))
    while True:
        near = both.join(nodes.select(F.col("node").alias("other"), F.col("after").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        seen = nodes.join(near, "node")
        pulled = seen.groupBy(F.col("next").alias("node")).agg(F.min("theirs").alias("pull"))
        before, nodes = nodes, two_ahead(seen.join(pulled, "node", "left").select("node", F.least("next", "after", "theirs", "pull").alias("next"), F.col("after").alias("was")))
        drop(before)
        if nodes.filter("was <> after or next <> after").isEmpty():
            drop(both)
            return nodes.select("node", F.col("after").alias("component"))


def row_components(rows: DataFrame, left: str, right: str) -> DataFrame:
    """`rows` with the component of each row."""
    labels = component_labels(rows, left, right).select(F.col("node").alias("_node"), "component")
    return rows.withColumn("_node", F.concat(F.lit("l|"), F.col(left).cast("string"))).join(labels, "_node", "left").drop("_node")


def component_split(labelled: DataFrame, fraction: float, seed: int = 0, component: str = "component") -> DataFrame:
    """`labelled` with side: the largest component trains; others, in random order, go to test until it has the fraction of rows."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    sizes = checkpointed(labelled.groupBy(component).agg(F.count(F.lit(1)).alias("n")))
    whole = sizes.agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), F.col(component).alias("c"))).alias("big")).first()
    if whole.rows is None:
        return labelled.withColumn("side", F.lit("train"))
    others = sizes.filter(F.col(component) != whole.big.c).withColumn("_u", rng.unit(seed, "component", F.col(component)))
    placed = ordering.running_sum(others, "n", F.col("_u"), F.col(component), out="_upto")
    test = placed.filter(F.col("_upto") - F.col("n") < whole.rows * fraction).select(component, F.lit(True).alias("_test"))
    return labelled.join(test, component, "left").withColumn("side", F.when(F.coalesce("_test", F.lit(False)), "test").otherwise("train")).drop("_test")


def stratified_split(df: DataFrame, strata: list[str], row_id: str, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """`df` with side `validation` for round(fraction * n) random rows of each stratum, else `fit`."""
    w = Window.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(rng.unit(seed, "strata", F.col(row_id)), row_id))
    want = F.round(F.count(F.lit(1)).over(w) * fraction)
    return df.withColumn("side", F.when(rank <= want, "validation").otherwise("fit"))


def fold_sides(df: DataFrame, fold: str) -> DataFrame:
    """Every row once for each fold, as `test` of its own and `train` of the others."""
    folds = df.select(F.col(fold).alias("partition_id")).distinct()
    return df.join(F.broadcast(folds)).withColumn("side", F.when(F.col(fold) == F.col("partition_id"), "test").otherwise("train"))


def holdout(df: DataFrame, targets: DataFrame, key: str, shared: str | None = None) -> DataFrame:
    """Every row by partition_id (a held-out key) and side; with `shared`, training rows that share its value with the test side go."""
    t = targets.select(F.col(key).alias("partition_id")).distinct()
    require_none(t.join(df, t["partition_id"] == df[key], "left_anti"), "held-out keys without rows")
    sided = df.join(F.broadcast(t)).withColumn("side", F.when(F.col(key) == F.col("partition_id"), "test").otherwise("train"))
    if not shared:
        return sided
    held = df.select(F.col(key).alias("partition_id"), shared).distinct().join(F.broadcast(t), "partition_id").withColumn("_held", F.lit(True))
    return sided.join(held, ["partition_id", shared], "left").filter("side = 'test' or _held is null").drop("_held")


def holdout_accounting(df: DataFrame, targets: DataFrame, key: str, shared: str) -> DataFrame:
    """Training rows by partition before and after rows sharing a value with the test side have gone."""
    before = holdout(df, targets, key).filter("side = 'train'").groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows_before"))
    after = holdout(df, targets, key, shared).filter("side = 'train'").groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows_after"))
    joined = before.join(after, "partition_id", "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)).cast("long"))
    return joined.withColumn("rows_deleted", F.col("rows_before") - F.col("rows_after"))


def overlap(partitions: DataFrame, value: str) -> DataFrame:
    """(partition_id, n_test, n_shared, fraction): distinct test values that occur in training too."""
    per = partitions.groupBy("partition_id", value).agg(F.bool_or(F.col("side") == "test").alias("t"), F.bool_or(F.col("side") == "train").alias("r"))
    counts = per.filter("t").groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_test"), F.count_if("r").alias("n_shared"))
    return counts.withColumn("fraction", F.col("n_shared").cast("double") / F.col("n_test"))


def schedule_violations(partitions: DataFrame, key: str, shared: str | None, label: str) -> DataFrame:
    """(rule, partition_id) of every broken rule of a schedule: leaks, empty sides, one class only."""
    p = partitions.withColumn("_y", F.col(label).cast("int"))
    by = p.groupBy("partition_id", "side").agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi"))
    sides = by.groupBy("partition_id").agg(F.count_if(F.col("side") == "test").alias("t"), F.count_if(F.col("side") == "train").alias("r"))
    rules = [
        sides.filter("t = 0").select(F.lit("no test rows").alias("rule"), "partition_id"),
        sides.filter("r = 0").select(F.lit("no training rows"), "partition_id"),
        by.filter("lo = hi").select(F.concat(F.lit("one class in "), "side"), "partition_id"),
        p.filter((F.col("side") == "train") & (F.col(key) == F.col("partition_id"))).select(F.lit("held-out key in training"), "partition_id").distinct(),
    ]
    if shared:
        rules.append(overlap(partitions, shared).filter("n_shared > 0").select(F.lit(f"{shared} in both sides"), "partition_id"))
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


def preflight(partitions: DataFrame, key: str, shared: str | None, label: str) -> DataFrame:
    """The schedule itself, if it breaks no rule."""
    require_none(schedule_violations(partitions, key, shared, label), "schedule")
    return partitions


def schedule(df: DataFrame, held: DataFrame, key: str, shared: str | None = None) -> DataFrame:
    """Every row by partition_id and side, where `held` (partition_id, key) lists one or several held-out keys a partition.

    With `shared`, training rows that share its value with the partition's test side go. A held-out key without rows, or one
    that two partitions hold, is an error.
    """
    h = held.select("partition_id", key).distinct()
    require_none(h.join(df, key, "left_anti"), "held-out keys without rows")
    require_none(h.groupBy(key).count().filter("count > 1").select(key), "keys held out twice")
    ids = h.select("partition_id").distinct()
    marked = df.crossJoin(ids).join(h.withColumn("_mine", F.lit(True)), ["partition_id", key], "left")  # each row once a partition
    sided = marked.withColumn("side", F.when(F.col("_mine"), "test").otherwise("train")).drop("_mine")
    if not shared:
        return sided
    gone = df.join(h, key).select("partition_id", shared).distinct().withColumn("_gone", F.lit(True))
    return sided.join(gone, ["partition_id", shared], "left").filter("side = 'test' or _gone is null").drop("_gone")


def preflight_faults(parts: DataFrame, held: DataFrame, expected: DataFrame, codes: DataFrame, key: str, label: str, length: int, shared: str | None = None) -> DataFrame:
    """(rule, partition_id, key) of all that is wrong with a schedule before anything is fitted on it; empty if nothing is.

    parts: rows by partition_id and side; held: (partition_id, key); expected: the keys to be held out; codes: (key, code), a
    code of `length` for each key. partition_id or key is null where a rule isn't about one. Rules: there are partitions;
    held-out and expected keys agree; no key is held out twice; test rows are those of the held-out keys; no held-out key is
    in training; with `shared`, none of its values is on both sides; every key has one code of the right length; codes
    differ, so that they can be exchanged; training has both classes, and so have the test rows of each held-out key; some
    training key has both classes, so that there is a source; every training key and class can be cut in fit and validation.
    """
    require_columns(parts, "partition_id", "side", key, label, *([shared] if shared else []))
    require_columns(held, "partition_id", key)
    y = F.col(label).cast("int")
    by = checkpointed(parts.groupBy("partition_id", "side", key).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n")))
    train, test = by.filter("side = 'train'"), by.filter("side = 'test'")
    mine, wanted = held.select("partition_id", key).distinct(), expected.select(key).distinct()
    none = F.lit(None).cast("string")
    named = lambda df, rule, partition=None, name=None: df.select(F.lit(rule).alias("rule"), (F.col(partition).cast("string") if partition else none).alias("partition_id"), (F.col(name).cast("string") if name else none).alias("key"))
    code = codes.groupBy(key).agg(F.countDistinct("code").alias("kinds"), F.max("code").alias("code"))
    every = by.select("partition_id", key).distinct().join(code, key, "left")
    sides = by.groupBy("partition_id").agg(*(F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "test") for c in ("p", "n")), F.count_if((F.col("side") == "train") & (F.col("p") > 0) & (F.col("n") > 0)).alias("sources"))
    one = F.lit(1).alias("one")
    faults = [
        named(parts.sparkSession.range(1).join(by.limit(1), how="left").filter("partition_id is null"), "no partitions"),
        named(mine.join(wanted, key, "left_anti"), "held-out key is not expected", "partition_id", key),
        named(wanted.join(mine, key, "left_anti"), "expected key is not held out", None, key),
        named(mine.groupBy(key).count().filter("count > 1"), "key held out twice", None, key),
        named(test.join(mine, ["partition_id", key], "left_anti"), "test rows of another key", "partition_id", key),
        named(mine.join(test, ["partition_id", key], "left_anti"), "held-out key without test rows", "partition_id", key),
        named(train.join(mine, ["partition_id", key], "left_semi"), "held-out key in training", "partition_id", key),
        named(every.filter("code is null"), "key without a code", "partition_id", key),
        named(code.filter("kinds > 1"), "key with several codes", None, key),
        named(code.filter(F.length("code") != length), "code of another length", None, key),
        named(codes.agg(F.countDistinct("code").alias("k"), one).filter("k < 2"), "codes that can't be exchanged"),
        named(sides.filter("coalesce(train_p, 0) = 0 or coalesce(train_n, 0) = 0"), "training of one class", "partition_id"),
        named(test.join(mine, ["partition_id", key], "left_semi").filter("p = 0 or n = 0"), "test key of one class", "partition_id", key),
        named(sides.filter("sources = 0"), "no source of both classes", "partition_id"),
        named(train.filter("p = 1 or n = 1"), "a single training row of a class", "partition_id", key),
    ]
    if shared:
        faults.append(named(overlap(parts, shared).filter("n_shared > 0"), f"{shared} on both sides", "partition_id"))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()


def preflight_schedule(parts: DataFrame, held: DataFrame, expected: DataFrame, codes: DataFrame, key: str, label: str, length: int, shared: str | None = None) -> DataFrame:
    """The schedule's rows, if preflight_faults() finds nothing; else an error that lists what it found."""
    require_none(preflight_faults(parts, held, expected, codes, key, label, length, shared), "schedule")
    return parts


def key_schedule(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(position, partition_id, key): one key a partition, by first appearance in `order`, or sorted by key."""
    first = df.groupBy(key).agg((F.min(order) if order else F.min(key)).alias("_first"))
    placed = ordering.numbered(first, "_first", key, out="position")
    return placed.select("position", F.col(key).cast("string").alias("partition_id"), key)


def cluster_schedule(clusters: DataFrame, key: str) -> DataFrame:
    """(position, partition_id, key): one partition a cluster of complete_linkage(), in its order, named by its sorted members."""
    named = clusters.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list(F.col("name").cast("string"))), "+").alias("partition_id"))
    return clusters.join(named, "cluster").select(F.col("cluster").cast("long").alias("position"), "partition_id", F.col("name").alias(key))


def schedule_diagnostics(df: DataFrame, held: DataFrame, key: str, value: str, codes: DataFrame, shared: bool = False) -> DataFrame:
    """(partition_id, n_keys, n_test, n_train, n_values, n_shared, fraction, distance, source) of every partition.

    n_values and n_shared count the distinct test values and those in training too; distance is the smallest Hamming distance
    between the code of a held-out key and that of a training key, source the training key of it (ties: the smaller).
    `shared` deletes training rows with values of the test side first, as in schedule().
    """
    rows = schedule(df, held, key, value if shared else None)
    counts = rows.groupBy("partition_id").agg(F.count_if(F.col("side") == "test").alias("n_test"), F.count_if(F.col("side") == "train").alias("n_train"))
    keys = held.groupBy("partition_id").agg(F.countDistinct(key).alias("n_keys"))
    over = overlap(rows, value).select("partition_id", F.col("n_test").alias("n_values"), "n_shared", "fraction")
    mine = held.select("partition_id", key).distinct().join(codes, key).select("partition_id", F.col("code").alias("_a"))
    trained = rows.filter("side = 'train'").select("partition_id", key).distinct().join(codes, key).select("partition_id", F.col(key).alias("source"), "code")
    pairs = mine.join(trained, "partition_id").select("partition_id", F.struct(text.hamming(F.col("_a"), F.col("code")).alias("d"), "source").alias("s"))  # keys, not rows
    near = pairs.groupBy("partition_id").agg(F.min("s").alias("s")).select("partition_id", F.col("s.d").alias("distance"), "s.source")
    return keys.join(counts, "partition_id").join(over, "partition_id", "left").join(near, "partition_id", "left").select("partition_id", "n_keys", "n_test", "n_train", "n_values", "n_shared", "fraction", "distance", "source")


def complete_linkage(sequences: DataFrame, name: str, sequence: str, singletons: int = 1) -> DataFrame:
    """(name, cluster, cut): complete-linkage clusters by Hamming distance at the first cut that leaves few singletons.

    A cut at height h joins what the dendrogram merges at h or below. Distances are computed by Spark; the dendrogram is
    made in one task of quadratic memory, so the names must be few (at most 5,000).
    """
    from rankloom.operators.retrieval import bounded

    s = bounded(sequences.select(F.col(name).alias("x"), F.col(sequence).alias("sx")), 5000)
    pairs = s.join(F.broadcast(s.select(F.col("x").alias("y"), F.col("sx").alias("sy")))).filter("x <= y").select("x", "y", text.hamming(F.col("sx"), F.col("sy")).alias("d"), F.length("sx").alias("len"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["x"]) | set(pdf["y"]))
        number = {n: i for i, n in enumerate(names)}
        far = np.zeros((len(names), len(names)))
        i, j = pdf["x"].map(number).to_numpy(), pdf["y"].map(number).to_numpy()
        far[i, j] = far[j, i] = pdf["d"].to_numpy()
        member = _cut(dendrogram(far), len(names), int(pdf["len"].max()), singletons)
        return pd.DataFrame([(n, member[0][k], member[1]) for k, n in enumerate(names)], columns=["name", "cluster", "cut"])

    return pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(cluster, "name string, cluster int, cut int")


def dendrogram(far: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b): merges of clusters named by their smallest member, nearest first, ties by names.

    Lance and Williams' update for complete linkage: the merged row is the larger of the two, element by element.
    """
    d = far.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    upper = np.triu(np.ones_like(d, bool), 1)
    out = []
    for _ in range(len(d) - 1):
        at = int(np.argmin(np.where(upper, d, np.inf)))  # the first of equals in row-major order: smallest a, then smallest b
        a, b = divmod(at, len(d))
        out.append((float(d[a, b]), a, b))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
    return out


def _cut(merges: list[tuple[float, int, int]], n: int, highest: int, singletons: int) -> tuple[list[int], int]:
    """Cluster of each member, numbered by smallest member, and the first height that leaves at most `singletons` alone."""
    root, done = np.arange(n), 0
    for height in range(highest + 1):
        while done < len(merges) and merges[done][0] <= height:
            _, a, b = merges[done]
            root[root == b] = a
            done += 1
        if (np.bincount(root, minlength=n) == 1).sum() <= singletons:
            break
    _, number = np.unique(root, return_inverse=True)
    return number.tolist(), height


def cluster_diagnostics(clusters: DataFrame, sequences: DataFrame, name: str, sequence: str) -> DataFrame:
    """(cluster, size, members, widest, nearest): largest distance inside, smallest distance to another cluster."""
    from rankloom.operators.retrieval import bounded

    c = bounded(clusters.join(sequences.select(F.col(name).alias("name"), F.col(sequence).alias("s")), "name").select("name", "cluster", "s"), 5000)
    other = c.select(F.col("name").alias("n2"), F.col("cluster").alias("c2"), F.col("s").alias("s2"))
    d = c.join(F.broadcast(other)).withColumn("d", text.hamming(F.col("s"), F.col("s2")))
    out = d.groupBy("cluster").agg(F.max(F.when(F.col("cluster") == F.col("c2"), F.col("d"))).alias("widest"), F.min(F.when(F.col("cluster") != F.col("c2"), F.col("d"))).alias("nearest"))
    names = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("name")).alias("members"))
    return names.join(out, "cluster")
