"""Whole evaluations composed from the operators: arms with intervals, regimes, transfer schedules."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import bootstrap, checks, metrics, models, resampling, retrieval, splits, stats
from rankloom.sources.tables import checkpointed


def _long(rows: DataFrame, group: str, label: str, arms: dict[str, str], row_id: str, keep: list[str] | None = None) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(c).cast("double").alias("score")) for a, c in arms.items())))
    return rows.select(group, label, row_id, *(keep or []), each.alias("_x")).select(group, label, row_id, *(keep or []), "_x.*")


def _melt(df: DataFrame, keys: list[str], names: list[str], out: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(out)) for m in names))).alias("_m")
    return df.select(*keys, each).select(*keys, "_m.*")


def evaluate(rows: DataFrame, group: str, label: str, arms: dict[str, str], row_id: str, replicates: int = 1000, mode: str = "both", seed: int = 0, policy: str = "warn") -> DataFrame:
    """(arm, metric, pooled, pooled_low, pooled_high, macro, low, high, n_replicates, n_scored, n_skipped, n_distinct, n_nonfinite,
    modal_fraction, degenerate, tie_heavy): three metrics of every arm with bootstrap intervals, and diagnostics of its scores.

    `arms` names a score column by arm. Pooled and macro intervals come from the same draws of all groups; pooled intervals
    are those of auroc and ap. A pooled metric of one class is null. An empty slice raises; a degenerate score is ignored,
    warned of or raised by `policy`.
    """
    rows = checkpointed(rows.select(group, label, row_id, *dict.fromkeys(c for c in arms.values() if c not in (group, label, row_id))))  # read often
    if rows.isEmpty():
        raise ValueError("nothing to evaluate")
    names = list(arms)
    facts = []
    for a, c in arms.items():
        found = metrics.apply_policy(metrics.diagnostics(rows, group, c), policy)
        facts.append((a, found["n_distinct"], found["n_nonfinite"], found["modal_fraction"], found["degenerate"], found["tie_heavy"]))
    about = rows.sparkSession.createDataFrame(facts, "arm string, n_distinct long, n_nonfinite long, modal_fraction double, degenerate boolean, tie_heavy boolean")
    long = _long(rows, group, label, arms, row_id)
    by = metrics.group_metrics(long, ["arm", group], label, "score")
    pooled = metrics.group_metrics(long, ["arm"], label, "score", cuts=64)
    three = list(resampling.METRICS)
    macro = _melt(by, ["arm"], three, "v").groupBy("arm", "metric").agg(F.avg("v").alias("macro"), F.count("v").alias("n_scored"), F.count_if(F.col("v").isNull()).alias("n_skipped"))
    own = rows.select(group, label, row_id, *(F.col(c).alias(f"_arm_{i}") for i, c in enumerate(arms.values())))
    table = resampling.samples(own, group, label, [f"_arm_{i}" for i in range(len(arms))], row_id, replicates, mode, seed, every_group=True, pooled=True)
    bounds = stats.interval(_melt(resampling.macro_samples(table, names), ["arm"], three, "v"), "v", ["arm", "metric"])
    over = stats.interval(_melt(resampling.pooled_samples(table, names, replicates), ["arm"], ["auroc", "ap"], "v"), "v", ["arm", "metric"])
    over = over.select("arm", "metric", F.col("low").alias("pooled_low"), F.col("high").alias("pooled_high"))
    out = _melt(pooled, ["arm"], three, "pooled").join(over, ["arm", "metric"], "left").join(macro, ["arm", "metric"]).join(bounds, ["arm", "metric"], "left").join(F.broadcast(about), "arm")
    return out.select("arm", "metric", "pooled", "pooled_low", "pooled_high", "macro", "low", "high", F.coalesce("n_replicates", F.lit(0)).alias("n_replicates"), "n_scored", "n_skipped", *about.columns[1:])


def compare(rows: DataFrame, group: str, label: str, first: str, second: str, row_id: str, replicates: int = 1000, mode: str = "both", seed: int = 0, first_mask: str | None = None, second_mask: str | None = None) -> DataFrame:
    """(difference, low, high, n_replicates, p, n_groups): paired macro difference of two score columns.

    Groups that both can score are drawn, the same for both. A mask is a boolean column that keeps an arm's rows; in groups
    where both keep the same rows they share the rows drawn, elsewhere each draws from its own.
    """
    masks = {a: m for a, m in (("_a", first_mask), ("_b", second_mask)) if m}
    own = checkpointed(rows.select(group, label, row_id, F.col(first).alias("_a"), F.col(second).alias("_b"), *sorted(set(masks.values()))))
    long = _long(own, group, label, {"_a": "_a", "_b": "_b"}, row_id, sorted(set(masks.values())))
    kept = F.lit(True)
    for a, m in masks.items():
        kept = kept & ((F.col("arm") != a) | F.coalesce(F.col(m), F.lit(False)))
    by = metrics.group_metrics(long.filter(kept), [group, "arm"], label, "score")
    wide = by.groupBy(group).pivot("arm", ["_a", "_b"]).agg(F.first("auc01")).dropna()
    if wide.isEmpty():
        raise ValueError("no group that both arms can score")
    drawn = bootstrap.replicates(own, group, label, ["_a", "_b"], row_id, replicates, mode, seed=seed, masks=masks, own_rows=True).select((F.col("_a") - F.col("_b")).alias("d"))
    point = wide.agg(F.avg(F.col("_a") - F.col("_b")).alias("difference"), F.count(F.lit(1)).alias("n_groups"))
    return point.join(F.broadcast(stats.interval(drawn, "d"))).join(F.broadcast(stats.two_sided_p(drawn, "d"))).select("difference", "low", "high", "n_replicates", "p", "n_groups")


def lookup_decomposition(rows: DataFrame, group: str, label: str, score: str, exact: str, row_id: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(difference, low, high, n_replicates, p, n_groups, share_exact): what rows that training holds exactly add to a score's
    macro metric, by a paired bootstrap of all rows against the others; share_exact is the part of rows they are."""
    marked = rows.withColumns({"_all": F.col(score), "_rest": F.col(score), "_new": ~F.coalesce(F.col(exact), F.lit(False))})
    share = marked.agg(F.avg((~F.col("_new")).cast("double")).alias("share_exact"))
    return compare(marked, group, label, "_all", "_rest", row_id, replicates, seed=seed, second_mask="_new").join(share)  # one row each


def rescaling(rows: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(arm, macro_auc01) of the raw score and its within-group z-score and rank: equal up to rounding."""
    scaled = stats.rank_normalise(stats.zscore(rows.select(group, label, F.col(score).alias("raw")), group, "raw"), group, "raw", "rank").withColumn("_i", F.lit(0))
    long = _long(scaled, group, label, {"raw": "raw", "z": "z", "rank": "rank"}, "_i")
    return metrics.macro(metrics.group_metrics(long, ["arm", group], label, "score"), group, within=["arm"]).select("arm", "macro_auc01")


def regime_sweep(rows: DataFrame, group: str, label: str, arms: list[str], row_id: str, regimes: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row a regime (a boolean column): kept rows, share removed, macro of each of two arms, their difference with interval."""
    rows = checkpointed(rows.select(group, label, row_id, *arms, *regimes))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), F.col(r).alias("keep")) for r in regimes)))
    long = rows.withColumn("_r", each).select("*", "_r.*")
    counts = long.groupBy("regime").agg(F.count_if("keep").alias("rows_kept"), (100.0 * F.count_if(~F.col("keep")) / F.count(F.lit(1))).alias("pct_removed"))
    spread = long.filter("keep").groupBy("regime", group).agg(F.count_if(F.col(label).cast("int") == 1).alias("n")).groupBy("regime").agg(F.min("n").alias("support_min"), F.median("n").alias("support_median"), F.max("n").alias("support_max"))
    by = metrics.group_metrics(_long(long.filter("keep"), group, label, {a: a for a in arms}, row_id, ["regime"]), ["regime", "arm", group], label, "score")
    macro = by.groupBy("regime").pivot("arm", arms).agg(F.avg("auc01")).withColumnsRenamed({a: f"{a}_macro" for a in arms})
    drawn = []
    for r in regimes:
        reps = bootstrap.replicates(rows, group, label, arms, row_id, replicates, seed=seed, masks={a: r for a in arms}, own_rows=True)
        drawn.append(reps.select(F.lit(r).alias("regime"), (F.col(f"`{arms[0]}`") - F.col(f"`{arms[1]}`")).alias("d")))
    bounds = stats.interval(functools.reduce(DataFrame.unionByName, drawn), "d", ["regime"])
    out = counts.join(spread, "regime").join(macro, "regime").join(bounds, "regime")
    return out.withColumn("difference", F.col(f"{arms[0]}_macro") - F.col(f"{arms[1]}_macro")).withColumn("spans_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


TRANSFER_ARMS = ("random", "composition", "nearest_matrix", "retrieval", "peptide_only", "shuffled_mapping", "pseudo_sequence")
REFERENCES = ("peptide_only", "shuffled_mapping", "nearest_matrix")


def _with_validation(parts: DataFrame, group: str, label: str, row_id: str) -> DataFrame:
    """Training rows of every partition cut 90/10 into fit and validation by group and label; test rows as they are."""
    cut = splits.stratified_split(parts.filter("side = 'train'"), ["partition_id", group, label], row_id)
    return cut.unionByName(parts.filter("side = 'test'"))


def transfer_arms(rows: DataFrame, targets: DataFrame, group: str, seq: str, label: str, row_id: str, length: int, alphabet: str, shared: bool = False, seed: int = 0, codes: DataFrame | None = None, target: str | None = None, **networks) -> DataFrame:
    """(partition_id, row_id, arm, score) of held-out groups, each scored by models of the other groups.

    random; one composition model; the weight matrix of the nearest group; retrieval; and three network ensembles: on the
    sequence alone, on sequence and the group's code, and on sequence and another group's code (each group has that of the
    next, so the mapping tells nothing). codes: (group, code) with codes of `length`; by default a group's smallest
    sequence. target: a value in [0, 1] that networks fit, by default the label. With `shared`, training rows that share a
    sequence with the test side go.
    """
    parts = splits.holdout(rows, targets, group, seq if shared else None)
    test = parts.filter("side = 'test'").select("partition_id", row_id, seq)
    random = test.select("partition_id", row_id, F.lit("random").alias("arm"), models.rng.unit(seed, "random", F.col(row_id)).alias("score"))
    featured = parts.withColumn("_x", text.composition(seq, alphabet))
    pooled = models.fit_and_score(featured, ["partition_id"], "_x", label, row_id).withColumn("arm", F.lit("composition"))
    train = parts.filter("side = 'train'").withColumn("_key", F.concat_ws("|", "partition_id", group))
    matrix = models.pwm(train, "_key", seq, label, length, alphabet)
    codes = codes if codes is not None else rows.groupBy(group).agg(F.min(seq).alias("code"))
    pair = codes.select(F.col(group).alias("partition_id"), F.col("code").alias("_t")).join(F.broadcast(retrieval.bounded(codes))).filter(F.col("partition_id") != F.col(group))
    source = pair.groupBy("partition_id").agg(F.min(F.struct(text.hamming(F.col("_t"), F.col("code")).alias("d"), F.col(group).alias("g"))).alias("b"))
    keyed = test.join(source, "partition_id").withColumn("_key", F.concat_ws("|", "partition_id", "b.g"))
    near = models.pwm_score(keyed, matrix, "_key", seq, row_id).join(test.select("partition_id", row_id), row_id).withColumn("arm", F.lit("nearest_matrix"))
    entries = train.filter(F.col(label).cast("int") == 1).select("partition_id", F.col(seq).alias("entry")).distinct()
    found = retrieval.nearest_positive(test, entries, "partition_id", seq).withColumn("arm", F.lit("retrieval"))
    shuffled = text.derangement(codes, group, "code").select(group, F.col("shifted").alias("_other"))
    width = length * len(alphabet)
    cut = _with_validation(parts, group, label, row_id).join(codes.select(group, F.col("code").alias("_code")), group).join(shuffled, group)
    own = models.hot(seq, length, alphabet)
    by_arm = {"peptide_only": own, "shuffled_mapping": F.concat(own, models.hot("_other", length, alphabet, width)), "pseudo_sequence": F.concat(own, models.hot("_code", length, alphabet, width))}
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), x.alias("_x")) for a, x in by_arm.items()))).alias("_a")
    long = cut.select("partition_id", row_id, F.col(target or label).cast("double").alias("_v"), "side", each).select("partition_id", row_id, "_v", "side", "_a.*")
    nets = models.arm_ensembles(long, "arm", "partition_id", "_x", "_v", row_id, {a: width * (1 + (a != "peptide_only")) for a in by_arm}, **networks)
    cols = ["partition_id", row_id, "arm", "score"]
    return functools.reduce(DataFrame.unionByName, [x.select(*cols) for x in (random, pooled, near, found, nets)])


def transfer_scores(rows: DataFrame, targets: DataFrame, group: str, seq: str, label: str, row_id: str, length: int, alphabet: str, shared: bool = False, **options) -> DataFrame:
    """Written table of (partition_id, row_id, label, one column an arm): all transfer arms over the concatenated partitions."""
    scores = transfer_arms(rows, targets, group, seq, label, row_id, length, alphabet, shared, **options)
    wide = scores.groupBy("partition_id", row_id).pivot("arm", list(TRANSFER_ARMS)).agg(F.first("score"))
    return checkpointed(wide.join(rows.select(row_id, label), row_id))


def transfer(scores: DataFrame, label: str, row_id: str, replicates: int = 1000, policy: str = "warn") -> DataFrame:
    """evaluate() of all arms of transfer_scores()."""
    return evaluate(scores, "partition_id", label, {a: a for a in TRANSFER_ARMS}, row_id, replicates, policy=policy)


def transfer_comparisons(scores: DataFrame, label: str, row_id: str, replicates: int = 1000, arm: str = "pseudo_sequence", references: tuple[str, ...] = REFERENCES) -> DataFrame:
    """(reference, difference, low, high, n_replicates, p, n_groups): the arm's paired macro difference from each reference."""
    each = [compare(scores, "partition_id", label, arm, r, row_id, replicates).withColumn("reference", F.lit(r)) for r in references]
    return functools.reduce(DataFrame.unionByName, each)


FOLD_ARMS = ("random", "length_composition", "edit_retrieval", "embedding_retrieval", "matrix", "mlp_pseudo_sequence", "mlp_one_hot")


def fold_arms(rows: DataFrame, fold: str, group: str, seq: str, label: str, row_id: str, length: int, alphabet: str, seed: int = 0, codes: DataFrame | None = None, target: str | None = None, embedding: DataFrame | None = None, **networks) -> DataFrame:
    """(row_id, arm, score) of every row by models and entries of the other folds, FOLD_ARMS all told; every row once an arm.

    embedding: (seq, vec); by default hashed k-mers. codes and target as in transfer_arms().
    """
    parts = splits.fold_sides(rows, fold)
    random = rows.select(row_id, F.lit("random").alias("arm"), models.rng.unit(seed, "random", F.col(row_id)).alias("score"))
    comp = models.fit_and_score(parts.withColumn("_x", text.composition(seq, alphabet)), ["partition_id", group], "_x", label, row_id).select(row_id, F.lit("length_composition").alias("arm"), "score")
    keyed = parts.withColumn("_key", F.concat_ws("|", "partition_id", group))
    matrix = models.pwm(keyed.filter("side = 'train'"), "_key", seq, label, length, alphabet)
    pwm = models.pwm_score(keyed.filter("side = 'test'"), matrix, "_key", seq, row_id).select(row_id, F.lit("matrix").alias("arm"), "score")
    entries = retrieval.database(rows, group, seq, label, [fold])
    queries = rows.select(row_id, group, seq, fold)
    near = retrieval.nearest_positive(queries, entries, group, seq, other_fold=fold).select(row_id, F.lit("edit_retrieval").alias("arm"), "score")
    vectors = embedding if embedding is not None else models.hashed_embedding(rows, seq).select(seq, "vec")
    # a fold's queries meet the entries of each other fold as a group of its own
    sides = parts.join(vectors.hint("merge"), seq).withColumn("_key", F.concat_ws("|", "partition_id", group))
    asked = sides.filter("side = 'test'").select("_key", seq, F.col("vec").alias("_q")).dropDuplicates(["_key", seq])
    held = sides.filter((F.col("side") == "train") & (F.col(label).cast("int") == 1)).select("_key", F.col(seq).alias("entry"), F.col("vec").alias("_e")).dropDuplicates(["_key", "entry"])
    close = retrieval.nearest_vectors(asked, held, "_key", seq, "_q", "_e").select("_key", seq, "score")
    embedded = sides.filter("side = 'test'").select(row_id, "_key", seq).join(close, ["_key", seq]).select(row_id, F.lit("embedding_retrieval").alias("arm"), "score")
    codes = codes if codes is not None else rows.groupBy(group).agg(F.min(seq).alias("code"))
    names = [r[0] for r in retrieval.bounded(codes.select(group).distinct()).orderBy(group).collect()]  # one place a group in the one-hot row
    width = length * len(alphabet)
    cut = _with_validation(parts, group, label, row_id).join(codes.select(group, F.col("code").alias("_code")), group)
    place = F.array((F.array_position(F.array(*map(F.lit, names)), F.col(group)) - 1 + width).cast("int"))
    own = models.hot(seq, length, alphabet)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), x.alias("_x")) for a, x in (("mlp_pseudo_sequence", F.concat(own, models.hot("_code", length, alphabet, width))), ("mlp_one_hot", F.concat(own, place)))))).alias("_a")
    long = cut.select("partition_id", row_id, F.col(target or label).cast("double").alias("_v"), "side", each).select("partition_id", row_id, "_v", "side", "_a.*")
    nets = models.arm_ensembles(long, "arm", "partition_id", "_x", "_v", row_id, {"mlp_pseudo_sequence": 2 * width, "mlp_one_hot": width + len(names)}, **networks).select(row_id, "arm", "score")
    out = checkpointed(functools.reduce(DataFrame.unionByName, [random, comp, near, embedded, pwm, nets]))
    checks.scored_once(rows, out, row_id, "arm", "score")
    return out


def uplift(by_arm: DataFrame, arm: str, value: str, baseline: str = "random") -> DataFrame:
    """Each arm's value over that of the baseline arm."""
    base = by_arm.filter(F.col(arm) == baseline).select(F.col(value).alias("_b"))
    return by_arm.join(F.broadcast(base)).withColumn("uplift", F.col(value) - F.col("_b")).drop("_b")
