"""Negative sampling and capped, weighted or stratified draws, on order-free random numbers.

A draw without replacement is a run of draws with replacement that leaves out repeats and known positives: each draw is a
position in a numbered table, so a row meets its own few draws by an equi-join and never the whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import rng, text
from rankloom.operators.checks import require_columns, require_none
from rankloom.operators.ordering import numbered
from rankloom.operators.retrieval import bounded, neighbour_ranks, within_edits
from rankloom.sources.tables import checkpointed

PAIR_GUARD = 2_000_000


def context(pairs: DataFrame, group: str, seq: str, attribute: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(known positive pairs, pool of groups with their row counts and most frequent attribute)."""
    require_columns(pairs, group, seq, *([attribute] if attribute else []))
    known = pairs.select(group, seq).distinct()
    aggs = [F.count(F.lit(1)).alias("weight")] + ([F.mode(attribute, True).alias(attribute)] if attribute else [])
    return known, pairs.groupBy(group).agg(*aggs)


def draws(ratio: float, row_id: Column, seed: int) -> Column:
    """Negatives of a row: the floor of the ratio, and one more with the probability of the rest."""
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    whole = int(ratio)
    return F.lit(whole) + (rng.unit(seed, "extra", row_id) < ratio - whole).cast("int")


def _assemble(chosen: DataFrame, pairs: DataFrame, pool: DataFrame, group: str, row_id: str, attribute: str | None, label: str) -> DataFrame:
    """Source rows with the drawn group, its attribute and label 0; source_row_id keeps the row they come from."""
    source = pairs.drop(group, *([attribute] if attribute else []), label)
    out = source.join(chosen, row_id).withColumnRenamed(row_id, "source_row_id").withColumnRenamed("drawn", group).withColumn(label, F.lit(0))
    return out.join(pool.select(group, attribute), group) if attribute else out


def sample(pairs: DataFrame, group: str, seq: str, row_id: str, strategy: str = "matched", ratio: float = 5.0, seed: int = 0, attribute: str | None = None, label: str = "label", guard: int | None = PAIR_GUARD) -> DataFrame:
    """Negatives of the positive `pairs`: rows with another group that is no known positive of their sequence.

    shuffle: uniform without replacement. matched: weighted by positive rows of the group. hard: the groups nearest to the
    row's own by edit distance, then name. uniform: every pair of distinct sequence and group that is no positive. A pool
    that is too small gives all it has. row_id tells the rows apart; a group that is null is never drawn.
    """
    known, pool = context(pairs, group, seq, attribute)
    if strategy == "uniform":
        return uniform(pairs, known, pool, group, seq, row_id, attribute, label, guard)
    if strategy not in ("shuffle", "matched", "hard"):
        raise ValueError(f"unknown strategy {strategy!r}")
    k = draws(ratio, F.col(row_id), seed)
    rows = pairs.select(row_id, F.col(seq).alias("_seq"), F.col(group).alias("_own"), k.alias("_k"))
    others = pool.select(F.col(group).alias("drawn"), F.col("weight").alias("_w")).filter("drawn is not null")
    positive = known.select(F.col(group).alias("drawn"), F.col(seq).alias("_seq"))
    if strategy == "hard":
        chosen = _nearest(rows, others, positive, row_id)
    else:
        source = others if strategy == "shuffle" else pairs.select(row_id, F.col(group).alias("drawn")).filter("drawn is not null")
        places = numbered(source, "drawn" if strategy == "shuffle" else row_id).select("pos", "drawn")
        chosen = _successive(rows.drop("_own"), places, others, positive, row_id, int(ratio) + 1, seed, strategy)
    return _assemble(chosen, pairs, pool, group, row_id, attribute, label)


def _successive(rows: DataFrame, places: DataFrame, others: DataFrame, positive: DataFrame, row_id: str, most: int, seed: int, strategy: str) -> DataFrame:
    """(row_id, drawn): `_k` groups a row, at most `most`, drawn one after the other from what is allowed and not drawn yet.

    `places` numbers what a draw picks evenly: the groups, or the positive rows, so that a group's chance is its share of them.
    A row draws 2 * most + 6 positions and keeps the first `_k` different groups that are no positives of its sequence. The few
    rows that get too little that way (their positives hold most of the pool, or the pool is hardly larger than `_k`) take
    the rest by sort keys over the whole pool: the next accepted draw doesn't depend on how long one waits for it, so the
    chances are those of drawing on.
    """
    n, kind = places.count(), dict(places.dtypes)["drawn"]
    asked = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(2 * most + 5)))).withColumn("pos", rng.position(n, seed, strategy, F.col(row_id), F.col("_t")))
    hits = asked.join(places, "pos").join(positive, ["drawn", "_seq"], "left_anti")
    inorder = hits.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("_t", "drawn"))).alias("_d"))
    got = F.coalesce(F.slice(F.array_distinct("_d.drawn"), F.lit(1), F.col("_k")), F.array().cast(f"array<{kind}>"))
    found = checkpointed(rows.join(inorder, row_id, "left").select(*rows.columns, got.alias("_got")))
    short = found.filter("size(_got) < _k")
    u = rng.unit(seed, f"{strategy} rest", F.col(row_id), F.col("drawn"))
    key = -u if strategy == "shuffle" else rng.gumbel(F.col("_w"), u)
    left = short.crossJoin(others).filter("not array_contains(_got, drawn)").join(positive, ["drawn", "_seq"], "left_anti").withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("_key"), "drawn"))
    rest = left.withColumn("_rank", rank).filter("_rank <= _k - size(_got)").select(row_id, "drawn")
    return found.select(row_id, F.explode("_got").alias("drawn")).unionByName(rest)


def _nearest(rows: DataFrame, others: DataFrame, positive: DataFrame, row_id: str) -> DataFrame:
    """(row_id, drawn): the `_k` groups nearest to a row's own that are no positives of its sequence.

    Groups are ranked once for each group. Of a sequence's m positives at most m - 1 stand in its own group's list, so a row
    meets the first _k + m - 1 of the list and no more.
    """
    of = positive.groupBy("_seq").agg(F.count(F.lit(1)).alias("_m"))
    asked = rows.join(of, "_seq", "left").withColumn("_need", F.col("_k") + F.coalesce("_m", F.lit(1)) - 1)
    deepest = asked.agg(F.max("_need")).first()[0] or 0
    ranks = neighbour_ranks(others, "drawn", deepest).select(F.col("name").alias("_own"), F.col("other").alias("drawn"), F.col("rank").alias("_place"))
    met = asked.join(ranks, "_own").filter("_place <= _need").join(positive, ["drawn", "_seq"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(row_id).orderBy("_place"))
    return met.withColumn("_rank", rank).filter("_rank <= _k").select(row_id, "drawn")


def uniform(pairs: DataFrame, known: DataFrame, pool: DataFrame, group: str, seq: str, row_id: str, attribute: str | None = None, label: str = "label", guard: int | None = PAIR_GUARD) -> DataFrame:
    """Every distinct sequence with every group that is none of its positives; more than `guard` pairs raise first, if there is one."""
    first = pairs.groupBy(seq).agg(F.min(row_id).alias(row_id))
    if guard is not None:
        n, m = first.count(), pool.count()
        if n * m > guard:
            raise ValueError(f"{n} sequences x {m} groups exceed {guard} pairs")
    grid = first.crossJoin(pool.select(F.col(group).alias("drawn")))  # the result is this grid, less the positives
    chosen = grid.join(known.withColumnRenamed(group, "drawn"), ["drawn", seq], "left_anti").select(row_id, "drawn")
    return _assemble(chosen, pairs, pool, group, row_id, attribute, label)


def training_set(pairs: DataFrame, negatives: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """Positives and negatives together, in a seeded order."""
    both = pairs.withColumnRenamed(row_id, "source_row_id").unionByName(negatives, allowMissingColumns=True)
    return both.orderBy(rng.unit(seed, "order", F.xxhash64(*both.columns)))


def summary(negatives: DataFrame, pairs: DataFrame, group: str, seq: str) -> DataFrame:
    """n_negatives, n_groups, n_sequences, n_collisions (0 unless something is wrong)."""
    hits = negatives.join(pairs.select(group, seq).distinct().withColumn("_hit", F.lit(1)), [group, seq], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_negatives"), F.countDistinct(group).alias("n_groups"), F.countDistinct(seq).alias("n_sequences"), F.count("_hit").alias("n_collisions"))


def cap_per_group(df: DataFrame, group: str, row_id: str, most: int, seed: int = 0) -> DataFrame:
    """A random `most` rows of each group at most."""
    order = Window.partitionBy(group).orderBy(rng.unit(seed, "cap", F.col(row_id)), row_id)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def distance_eligible(pool: DataFrame, known: DataFrame, targets: DataFrame, group: str, seq: str, beyond: int) -> DataFrame:
    """(group, seq): sequences every known group of which is more than `beyond` edits from the target group.

    The pairs that break the rule come from an equi-join on close groups; a sequence without known groups is eligible.
    """
    t = targets.select(group).distinct()
    close = within_edits(known.select(F.col(group).alias("_g")), t, "_g", group, beyond)
    broken = known.select(F.col(group).alias("_g"), seq).join(close, "_g").select(group, seq).distinct()
    return pool.select(seq).distinct().crossJoin(t).join(broken, [group, seq], "left_anti")


def evaluation_set(positives: DataFrame, eligible: DataFrame, group: str, seq: str, row_id: str, cap: int, per_positive: int, seed: int = 0) -> DataFrame:
    """(group, seq, label): capped positives and exactly per_positive times as many eligible negatives; a shortage raises."""
    pos = cap_per_group(positives, group, row_id, cap, seed).select(group, seq, F.lit(1).alias("label"))
    want = pos.groupBy(group).agg((F.count(F.lit(1)) * per_positive).alias("_want"))
    order = Window.partitionBy(group).orderBy(rng.unit(seed, "negative", F.col(group), F.col(seq)), seq)
    ranked = eligible.join(want, group).withColumn("_n", F.row_number().over(order)).filter("_n <= _want")
    got = want.join(ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_got")), group, "left")
    require_none(got.filter("coalesce(_got, 0) < _want").select(group), "groups short of negatives")
    return pos.unionByName(ranked.select(group, seq, F.lit(0).alias("label"))).orderBy(group, F.desc("label"), seq)


def background(pool: DataFrame, positives: DataFrame, group: str, seq: str, most: int = 1000, seed: int = 0) -> DataFrame:
    """(group, seq): at most `most` sequences of the pool that are no positives of the group, drawn without replacement."""
    t = bounded(positives.select(group).distinct())
    free = pool.select(seq).distinct().join(F.broadcast(t)).join(positives.select(group, seq), [group, seq], "left_anti")
    order = Window.partitionBy(group).orderBy(rng.unit(seed, "background", F.col(group), F.col(seq)), seq)
    return free.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def label_batches(df: DataFrame, label: str, row_id: str, n_batches: int, labels_per_batch: int, rows_per_label: int, seed: int = 0) -> DataFrame:
    """(batch, label, slot, row_id): labels of two rows or more without replacement, rows with replacement only in short labels."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    batches = df.sparkSession.range(n_batches).select(F.col("id").alias("batch"))
    u = rng.unit(seed, "label", F.col("batch"), F.col(label))
    picked = batches.join(F.broadcast(bounded(counts))).withColumn("_l", F.row_number().over(Window.partitionBy("batch").orderBy(u, label))).filter(F.col("_l") <= labels_per_batch)
    numbered = df.select(label, row_id).withColumn("_pos", F.row_number().over(Window.partitionBy(label).orderBy(row_id)) - 1)
    full = picked.filter(F.col("_n") >= rows_per_label).join(numbered, label)
    order = Window.partitionBy("batch", label).orderBy(rng.unit(seed, "row", F.col("batch"), F.col(row_id)), row_id)
    full = full.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= rows_per_label).select("batch", label, "slot", row_id)
    short = picked.filter(F.col("_n") < rows_per_label).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(rows_per_label))))
    short = short.withColumn("_pos", rng.bounded_int(rng.unit(seed, "again", F.col("batch"), F.col(label), F.col("slot")), F.col("_n")))
    return full.unionByName(short.join(numbered, [label, "_pos"]).select("batch", label, "slot", row_id))
