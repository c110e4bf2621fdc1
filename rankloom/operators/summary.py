"""Grouped counts, modes, caps and duplicate elimination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import ordering


def support(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("support"))


def distinct_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(value).alias("n_distinct"))


def class_support(df: DataFrame, group: str, label: str, least: int) -> DataFrame:
    """(group, n_pos, n_neg) of groups with at least `least` rows of both classes."""
    y = F.col(label).cast("int")
    out = df.groupBy(group).agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))
    return out.filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least))


def with_support(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of at least `least` rows."""
    return df.join(support(df, group).filter(F.col("support") >= least).select(group), group, "left_semi")


def mode_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value, the smallest of several."""
    return df.groupBy(group).agg(F.mode(value, True).alias("mode"))


def sets_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): sorted distinct values."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def keep_best(df: DataFrame, keys: list[str], score: str, row_id: str) -> DataFrame:
    """The row of largest score of each key; of ties the last row_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(row_id))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def first_per_key(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The row of smallest row_id of each key."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), row_id).alias("_r"))
    return best.select("_r.*")


def group_profile(df: DataFrame, group: str, label: str, first: str, mode: str, score: str, threshold: float, row_id: str) -> DataFrame:
    """n_positive, n_rows, first value, mode and rows of at least a threshold, by group."""
    return df.groupBy(group).agg(
        F.sum(F.col(label).cast("int")).cast("long").alias("n_positive"), F.count(F.lit(1)).alias("n_rows"),
        F.min_by(first, row_id).alias("first_value"), F.mode(mode, True).alias("mode_value"), F.count_if(F.col(score) >= threshold).alias("n_high"),
    )


def count_spread(df: DataFrame, group: str) -> DataFrame:
    """Smallest, median and largest group size."""
    n = support(df, group)
    return n.agg(F.min("support").alias("least"), F.median("support").alias("median"), F.max("support").alias("most"))


def best_row(df: DataFrame, group: str, value: str, row_id: str) -> DataFrame:
    """The row of largest value of each group, the first of several."""
    order = Window.partitionBy(group).orderBy(F.desc(value), row_id)
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def share_removed(df: DataFrame, key: str, removed: Column) -> DataFrame:
    """Percentage of distinct keys with any removed row."""
    return df.groupBy(key).agg(F.bool_or(removed).alias("r")).agg((F.avg(F.col("r").cast("int")) * 100).alias("pct_removed"))


def distance_by_source(df: DataFrame, source: str, distance: str) -> DataFrame:
    """Mean, median and number of zero distances by negative source."""
    return df.groupBy(source).agg(F.avg(distance).alias("mean_distance"), F.median(distance).alias("median_distance"), F.count_if(F.col(distance) == 0).alias("n_exact"))


def frequency_score(df: DataFrame, seq: str) -> DataFrame:
    """`df` with how often its sequence occurs, and its length: two shortcut scores."""
    counts = df.groupBy(seq).agg(F.count(F.lit(1)).alias("frequency"))
    return df.join(counts, seq).withColumn("seq_length", F.length(seq))


def multi_union_distinct(columns: list[tuple[DataFrame, str]], out: str = "value") -> DataFrame:
    """Distinct values of several columns of several tables."""
    parts = [df.select(F.col(c).alias(out)) for df, c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    return total.dropna().distinct()


def length_batches(df: DataFrame, seq: str, budget: int, padding: int = 2) -> DataFrame:
    """(seq, batch): distinct sequences in order of (length, text), filled greedily into batches of at most `budget` tokens.

    A batch of k sequences takes k times its longest length plus `padding`; a sequence that exceeds the budget by itself is a
    batch of its own. Where a batch ends depends on the counts by length alone, so the fill runs over those (as many rows as
    there are lengths) with a carry from each length to the next; the rows only need their place in the order.
    """
    d = df.select(seq).filter(F.col(seq).isNotNull()).distinct().withColumn("_len", F.length(seq))
    counts = d.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).orderBy("_len").collect()  # a row a length
    plan, before, batch, held = [], 0, -1, 0
    for length, n in counts:
        most = max(1, budget // (length + padding))
        first = min(n, max(0, most - held)) if held else 0  # what the open batch still takes
        plan.append((length, before, batch, first, most))
        rest = n - first
        if rest:
            batch, held = batch + -(-rest // most), (rest - 1) % most + 1
        else:
            held += first
        before += n
    rules = df.sparkSession.createDataFrame(plan, "_len int, _before long, _open long, _first long, _most long")
    placed = ordering.numbered(d, "_len", seq, out="_pos").join(F.broadcast(rules), "_len").withColumn("_at", F.col("_pos") - F.col("_before"))
    later = F.col("_open") + 1 + F.floor((F.col("_at") - F.col("_first")) / F.col("_most"))
    return placed.select(seq, F.when(F.col("_at") < F.col("_first"), F.col("_open")).otherwise(later).alias("batch"))
