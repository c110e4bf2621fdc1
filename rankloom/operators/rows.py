"""Row filters, lookups and set operations with the guards that ranking tables need."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.checks import ContractError, require_columns, require_none


def where_equal(df: DataFrame, equal: dict[str, object], not_null: list[str]) -> DataFrame:
    """Rows with every given value, and none of the named columns null."""
    require_columns(df, *equal, *not_null)
    tests = [F.col(c) == F.lit(v) for c, v in equal.items()] + [F.col(c).isNotNull() for c in not_null]
    return df.filter(functools.reduce(Column.__and__, tests, F.lit(True)))


def keep_keys(df: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose key (of one or several columns) occurs in `keys`, once each."""
    return df.join(keys.select(*names).distinct(), list(names), "left_semi")


def leave_out_keys(df: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose key does not occur in `keys`; a null key occurs nowhere."""
    return df.join(keys.select(*names).distinct(), list(names), "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with the table's value of its key; a key that the table lacks, or has twice, is an error."""
    small = table.select(key, value)
    require_none(small.groupBy(key).count().filter("count > 1").select(key), f"{key} more than once in the table")
    require_none(df.select(key).distinct().join(small, key, "left_anti"), f"{key} missing from the table")
    return df.join(small, key)


def zip_rows(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows of two tables side by side, by their numbers; a number on one side only, or twice, is an error."""
    for side in (left, right):
        require_none(side.groupBy(place).count().filter("count > 1").select(place), f"{place} more than once")
    gap = left.select(place, F.lit(1).alias("a")).join(right.select(place, F.lit(1).alias("b")), place, "full").filter("a is null or b is null")
    require_none(gap.select(place), f"{place} on one side only")
    return left.join(right, place)


def mixed_sort(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Rows by several columns, each falling (True) or rising."""
    return df.orderBy(*(F.desc(c) if falling else F.asc(c) for c, falling in order))


def stacked(frames: dict[str, DataFrame], part: str) -> DataFrame:
    """All rows of the frames under each other, with the name of their frame; the columns must be the same."""
    first = next(iter(frames.values())).columns
    for name, f in frames.items():
        if f.columns != first:
            raise ContractError(f"{name} has columns {f.columns}, not {first}")
    return functools.reduce(DataFrame.unionByName, [f.withColumn(part, F.lit(n)) for n, f in frames.items()])


def conserved(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """The whole, if the parts hold each of its keys exactly once and no other."""
    rows = functools.reduce(DataFrame.unionByName, [p.select(key) for p in parts])
    require_none(rows.groupBy(key).count().filter("count > 1").select(key), f"{key} in several parts")
    require_none(whole.select(key).exceptAll(rows), f"{key} in no part")
    require_none(rows.exceptAll(whole.select(key)), f"{key} not in the whole")
    return whole


def slices(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """`df` once for each named mask that holds, with the slice's name."""
    names = F.filter(F.array(*(F.when(m, F.lit(n)) for n, m in masks.items())), lambda x: x.isNotNull())
    return df.withColumn("slice", F.explode(names))


def tidy(value: Column, low: float, high: float, digits: int, missing: float) -> Column:
    """The value as a double clipped to [low, high] and rounded; `missing` where it is null or NaN."""
    v = value.cast("double")
    known = F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(F.lit(float(missing)))
    return F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), known)), digits)


def log_counts(count: Column, base: float | None = 10.0) -> Column:
    """Logarithm of a positive count, to base 10 or natural (base None); null for 0."""
    return F.when(count > 0, F.log10(count) if base == 10.0 else F.log(count))


def json_field(document: Column, *path: str) -> Column:
    """A nested field of a JSON document as text; an absent one raises and names itself."""
    at = "$." + ".".join(path)
    found = F.get_json_object(document, at)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("missing key: "), F.lit(".".join(path)))).cast("string"))


def survivors(df: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that an external tool's list keeps, their counts): the list must name known keys only."""
    require_none(kept.select(key).distinct().join(df.select(key).distinct(), key, "left_anti"), f"unknown {key} in the list")
    rows = keep_keys(df, kept, key)
    return rows, df.agg(F.count(F.lit(1)).alias("n_rows")).join(rows.agg(F.count(F.lit(1)).alias("n_kept")))
