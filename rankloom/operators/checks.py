"""Guards: contracts on columns, counts, scores and result records. Each raises ValueError with what is wrong."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table or record doesn't keep its contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_none(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there are rows, naming at most `show` of them."""
    rows = violations.limit(show + 1).collect()
    if rows:
        named = ", ".join(str(tuple(r)) if len(r) > 1 else str(r[0]) for r in rows[:show])
        raise ContractError(f"{what}: {named}{', ...' if len(rows) > show else ''}")


def require_counts(field: str, expected: dict[str, int], actual: dict[str, int]) -> None:
    """Equal key sets and equal values."""
    missing, extra = sorted(expected.keys() - actual.keys()), sorted(actual.keys() - expected.keys())
    if missing or extra:
        raise ContractError(f"{field}: missing {missing}, unexpected {extra}")
    wrong = {k: (expected[k], actual[k]) for k in sorted(expected) if expected[k] != actual[k]}
    if wrong:
        raise ContractError(f"{field}: " + ", ".join(f"{k} is {b}, expected {a}" for k, (a, b) in wrong.items()))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Both tables hold exactly the same keys."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    require_none(a.exceptAll(b), f"{key} missing on the right")
    require_none(b.exceptAll(a), f"{key} missing on the left")


def keys_in_several_folds(df: DataFrame, key: str, fold: str) -> DataFrame:
    """(key, n_folds) of keys that occur in more than one fold."""
    return df.groupBy(key).agg(F.countDistinct(fold).alias("n_folds")).filter("n_folds > 1")


def class_presence(df: DataFrame, fold: str, group: str, label: str) -> DataFrame:
    """Counts of both classes of each (fold, group) inside the fold and in all other folds."""
    y = F.col(label).cast("int")
    own = df.groupBy(fold, group).agg(F.sum(y).cast("long").alias("test_pos"), F.sum(1 - y).cast("long").alias("test_neg"))
    over = f"over (partition by `{group}`)"
    return own.select(
        fold, group, "test_pos", "test_neg",
        F.expr(f"cast(sum(test_pos) {over} as bigint) - test_pos").alias("train_pos"),
        F.expr(f"cast(sum(test_neg) {over} as bigint) - test_neg").alias("train_neg"),
    )


def require_class_presence(df: DataFrame, fold: str, group: str, label: str) -> DataFrame:
    """class_presence(), if every fold and group has both classes in test and in training; else an error that names them."""
    found = class_presence(df, fold, group, label)
    least = F.least("test_pos", "test_neg", "train_pos", "train_neg")
    require_none(found.filter(least < 1).select(fold, group), "folds and groups without both classes")
    return found


def scored_once(rows: DataFrame, scores: DataFrame, key: str, arm: str, score: str) -> None:
    """Every arm scores every row exactly once with a finite number."""
    bad = F.isnan(score) | F.col(score).isNull() | (F.abs(score) == float("inf"))
    require_none(scores.filter(bad).select(arm, key), "scores that are not finite")
    require_none(scores.groupBy(arm, key).count().filter("count > 1").select(arm, key), "rows scored more than once")
    want = rows.select(key).distinct().join(F.broadcast(scores.select(arm).distinct()))
    require_none(want.join(scores, [arm, key], "left_anti").select(arm, key), "rows without a score")


def no_nulls(df: DataFrame, *columns: str) -> None:
    any_null: Column = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    require_none(df.filter(any_null).select(*columns), "null values")


def finite(record: Any, at: str = "result") -> None:
    """Every number of a nested record is finite, and no number stands where a bool is meant or the reverse."""
    if isinstance(record, dict):
        for k, v in record.items():
            finite(v, f"{at}.{k}")
    elif isinstance(record, list | tuple):
        for i, v in enumerate(record):
            finite(v, f"{at}[{i}]")
    elif isinstance(record, float) and not math.isfinite(record):
        raise ContractError(f"{at} is {record}")


def check_record(record: dict[str, Any], fields: dict[str, type], at: str = "result") -> None:
    """Exactly these fields, each of its type; a bool is no number."""
    require_counts(f"{at} fields", dict.fromkeys(fields, 1), dict.fromkeys(record, 1))
    for name, kind in fields.items():
        v = record[name]
        if (isinstance(v, bool) and kind is not bool) or not isinstance(v, (int, float) if kind is float else kind):
            raise ContractError(f"{at}.{name} should be {kind.__name__}, not {type(v).__name__}")
    finite(record, at)


def check_evaluation(result: dict[str, Any], tolerance: float = 1e-12) -> None:
    """macro is the mean over groups, and each difference is arm less reference."""
    for arm, r in result["arms"].items():
        values = list(r["by_group"].values())
        if abs(r["macro"] - sum(values) / len(values)) > tolerance:
            raise ContractError(f"macro of {arm} is not the mean over its groups")
    for name, r in result.get("differences", {}).items():
        if abs(r["difference"] - (result["arms"][r["arm"]]["macro"] - result["arms"][r["reference"]]["macro"])) > tolerance:
            raise ContractError(f"difference {name} is not arm less reference")
    finite(result)
