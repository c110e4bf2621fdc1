"""Column builders over array<double> and array<float> vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column | str) -> Column:
    """Unit vector; of a zero vector, NaN in every place."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)


MODES = {"concat": 2, "interactions": 4, "left_only": 1, "right_only": 1}


def feature_width(mode: str, hidden: int) -> int:
    return MODES[mode] * hidden


def pair_features(left: Column | str, right: Column | str, mode: str = "concat") -> Column:
    """Feature block of two vectors as array<float>."""
    a, b = (F.transform(_c(x), lambda v: v.cast("float")) for x in (left, right))
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}; one of {sorted(MODES)}")
    if mode == "left_only":
        return a
    if mode == "right_only":
        return b
    if mode == "concat":
        return F.concat(a, b)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def standardise(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Each dimension less its mean, over its population deviation (1 where that is 0)."""
    long = df.select(F.posexplode(column).alias("d", "x"))
    stats = long.groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    row = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))), lambda r: F.struct(r["m"].alias("m"), r["s"].alias("s"))).alias("_scale"))
    return df.join(F.broadcast(row)).withColumn(out, F.zip_with(F.col(column), F.col("_scale"), lambda x, r: (x.cast("double") - r["m"]) / r["s"])).drop("_scale")


def mean_pool(residues: Column | str) -> Column:
    """Mean over the rows of a nested array."""
    r = _c(residues)
    zero = F.transform(F.element_at(r, 1), lambda x: F.lit(0.0))
    total = F.aggregate(r, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(r))


def pad(residues: Column | str, length: int, width: int) -> tuple[Column, Column]:
    """(nested array filled with zero rows to `length`, mask that is true for real rows)."""
    r = _c(residues)
    n = F.size(r)
    blank = F.array(*(F.lit(0.0) for _ in range(width)))
    real = F.transform(r, lambda v: F.transform(v, lambda x: x.cast("double")))
    mask = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= n)
    return F.concat(real, F.array_repeat(blank, F.greatest(F.lit(length) - n, F.lit(0)))), mask


def masked_mean(padded: Column | str, mask: Column | str) -> Column:
    """Mean of the rows whose mask is true; what stands in the others doesn't matter."""
    both = F.arrays_zip(_c(padded).alias("v"), _c(mask).alias("m"))
    return mean_pool(F.transform(F.filter(both, lambda x: x["m"]), lambda x: x["v"]))
