"""Column builders over short sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ordering

#: The twenty residue letters, in the order of all encodings.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_anchors(seq: Column | str) -> Column:
    """Trimmed upper-case sequence without one leading C, then without one trailing F or W."""
    clean = F.upper(F.regexp_replace(_c(seq), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(clean, "^C", ""), r"[FW]\z", "")


def full_match(seq: Column | str, low: int, high: int, alphabet: str = RESIDUES) -> Column:
    """True where the whole value is `low` to `high` letters of the alphabet."""
    return _c(seq).rlike(rf"\A[{alphabet}]{{{low},{high}}}\z")


def edit_distance(a: Column | str, b: Column | str, within: int | None = None) -> Column:
    """Levenshtein distance with unit costs; beyond `within` it is within + 1."""
    if within is None:
        return F.levenshtein(_c(a), _c(b))
    d = F.levenshtein(_c(a), _c(b), within)
    return F.when(d < 0, F.lit(within + 1)).otherwise(d)


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; two empty values are alike."""
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - edit_distance(a, b).cast("double") / longest)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ; unequal lengths are an error."""
    a, b = _c(a), _c(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    count = F.aggregate(differ, F.lit(0), lambda acc, x: acc + x)
    wrong = F.raise_error(F.lit("Hamming distance needs sequences of equal length")).cast("int")
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, F.lit(0)).otherwise(wrong)).when(F.length(a) != F.length(b), wrong).otherwise(count)


def hamming_similarity(a: Column | str, b: Column | str, length: int) -> Column:
    return F.lit(1.0) - hamming(a, b).cast("double") / F.lit(float(length))


def composition(seq: Column | str, alphabet: str = RESIDUES) -> Column:
    """[length, count of each letter] as doubles."""
    s = _c(seq)
    return F.array(F.length(s).cast("double"), *((F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))).cast("double") for x in alphabet))


def one_hot(value: Column | str, values: list[str]) -> Column:
    return F.array(*(F.coalesce((_c(value) == F.lit(v)).cast("double"), F.lit(0.0)) for v in values))


def residue_encode(seq: Column | str, matrix: dict[str, list[float]]) -> Column:
    """Rows of a substitution matrix for each residue, laid end to end; an unknown residue is an error."""
    table = F.create_map(*(x for k, row in matrix.items() for x in (F.lit(k), F.array(*(F.lit(float(v)) for v in row)))))
    s = _c(seq)
    missing = F.raise_error(F.lit("unknown residue")).cast("array<double>")
    rows = F.transform(F.split(s, ""), lambda r: F.coalesce(F.try_element_at(table, r), missing))
    return F.when(F.length(s) == 0, F.array().cast("array<double>")).otherwise(F.flatten(rows))


def rounded_distance(similarity: Column | str, length: Column | int) -> Column:
    """Distance from a normalised similarity of equal-length values; half goes to even."""
    return F.rint((F.lit(1.0) - _c(similarity)) * length).cast("int")


def render_interval(point: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", _c(point), _c(low), _c(high))


def label_encode(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes from 0 by sorted value, through a table of the distinct values numbered by ranges; rows without a value go."""
    values = ordering.numbered(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, out=out)
    return df.join(values.withColumn(out, F.col(out).cast("int")), column)


def derangement(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, shifted): the sorted distinct values moved on by one, cyclically; fewer than two raise. Values are numbered by ranges."""
    pairs = df.select(key, value).filter(F.col(value).isNotNull()).distinct()
    ring = ordering.numbered(pairs.select(value).distinct(), value, out="_at")
    n = ring.count()
    if n < 2:
        raise ValueError("a derangement needs at least two different values")
    after = ring.select(F.pmod(F.col("_at") - 1, F.lit(n)).alias("_at"), F.col(value).alias("shifted"))
    return pairs.join(ring.join(after, "_at"), value).select(key, value, "shifted")
