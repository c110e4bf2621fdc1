"""Hilbert-curve ordering: quantise several metadata dimensions, sort by curve index, cut the order into even runs.

Rows near each other on the curve are near in every dimension, so each run covers a small box and a reader with a
predicate on any of the dimensions can leave most files unread. A value's cell is the share of rows before the middle of
its own rows, times the number of cells: few values are spread over the whole range, many are cut into equal parts, and
texts are ranked by all their bytes. The order is global and total; runs differ by one row at most.

Defined results: a null dimension falls in cell 0; a null text has no bytes and CRC 0; a very long text counts by its
length and checksum only; rows with equal curve index and ties (a null first) take neighbouring places in any order; an
empty table gives an empty result. Columns of the input are kept whatever their names; one that is named like a column of
the result gives way to it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import parts, written

BITS = 5


@functools.cache
def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for state * 2**dims + corner; a state is (entry corner, direction)."""
    corners = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & (corners - 1)

    def ones_at_end(x: int) -> int:
        n = 0
        while x >> n & 1:
            n += 1
        return n

    digit, following = [], []
    for entry in range(corners):
        for way in range(dims):
            for corner in range(corners):
                seen = turn(corner ^ entry, way + 1)
                w, shift = seen, seen >> 1
                while shift:
                    w, shift = w ^ shift, shift >> 1
                even = 0 if w == 0 else 2 * ((w - 1) // 2)
                start = even ^ (even >> 1)
                step = 0 if w == 0 else ones_at_end(w - 1 if w % 2 == 0 else w) % dims
                new_entry = entry ^ turn(start, dims - (way + 1) % dims)
                digit.append(w)
                following.append(new_entry * dims + (way + step + 1) % dims)
    return digit, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of integer cell numbers from 0 to 2**bits - 1."""
    dims = len(cells)
    digit, following = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    corner = lambda level: functools.reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.call_function("shiftleft", F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)), F.lit(i)) for i, c in enumerate(cells)],
    )

    def step(acc: Column, level: Column) -> Column:
        at = acc["state"] * F.lit(1 << dims) + corner(level) + F.lit(1)
        return F.struct(
            F.element_at(following, at).alias("state"),
            (acc["index"] * F.lit(1 << dims) + F.element_at(digit, at)).cast("long").alias("index"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["index"])


def cell_starts(df: DataFrame, dim: str, bits: int = BITS) -> list[tuple[object, int]]:
    """(smallest value, cell) of each cell that the dimension's values fall in, in order: 2**bits pairs at most.

    Values are counted by group, the distinct ones sorted over all partitions, and each partition adds up its own.
    """
    counts = df.select(F.col(dim).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange(parts(df), "v").withColumn("p", F.spark_partition_id()), "values")
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("p").agg(F.sum("n")).collect())  # a row for each partition
    total, before = sum(n for _, n in sums), {}
    for i, (p, _) in enumerate(sums):
        before[p] = sum(n for _, n in sums[:i])
    if not total:
        return []
    starts = df.sparkSession.createDataFrame(list(before.items()), "p int, start long")
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("start") + F.col("upto") - F.col("n") / 2
    cells = ranged.withColumn("upto", upto).join(F.broadcast(starts), "p").select("v", F.floor(middle / total * (1 << bits)).cast("int").alias("c"))
    return sorted(((r["v"], r["c"]) for r in cells.groupBy("c").agg(F.min("v").alias("v")).collect()), key=lambda x: x[1])


def cell(value: Column, starts: list[tuple[object, int]], kind: str) -> Column:
    """The cell whose smallest value is the last at or below the value; 0 for null."""
    if not starts:
        return F.lit(0)
    cuts = F.array(*(F.lit(v).cast(kind) for v, _ in starts))
    at = F.size(F.filter(cuts, lambda c: c <= value))
    return F.coalesce(F.element_at(F.array(*(F.lit(c) for _, c in starts)), F.greatest(at, F.lit(1))), F.lit(0))


def hilbert_order(df: DataFrame, dims: list[str], ties: list[str], bits: int = BITS) -> DataFrame:
    """`df` with curve_index and the global place of each row (from 0) along the curve, ties by the named columns."""
    return _flat(_ordered(df, dims, ties, bits)[0], curve_index=F.col("curve"), place=F.col("place"))


def _flat(rows: DataFrame, **more: Column) -> DataFrame:
    """The columns of the struct `row`, less those named like one of the further ones, and these."""
    own = [f"row.`{c}`" for c in rows.schema["row"].dataType.names if c.lower() not in more]
    return rows.select(*own, *(c.alias(n) for n, c in more.items()))


def _ordered(df: DataFrame, dims: list[str], ties: list[str], bits: int) -> tuple[DataFrame, int]:
    """(row, curve, place) and the number of rows.

    The named columns are read to count their values; then one range-partitioned sort. Each partition numbers its own
    rows; the driver gets one count per partition.
    """
    kinds = dict(df.dtypes)
    cells = [cell(F.col(d), cell_starts(df, d, bits), kinds[d]) for d in dims]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), hilbert_index(cells, bits).alias("curve"))
    keys = ["curve", *(F.col(f"row.`{t}`") for t in ties)]
    numbered = rows.repartitionByRange(parts(df), *keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    numbered = written(numbered, "curve")
    part = F.shiftrightunsigned("id", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(part).count().collect())  # a row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offset = df.sparkSession.createDataFrame(starts, "p int, start long")
    placed = numbered.withColumn("p", part).join(F.broadcast(offset), "p")
    return placed.select("row", "curve", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")), total


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = 16, bits: int = BITS) -> DataFrame:
    """`df` with curve_index, shard (0 to shards-1, counts at most one apart) and slot (place in the shard).

    Shard s holds the places from ceil(s*n/shards) on.
    """
    ordered, n = _ordered(df, dims, ties, bits)
    shard = F.expr(f"(place * {shards}) div {max(n, 1)}")
    slot = F.col("place") - F.expr(f"(((place * {shards}) div {max(n, 1)}) * {n} + {shards - 1}) div {shards}")
    return _flat(ordered, curve_index=F.col("curve"), shard=shard.cast("int"), slot=slot)


def write_shards(sharded: DataFrame, path: str, shards: int = 16) -> None:
    """Sorted Parquet files under `path/shard=s`: runs of (shard, slot), so that one shard is the work of several tasks."""
    sharded.repartitionByRange(parts(sharded, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value of each dimension by shard, for pruning."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, laid along lang, source and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "meta")
    out = hilbert_shards(slim, ["lang", "source", "size"], ["text_crc32", "size", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index", "lang", "source")


__all__ = ["cell_starts", "hilbert_index", "hilbert_order", "hilbert_shards", "manifest", "shard_documents", "write_shards"]
