"""Near-duplicates by min-max hashing: each permutation yields its minimum and its maximum, so half as many are needed.

A document is its set of distinct word shingles. Documents with one and the same set form a class, and only one document
a class goes on. Its signature is cut into bands of four values from four different permutations; classes that share a
band are compared. Every link is confirmed on the full sets of 64-bit shingle hashes.

In a band's group not all pairs are made. First each member meets the group's smallest one; that settles most. Where a
group's members still lie in several components, they are laid in blocks by set size, and blocks of comparable size are held
against each other when either has a member outside the group's largest component; groups of the same members count once.
A block holds at most BLOCK_MEMBERS sets and about BLOCK_SHINGLES hashes, so a task's memory is bounded however large the
group; all its pairs are counted exactly by one matrix product, and only edges that join components leave the task. So no
pair that shares a band is left untested unless it is already in one component, and no pair is tested that shares none but
those in one block. The work within a group whose members don't link grows with the square of that group. With the default
25 bands of four, two sets of similarity 0.8 share no band with probability 2e-6 (0.85: 8e-9).

Defined results: null or empty text, or white space alone, has an empty set and is linked with nothing; a text of fewer
words than a shingle counts as one shingle; a very long text is one row of its task, whose memory is a small multiple of its
bytes; repeated rows get the same answer each, and keep_one() keeps or drops them together; a null doc_id is linked with
nothing and kept; a component is named by its smallest doc_id, so there are no ties; an empty table gives an empty result;
further columns are ignored by near_duplicates() and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Words, mix, parts, pieces, ready, signed, span_hash, written
from rankloom.llm.components import components, merged

PERMUTATIONS, ROWS = 50, 4
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 18
COLUMNS = 2048


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in a row, and len+1 offsets."""
    text = Words(column, lower=True)
    count = np.diff(text.first)
    grams, _ = text.grams(words)
    n_grams = np.maximum(count - words + 1, 0)
    ends = np.cumsum(n_grams)
    short = np.flatnonzero((count > 0) & (count < words))
    whole = dict(zip(short.tolist(), span_hash(text.hashes, text.first[short], text.first[short + 1], 1), strict=True)) if len(short) else {}
    sets = []
    for i, (a, b) in enumerate(zip((ends - n_grams).tolist(), ends.tolist(), strict=True)):
        sets.append(np.unique(grams[a:b]) if b > a else np.array([whole[i]], np.uint64) if i in whole else np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.r_[0, np.cumsum(size)]


def min_max(values: np.ndarray, at: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum under each permutation of the sets values[at[i]:at[i+1]], none of them empty."""
    a, b = _permutations(permutations)
    low, high = (np.empty((len(at) - 1, permutations), np.uint64) for _ in range(2))
    for p in range(permutations):
        moved = values * a[p] + b[p]
        low[:, p], high[:, p] = np.minimum.reduceat(moved, at[:-1]), np.maximum.reduceat(moved, at[:-1])
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band: half its rows are minima, half are maxima of other permutations."""
    n, half = low.shape[1], rows // 2
    out = []
    for band in range(2 * n // rows):
        at = [(band * half + i) % n for i in range(2 * half)]
        key = np.full(len(low), band + 1, np.uint64)
        for values, i in [(low, i) for i in at[:half]] + [(high, i) for i in at[half:]]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
        out.append(key)
    return np.stack(out, 1) if out else np.zeros((len(low), 0), np.uint64)


def signatures(docs: DataFrame, words: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, bands): key_a and key_b name the set, bands is empty for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, at = shingle_sets(batch.column("text"), words)
            size = np.diff(at)
            full = np.flatnonzero(size)
            starts = np.r_[at[:-1][full], len(values)]
            keys = bands(*min_max(values, starts, permutations)) if len(full) else np.zeros((0, 0), np.uint64)
            width = keys.shape[1]
            offsets = np.r_[0, np.cumsum(np.where(size > 0, width, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size),
                    pa.array(signed(span_hash(values, at[:-1], at[1:], 0))),
                    pa.array(signed(span_hash(values, at[:-1], at[1:], 2))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.ascontiguousarray(keys).ravel()))),
                ],
                ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
            )

    ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, at = shingle_sets(batch.column("text"), words)
            body = [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(body, pa.binary())], ["rep", "shingles"])

    some = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return some.mapInArrow(cut, "rep long, shingles binary").dropDuplicates(["rep"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.withColumnsRenamed({"rep": r, "shingles": s}) for r, s in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(meet, "a long, b long")


def block_links(labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets that join different labels; no more than join them."""
    size = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone adds to no intersection
    column = np.cumsum(shared) - 1
    keep = shared[shingle]
    owner, shingle = owner[keep], column[shingle[keep]]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(shingle, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], shingle[a:b] - n * COLUMNS] = 1
        common += has @ has.T
    _, label = np.unique(labels, return_inverse=True)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    x, y = np.nonzero(np.triu(near & (label[:, None] != label[None, :]), 1))
    _, one = np.unique(np.minimum(label[x], label[y]) * len(sets) + np.maximum(label[x], label[y]), return_index=True)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(x[one].tolist(), y[one].tolist(), strict=True):
        a, b = find(label[i]), find(label[j])
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components, from rows (task, rep, label, shingles)."""

    def edges(held: list[tuple]) -> list[tuple[int, int]]:
        pairs = block_links([r[1] for r in held], [np.frombuffer(r[2], np.uint64) for r in held], percent)
        return [(held[i][0], held[j][0]) for i, j in pairs]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "rep", "label", "shingles")), strict=True):
                if t != task and held:
                    out += edges(held)
                    held = []
                task = t
                held.append(row)
            yield _pairs(out)
        if held:
            yield _pairs(edges(held))

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

    return rows.repartition(parts(rows), "task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long")


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """(task, rep, label): which blocks of groups that span several components meet. `members`: key, rep, n, label."""
    inside = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    spread = inside.groupBy("key").agg(F.sum("n").alias("size"), F.bit_xor("who").alias("who"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    spread = spread.filter("labels > 1 and size > 2").groupBy("size", "who").agg(F.min(F.struct("key", "top")).alias("one"))
    nodes = members.join(spread.select("one.key", F.col("one.top.label").alias("main")), "key")
    # two similar sets are in one size class or in neighbouring ones
    nodes = nodes.withColumn("rung", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    load = nodes.groupBy("key", "rung").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).alias("blocks"))
    nodes = nodes.join(load, ["key", "rung"])
    nodes = written(nodes.select("rep", "label", "key", "rung", (F.col("label") != F.col("main")).alias("minor"), F.expr("pmod(xxhash64(rep), blocks)").alias("block")), "nodes")
    blocks = nodes.groupBy("key", "rung", "block").agg(F.max("minor").alias("minor"))
    other = blocks.select("key", F.col("rung").alias("rung2"), F.col("block").alias("block2"), F.col("minor").alias("minor2"))
    met = blocks.withColumn("rung2", F.explode(F.array("rung", F.col("rung") + 1))).join(other, ["key", "rung2"])
    met = met.filter("(minor or minor2) and (rung2 > rung or block2 >= block)")
    sides = F.array_distinct(F.array(F.struct("rung", "block"), F.struct(F.col("rung2").alias("rung"), F.col("block2").alias("block"))))
    met = met.select("key", F.xxhash64("key", "rung", "block", "rung2", "block2").alias("task"), F.explode(sides).alias("side"))
    return met.select("task", "key", "side.rung", "side.block").join(nodes, ["key", "rung", "block"]).select("task", "rep", "label")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    signed_docs = written(signatures(docs, words, permutations), "signatures")
    able = signed_docs.filter("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    exploded = classes.select(F.explode("bands").alias("key"), F.struct("rep", F.col("n_shingles").alias("n")).alias("m"))
    centres = exploded.groupBy("key").agg(F.min("m").alias("c"), F.max("m").alias("last")).filter("c.rep < last.rep").select("key", "c")
    members = written(exploded.join(centres, "key"), "members")
    stars = members.filter("m.rep <> c.rep").select("c", "m").distinct()
    nodes = members.select("m.rep").distinct()
    sets = written(_sets(docs, nodes, words), "sets")

    fits = F.least("c.n", "m.n") * 100 >= F.greatest("c.n", "m.n") * percent
    labels = components(confirm(stars.filter(fits).select(F.col("c.rep").alias("a"), F.col("m.rep").alias("b")), sets, percent))
    members = members.select("key", "m.rep", "m.n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = written(members, "labelled")
    more = written(_block_links(_tasks(members, percent).join(sets, "rep"), percent), "links")
    labels = merged(labels, more)

    home = classes.select("key_a", "key_b", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    home = home.select("key_a", "key_b", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    linked = able.join(home, ["key_a", "key_b", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = signed_docs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the near copies: of each component the document with the smallest doc_id stays."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
