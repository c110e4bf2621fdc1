"""Groups of spelling variants: pairs of words one edit apart, found through forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves a half of the word intact: of two such words, the longer with m code
points, common prefix and common suffix together have at least m - 1, so one of them has at least h = ceil((m - 1) / 2).
Every word is therefore listed by its first h code points (a forward dictionary, in which words with one prefix lie
together) and by its last h (a reversed one), once as the longer and once as the shorter word of a pair. Blocks of more
than BLOCK words are subdivided: what lies between the part that agrees and the other end has one edit as well, so again
one of its halves is intact. That goes on until a block is small or one place is left open, where a block can't hold more
words than there are letters. So blocks are bounded and no pair is lost. Blocks are then ranges of a range-partitioned
sorted table; a scan compares the rows of a block at growing distance, whole arrays at a time.

A pair is reported by one block only: the prefix side is taken where both halves are intact, and rows of the suffix side
carry the prefix length (`cap`) that their pairs must stay below.

Hot words cost nothing extra: occurrences are added up within a task first, then by word. Sizes of blocks come from a
partial aggregate, and rows meet them in a join that Spark splits where it is skewed.

Defined results: a null text has no runs; a null doc_id counts as an empty string in the hash of a run; a very long text is
read whole by its task; rows that repeat a doc_id count each for itself; a run made empty (one code point, deleted) is no
word; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_written, parts, pieces, ready, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO, ERROR = 6, 5, 5, 199
BLOCK = 128
HELD = 300_000  # distinct words that a task adds up before it passes them on
CELLS = 1 << 22  # bytes of words that are compared at once
_KEY = ["m", "a", "b", "cap", "head", "tail"]


def damaged(doc_id: int | None, text: str | None, error: int = ERROR) -> Counter[str]:
    """Lower-cased runs of one text with their numbers, after the deletions."""
    found = Counter(RUN.findall((text or "").encode().lower().decode()))  # bytes.lower() changes A-Z only
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: Counter[str] = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % error == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def dictionary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, error: int = ERROR) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for run, n in damaged(doc_id, text, error).items():
                    if len(run) >= least_length:
                        held[run] += n
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _half(places: Column) -> Column:
    return F.floor(places / 2).cast("int")  # ceil((places - 1) / 2)


def _listed(rows: DataFrame) -> DataFrame:
    """Rows with the key columns of their block."""
    return rows.withColumns({"head": F.left("word", F.col("a")), "tail": F.right("word", F.col("b"))})


def _entries(words: DataFrame) -> DataFrame:
    """Each word as the longer and as the shorter word of a pair, by its first and by its last half."""
    length = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    h = _half(F.col("m"))
    far = F.lit(2**31 - 1)
    sides = F.array(F.struct(h.alias("a"), F.lit(0).alias("b"), far.alias("cap")), F.struct(F.lit(0).alias("a"), h.alias("b"), h.alias("cap")))
    return _listed(sizes.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.*"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of large blocks, listed by either half of what is open in them."""
    h = _half(F.col("m") - F.col("a") - F.col("b"))
    sides = F.array(F.struct((F.col("a") + h).alias("a"), F.col("b"), F.col("cap")), F.struct(F.col("a"), (F.col("b") + h).alias("b"), F.least("cap", F.col("a") + h).alias("cap")))
    return _listed(rows.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.*").filter("a < cap"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, m, a, b, cap, head, tail) of all blocks that can hold a pair, none of more than `most` words that could be divided."""
    done: list[DataFrame] = []
    rows = _entries(words)
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), F.max(F.length("word")).alias("longest")).filter("size > 1 and longest = m").drop("longest")
        sized = written(rows.join(sizes, _KEY), "blocks")
        large = (F.col("size") > most) & (F.col("m") - F.col("a") - F.col("b") > 1)
        done.append(sized.filter(~large).drop("size"))
        if sized.filter(large).isEmpty():
            break
        rows = _divided(sized.filter(large).drop("size"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compared(codes: list[bytes], m: int, block: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of each pair one edit apart; all words have m or m - 1 code points, block is sorted."""
    n = len(codes)
    left, right = (np.frombuffer(b"".join(getattr(c, side)(m, b"\0") for c in codes), np.uint8).reshape(n, m) for side in ("ljust", "rjust"))
    size = np.array([len(c) for c in codes])
    first, second = [], []
    rows, step = np.arange(n), 1
    while True:
        rows = rows[rows + step < n]
        rows = rows[block[rows] == block[rows + step]]
        if not len(rows):
            break
        i, j = rows, rows + step
        step += 1
        longest = np.maximum(size[i], size[j]) == m
        i, j = i[longest], j[longest]
        differs = left[i] != left[j]
        prefix = differs.argmax(axis=1)  # words of a block differ, so there is a first place
        open_ = prefix < cap[i]
        i, j, prefix = i[open_], j[open_], prefix[open_]
        suffix = (right[i] != right[j])[:, ::-1].argmax(axis=1)
        near = prefix + suffix >= m - 1
        first.append(i[near])
        second.append(j[near])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(first or none), np.concatenate(second or none)


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, other, other_n) for each two words that differ by one inserted, deleted or replaced code point, both ways."""
    table = blocks(words, most)
    spread = table.repartitionByRange(parts(table), *_KEY).sortWithinPartitions(*_KEY, "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            edge = _starts(rows)
            yield from compare(rows.slice(0, edge[-1]), edge[:-1])
            kept = rows.slice(edge[-1])  # the last block may go on
        if kept is not None:
            yield from compare(kept, np.zeros(1, np.int64))

    def _starts(rows: pa.Table) -> np.ndarray:
        """First row of each block."""
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in _KEY:
            values = rows.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def compare(rows: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        names, n, m, cap = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("m").to_numpy(), rows.column("cap").to_numpy()
        block = np.zeros(rows.num_rows, np.int64)
        block[edge] = 1
        block = np.cumsum(block)
        ends = np.r_[edge[1:], rows.num_rows]
        a = 0
        while a < len(edge):  # whole blocks of one length, so many that their letters fit CELLS
            b = a + 1
            while b < len(edge) and m[edge[b]] == m[edge[a]] and (ends[b] - edge[a]) * int(m[edge[a]]) <= CELLS:
                b += 1
            lo, hi = int(edge[a]), int(ends[b - 1])
            i, j = _compared([w.encode("latin-1") for w in names[lo:hi]], int(m[lo]), block[lo:hi], cap[lo:hi])
            if len(i):
                both, other = np.r_[i, j] + lo, np.r_[j, i] + lo
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in both], pa.string()), pa.array([names[x] for x in other], pa.string()), pa.array(n[other], pa.int64())], ["word", "other", "other_n"])
            a = b

    return spread.mapInArrow(scan, "word string, other string, other_n long")


def forms(words: DataFrame, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n): the form is the near word of largest n, if that is at least ratio times the word's."""
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    joined = words.join(near, "word", "left")
    takes = -F.col("best.rank") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.rank")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """The rows with `root`, the last word that forms lead to. Each round doubles the steps; a chain has at most log_ratio(n) of them."""
    up = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(up.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(up)
        up = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, error: int = ERROR, most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the dictionary."""
    words = written(dictionary(docs, least_length, least_count, error), "words")
    found = written(forms(words, ratio, most), "forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


