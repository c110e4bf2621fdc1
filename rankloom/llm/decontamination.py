"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment judges them.

Words are runs of letters and digits in lower case. Every SEED-word run of a benchmark item is a seed. The hits of one item
in one document are grouped into passages: a hit further than the item's length from the one before starts another. Every
passage, be it of one common seed, is aligned with the item, word by word (match 2, mismatch and gap -1), unless an upper
bound of its score shows that it can't reach THRESHOLD; so how far an item has leaked doesn't matter. The score is the
alignment's share of the best possible one, so edited copies lose only what was changed. From THRESHOLD on the document
counts as contaminated.

Seeds meet in a join. A benchmark of at most BLOCK_BYTES of text is collected and looked up within the tasks, so the corpus
is not shuffled. A larger one stays distributed: its seeds are a table, a Bloom filter of fixed size (FILTER_BITS) is all
that is broadcast, the hits that pass it are joined with the seeds, and each document with a hit travels once to the items
it shares a seed with, at most about ITEMS_A_ROW of them a row. Both ways read the corpus a fixed number of times and give
the same matches. All seeds count, rare or not: leaving out common ones would lose the copies of widely leaked items.

Defined results: null or empty texts match nothing; items of fewer than LEAST_WORDS words match nothing; a very long text is
aligned passage by passage, with memory of a small multiple of its bytes; equal scores go to the smallest item_id, equal
alignments to the first; repeated rows of a doc_id share a result; an empty benchmark leaves all documents clean; an empty
table gives an empty result; further columns are ignored by matches() and report(), kept by drop_contaminated(), whatever
their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BASES, Words, mix, pieces, ready, signed, written

SEED, LEAST_WORDS, THRESHOLD = 3, 5, 0.4
BLOCK_BYTES = 16 << 20
FILTER_BITS, ITEMS_A_ROW = 27, 10_000
SOME = 1 << 19  # hits, or words of passages, looked at together; one document's, or one passage's, are never parted


class Items:
    """One block of benchmark items, as word hashes, with an index from seed to items."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        rows = sorted(set(rows))
        text = Words(pa.array([r[1] for r in rows], pa.large_string()), plain=True)
        self.seed = seed
        self.text, self.at = text.hashes, text.first
        self.words = [text.hashes[a:b] for a, b in zip(text.first[:-1].tolist(), text.first[1:].tolist(), strict=True)]
        self.ids = [r[0] for r in rows]
        grams, at = text.grams(seed)
        item = text.doc[at]
        fits = np.array([len(w) >= LEAST_WORDS for w in self.words] or [False])[item]
        pairs = np.unique(np.stack([grams[fits], item[fits].astype(np.uint64)], 1), axis=0)
        self.seeds, first = np.unique(pairs[:, 0], return_index=True)
        self.items, self.first = pairs[:, 1].astype(np.int64), np.r_[first, len(pairs)]

    def hits(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, seed number) of each seed in the texts."""
        grams, at = text.grams(self.seed)
        if not len(self.seeds):
            return at[:0], at[:0]
        n = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = self.seeds[n] == grams
        return at[hit], n[hit]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment, and the place in the passage where it ends."""
    ramp = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + ramp) - ramp, 0)
        at = int(np.argmax(row))
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _parts(size: np.ndarray, most: int = SOME) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes sum to about `most`; a larger entry comes alone."""
    total, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def _flat(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, index) of every place of the spans that begin at `start` and are `n` long."""
    span = np.repeat(np.arange(len(n)), n)
    return span, np.arange(len(span)) + (start - np.cumsum(n) + n)[span]


def passages(items: Items, text: Words, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first word, end) of the passages around the hits, words counted through the batch."""
    hit, place = _flat(items.first[seed], items.first[seed + 1] - items.first[seed])
    item, at = items.items[place], at[hit]
    order = np.lexsort((at, item, text.doc[at]))
    item, at = item[order], at[order]
    doc, length = text.doc[at], np.diff(items.at)[item]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[1:])]
    a, b = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    return doc[a], item[a], np.maximum(text.first[doc[a]], at[a] - length[a]), np.minimum(text.first[doc[a] + 1], at[b] + length[a])


def _best_run(match: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Largest sum of a run, of 2 a match and -1 a miss, for each span; none is empty."""
    first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
    total = np.cumsum(np.where(match, 2, -1))
    far = span * (4 * len(span) + 4)  # keeps the least sum so far from passing into the next span
    before = np.r_[0, total[:-1]]
    return np.maximum.reduceat(total - (np.minimum.accumulate(before - far) + far), first)


def bounds(items: Items, text: Words, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No alignment of item and passage scores more: a word that the other side lacks costs 1, any other gives 2 at most."""
    own, place = _flat(items.at[item], items.at[item + 1] - items.at[item])
    there, other = _flat(low, high - low)
    key = lambda word, span: mix(word + span.astype(np.uint64) * np.uint64(BASES[1]))
    a, b = key(items.text[place], own), key(text.hashes[other], there)
    inside = np.isin(b, a, kind="sort")
    return np.minimum(_best_run(np.isin(a, b[inside], kind="sort"), own), _best_run(inside, there))


@functools.lru_cache(1)
def _items(rows: tuple[tuple[int, str], ...], seed: int) -> Items:
    return Items(list(rows), seed)


def _found(batch: pa.RecordBatch, items: Items, threshold: float) -> dict[int, list[tuple[int, float, int, int]]]:
    """(item, score, first word, end) of the matches by row of the batch."""
    text = Words(batch.column("text"), plain=True)
    at, seed = items.hits(text)
    best: dict[tuple[int, int], tuple[int, float, int, int]] = {}
    size = np.bincount(text.doc[at], items.first[seed + 1] - items.first[seed], minlength=batch.num_rows)
    for d, e in _parts(size):
        a, b = np.searchsorted(at, [text.first[d], text.first[e]])
        if a == b:
            continue
        doc, item, low, high = passages(items, text, at[a:b], seed[a:b])
        length = np.diff(items.at)[item]
        for i, j in _parts(high - low + length):
            may = i + np.flatnonzero(bounds(items, text, item[i:j], low[i:j], high[i:j]) / (2 * length[i:j]) >= threshold)
            for d, k, x, y in zip(*(c[may].tolist() for c in (doc, item, low, high)), strict=True):
                own, words = items.words[k], text.hashes[x:y]
                points, end = align(own, words)
                score = points / (2 * len(own))
                if score >= threshold and score > best.get((d, k), (0, 0.0, 0, 0))[1]:
                    back = align(own[::-1], words[:end][::-1])[1]
                    begin = x - int(text.first[d])
                    best[d, k] = (items.ids[k], score, begin + end - back, begin + end)
    out: dict[int, list[tuple[int, float, int, int]]] = {}
    for (d, _), m in best.items():
        out.setdefault(d, []).append(m)
    return out


_MATCH = "doc_id long, item_id long, score double, first int, end int"
_NAMES = ["doc_id", "item_id", "score", "first", "end"]
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]


def _sound(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def _small(items: DataFrame) -> tuple[tuple[int, str], ...] | None:
    """The items themselves if they have at most BLOCK_BYTES of text."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > BLOCK_BYTES:
        return None
    return tuple((r[0], r[1]) for r in items.collect())


def item_seeds(items: DataFrame, seed: int = SEED) -> DataFrame:
    """(seed, item_id) of the items long enough."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text = Words(batch.column("text"), plain=True)
            grams, at = text.grams(seed)
            item = text.doc[at]
            fits = np.diff(text.first)[item] >= LEAST_WORDS
            ids = batch.column("item_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams[fits])), pa.array(ids[item[fits]])], ["seed", "item_id"])

    return items.mapInArrow(cut, "seed long, item_id long").distinct()


def bloom(seeds: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where the leading bits of a seed point; equal or fewer rows than words of the filter reach the driver."""
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    word = seeds.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    found = word.toPandas()
    out = np.zeros(max(1, (1 << FILTER_BITS) // 64), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _pairs(keyed: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """(key, item_id) of the documents and items that share a seed. `keyed`: key, text."""
    seeds = written(item_seeds(items, seed), "seeds")
    filter_ = keyed.sparkSession.sparkContext.broadcast(bloom(seeds))
    shift = np.uint64(64 - FILTER_BITS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in pieces(batches, "text"):
            text = Words(batch.column("text"), plain=True)
            grams, at = text.grams(seed)
            place = grams >> shift
            hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            doc, gram = text.doc[at[hit]], grams[hit]
            both = np.unique(np.stack([doc.astype(np.uint64), gram], 1), axis=0)
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[both[:, 0].astype(np.int64)]), pa.array(signed(np.ascontiguousarray(both[:, 1])))], ["key", "seed"])

    return keyed.mapInArrow(cut, "key long, seed long").join(seeds, "seed").select("key", "item_id").distinct()


def _joined(docs: DataFrame, items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """matches() with the key of the document's row, for a benchmark too large to send to every task."""
    items = written(items, "items")
    keyed = docs.select(_key(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    salts = max(1, -(-items.count() // ITEMS_A_ROW))
    asked = _pairs(keyed.select("key", "text"), items, seed).join(items, "item_id")
    asked = asked.groupBy("key", F.pmod(F.xxhash64("item_id"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    together = keyed.distinct().join(asked.drop("salt"), "key").select("key", "doc_id", "text", "items")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, (key, doc, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "items")), strict=True)):
                some = Items([(i["item_id"], i["text"]) for i in own], seed)
                for found in _found(batch.slice(n, 1), some, threshold).values():
                    rows += [(key, doc, *m) for m in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *_KINDS], strict=True)], ["key", *_NAMES])

    return together.mapInArrow(find, f"key long, {_MATCH}")


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"]).alias("key")


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first, end) of every contaminated passage's best alignment, words counted from 0."""
    ready(docs.sparkSession)
    items = _sound(benchmark)
    rows = _small(items)
    if rows is None:
        return _joined(docs, items, seed, threshold).drop("key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _items(rows, seed)
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[d], *m) for d, ms in _found(batch, own, threshold).items() for m in ms]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(find, _MATCH)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated (0/1), item_id and score of the best match (null if clean), n_items, for every document."""
    best = F.max(F.struct("score", (-F.col("item_id")).alias("i")))
    found = matches(docs, benchmark).groupBy("doc_id").agg(best.alias("best"), F.countDistinct("item_id").alias("n_items"))
    joined = docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left").select(docs["doc_id"], "best", "n_items")
    return joined.select("doc_id", F.col("best").isNotNull().cast("int").alias("contaminated"), (-F.col("best.i")).alias("item_id"), F.col("best.score").alias("score"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the contaminated rows."""
    ready(docs.sparkSession)
    items = _sound(benchmark)
    rows = _small(items)
    if rows is None:
        gone = _joined(docs, items, seed, threshold).select("key").distinct()
        return docs.join(gone, _key(docs) == gone["key"], "left_anti")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _items(rows, seed)
        for batch in pieces(batches, "text"):
            stays = np.ones(batch.num_rows, bool)
            stays[list(_found(batch, own, threshold))] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)


__all__ = ["Items", "align", "drop_contaminated", "matches", "report"]
