"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces start best-fit decreasing. While there are more bins than the total length asks for, underfull bins, the emptiest
first, give their pieces away: one moves into a gap, or one, or two, are swapped for one smaller piece of an underfull bin.
Each step moves length into a fuller bin, so the sum of squared fills rises and the search ends: when the bound is reached,
or when no underfull bin has a step left. An emptied bin goes.

Rows are dealt out evenly and without a key, so copies and hot sources don't matter. Each group of about GROUP_ROWS
pieces is packed by one task, which costs at most about one part-filled bin a group.

Defined results: a null text is empty and gives one piece (the separator alone); a very long text is cut into many pieces,
its ids held whole by its task; equal rows are packed each for itself; among equal lengths the earlier row of a group goes
first; an empty table gives an empty result; further columns are ignored by pack_documents() and kept by pack_rows(), where
columns named sequence_id or offset give way to those of the result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankloom.llm.common import pieces, ready, written
from rankloom.llm.tokens import encoder

GROUP_ROWS = 100_000
CAPACITY = 2048


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers, best fit in order of falling length."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = defaultdict(list)
    gaps = 0  # bit g is set while a bin has gap g
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fitting = gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap - size:
            by_gap[gap - size].append(b)
            gaps |= 1 << (gap - size)
    return bins


class _Search:
    """Bins as arrays over pieces; only underfull bins take part."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.sizes, self.capacity = bins, lengths.astype(np.int64), capacity
        self.gap = np.array([capacity - int(self.sizes[b].sum()) for b in bins], np.int64)
        self.of = np.zeros(len(lengths), np.int64)
        for n, b in enumerate(bins):
            self.of[b] = n
        self.open = np.flatnonzero(self.gap[self.of] > 0)  # pieces of underfull bins; some may have filled up since

    def donors(self) -> np.ndarray:
        """Underfull bins, the emptiest first."""
        self.open = self.open[self.gap[self.of[self.open]] > 0]
        under = np.unique(self.of[self.open])
        return under[np.argsort(-self.gap[under], kind="stable")]

    def step(self, donor: int) -> bool:
        """The move or swap out of `donor` that shifts most length into an underfull bin at least as full, if any does."""
        by_size: dict[int, list[int]] = defaultdict(list)  # pieces of one length are alike
        for i in self.bins[donor]:
            by_size[int(self.sizes[i])].append(i)
        mine = sorted(by_size)
        offers = [(s, (by_size[s][0],)) for s in mine]
        offers += [(s + t, (by_size[s][0], by_size[t][-1])) for n, s in enumerate(mine) for t in mine[n:] if s < t or len(by_size[s]) > 1]
        offers.sort()
        worth = np.array([s for s, _ in offers])
        at = self.open[(self.of[self.open] != donor) & (self.gap[self.of[self.open]] > 0) & (self.gap[self.of[self.open]] <= self.gap[donor])]
        if not len(at):
            return False
        bins = self.of[at]
        room = self.gap[bins]
        out = np.concatenate([np.zeros(len(at), np.int64), self.sizes[at]])  # nothing comes back, or that piece does
        k = np.searchsorted(worth, np.concatenate([room, room]) + out, "right") - 1
        gain = np.where(k >= 0, worth[np.maximum(k, 0)] - out, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            return False
        target, back = int(bins[best % len(at)]), int(at[best - len(at)]) if best >= len(at) else None
        for i in offers[k[best]][1]:
            self.bins[donor].remove(i)
            self.bins[target].append(i)
            self.of[i] = target
        if back is not None:
            self.bins[target].remove(back)
            self.bins[donor].append(back)
            self.of[back] = donor
        self.gap[donor] += gain[best]
        self.gap[target] -= gain[best]
        return True


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins while the total length would fit in fewer, until no underfull bin has a step left."""
    bound = -(-int(lengths.sum()) // capacity)
    left = len(bins)
    if left <= bound:
        return bins
    state = _Search([list(b) for b in bins], lengths, capacity)
    moved, stuck = True, set()  # contents of bins that had no step since the last one that was made
    while left > bound and moved:
        moved = False
        for donor in state.donors().tolist():
            content = tuple(sorted(state.sizes[state.bins[donor]].tolist()))
            if not content or content in stuck:
                continue
            while state.bins[donor] and state.step(donor):
                moved, stuck = True, set()
            if not state.bins[donor]:
                left -= 1
                if left <= bound:
                    break
            else:
                stuck.add(tuple(sorted(state.sizes[state.bins[donor]].tolist())))
    return [b for b in state.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut only beyond `capacity`."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in pieces(batches, "text"):
            flat, at = bpe.encode(batch.column("text"))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(flat[a:b], np.int32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, n, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * ids)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_rows(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows` (with a column length from 1 to capacity) with sequence_id and offset. `rows` should be a written table."""
    groups = max(1, -(-rows.count() // group_rows))
    added = ("sequence_id", "offset")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        lengths = whole.column("length").to_numpy().astype(np.int64)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 40
        for n, members in enumerate(pack(lengths, capacity)):
            sequence[members] = first + n
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        whole = whole.drop_columns([c for c in whole.column_names if c.lower() in added]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from whole.to_batches(max_chunksize=10_000)

    ready(rows.sparkSession)
    fields = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n.lower() not in added)
    return rows.repartition(groups).mapInArrow(group, f"{fields}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_rows(written(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
