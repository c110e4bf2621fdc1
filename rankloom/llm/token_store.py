"""Token ids in files of patched frame-of-reference blocks, in ascending doc_id order.

A file holds the ids of a range of documents one after another, in blocks of BLOCK ids. A block keeps its smallest id, the
other ids as differences of `width` bits, and the places and high bits of those that need more (exceptions). The width is
the one, out of those that cover given percentiles of the block's ids, which makes the block smallest. The footer has the
place of every block, and the id and number of ids of every document, so any document is read by its blocks alone.

    file     blocks, footer, the footer's place (8 bytes), MAGIC
    block    base u32, ids u16, exceptions u16, width u8; packed bits; exceptions' places u16, their high bits u32
    footer   blocks u64, documents u64; block places u64; document ids i64; whether each has an id u8; numbers of ids i64

Numbers are little-endian. Documents are range-partitioned and sorted as texts and encoded afterwards, so ids are never
shuffled. Every attempt of a task writes a file of its own name; the manifest, a written table of one row a file, names
one attempt of each, and files that it doesn't name are deleted. Readers take runs of ids of a file, not whole files.

Defined results: a null text is empty and has the end id alone; a very long text is encoded whole by its task; documents
without an id come first; rows that share a doc_id follow each other in the order of a hash of their texts, and each is
stored; an empty table gives no file and an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.bytebpe import byte_encoder
from rankloom.llm.common import new_path, parts, pieces, ready, written
from rankloom.llm.warc import _drop_unnamed, _open

BLOCK, END = 4096, 2
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
RUN = 1 << 22  # ids that a reader takes at once from a file
READ = 1 << 19  # ids that it decodes at once, unless one document has more
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IHHB")
_MANIFEST = "part int, file string, documents long, ids long, bytes long"


def _width(rest: np.ndarray, percentiles: tuple[float, ...]) -> int:
    """Bits for a block's differences."""
    bits = np.frexp(rest.astype(np.float64))[1]  # 0 for 0, else the place of the highest bit
    up_to = np.cumsum(np.bincount(bits, minlength=33))
    widths = np.unique(np.searchsorted(up_to, np.array(percentiles) * len(rest)))
    cost = (len(rest) * widths + 7) // 8 + 6 * (len(rest) - up_to[widths])
    return int(widths[cost.argmin()])


def pack(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> bytes:
    """One block of at most 65,535 ids, each below 2**32."""
    base = int(ids.min())
    rest = (ids.astype(np.int64) - base).astype("<u4")
    width = _width(rest, percentiles)
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    high = rest[odd] >> np.uint32(width) if len(odd) else rest[:0]
    return _HEAD.pack(base, len(ids), len(odd), width) + np.packbits(bits, bitorder="little").tobytes() + odd.astype("<u2").tobytes() + high.astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The ids of one block."""
    base, n, odd, width = _HEAD.unpack_from(block)
    at = _HEAD.size + (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(block, np.uint8, at - _HEAD.size, _HEAD.size), count=n * width, bitorder="little").reshape(n, width)
    out = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    if odd:
        places, high = np.frombuffer(block, "<u2", odd, at), np.frombuffer(block, "<u4", odd, at + 2 * odd)
        out[places] |= high << np.uint32(width)
    return out + np.uint32(base)


class Writer:
    """Lays documents one after another into a file."""

    def __init__(self, out: BinaryIO, block: int = BLOCK, percentiles: tuple[float, ...] = PERCENTILES):
        self.out, self.block, self.percentiles = out, block, percentiles
        self.waiting: list[np.ndarray] = []
        self.held, self.at = 0, 0
        self.places: list[int] = []
        self.names: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, names: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids in a row."""
        self.names.append(names.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        self.counts.append(counts.astype("<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, most: int) -> None:
        ids = np.concatenate(self.waiting)
        for a in range(0, most, self.block):
            raw = pack(ids[a : min(a + self.block, most)], self.percentiles)
            self.places.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.waiting, self.held = [ids[most:]], len(ids) - most

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file."""
        if self.held:
            self._flush(self.held)
        names, known, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.names, self.known, self.counts))
        footer = struct.pack("<QQ", len(self.places), len(names)) + np.array(self.places, "<u8").tobytes() + names.tobytes() + known.tobytes() + counts.tobytes()
        self.out.write(footer + struct.pack("<Q", self.at) + MAGIC)
        self.out.close()
        return len(names), int(counts.sum()), self.at + len(footer) + 16


class Reader:
    """Reads documents of one file by its block index. `file` is a pyarrow input file."""

    def __init__(self, file: pa.NativeFile):
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("no token file")
        self.file, (self.foot,) = file, struct.unpack("<Q", tail[:8])
        raw = file.read_at(size - 16 - self.foot, self.foot)
        blocks, documents = struct.unpack_from("<QQ", raw)
        at = 16
        self.places = np.r_[np.frombuffer(raw, "<u8", blocks, at).astype(np.int64), self.foot]
        at += 8 * blocks
        self.names = np.frombuffer(raw, "<i8", documents, at)
        self.known = np.frombuffer(raw, np.uint8, documents, at + 8 * documents).astype(bool)
        counts = np.frombuffer(raw, "<i8", documents, at + 9 * documents)
        #: place in the file of each document's first id, and the number of all ids at the end
        self.starts = np.r_[0, np.cumsum(counts)]
        self.block = _HEAD.unpack(file.read_at(_HEAD.size, 0))[1] if blocks else 1

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids at places first to end - 1 of the file."""
        if first == end:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-end // self.block)
        raw = self.file.read_at(int(self.places[b] - self.places[a]), int(self.places[a]))
        cuts = self.places[a : b + 1] - self.places[a]
        out = np.concatenate([unpack(raw[s:e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        return out[first - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, block: int = BLOCK) -> DataFrame:
    """Encode all texts and write them under `folder` (default: the shared folder), which is new; returns the manifest.

    The manifest has a row a file, in the order of `part`: file, documents, ids, bytes, and base, the ids of all files before.
    """
    spark = ready(docs.sparkSession)
    folder = folder or new_path(spark, "tokens")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_encoder(tokenizer), TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        writer: Writer | None = None
        for batch in pieces(batches, "text"):
            if writer is None:
                fs, root = _open(folder)
                fs.create_dir(root, recursive=True)
                writer = Writer(fs.open_output_stream(f"{root}/{name}", compression=None), block)
            ids, at = encoder.encode(batch.column("text"))
            names = batch.column("doc_id")
            known = names.is_valid().to_numpy(zero_copy_only=False)
            writer.add(names.fill_null(0).to_numpy(), known, np.diff(at) + 1, np.insert(ids, at[1:], end))
        if writer is not None:
            row = (task.partitionId(), name, *writer.close())
            yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _MANIFEST.split(", ")], row, strict=True))], pa.schema([("part", pa.int32()), ("file", pa.string()), *((x, pa.int64()) for x in ("documents", "ids", "bytes"))]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    ordered = own.repartitionByRange(parts(docs), "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(lay, _MANIFEST), "token-files")
    _drop_unnamed(folder, {r.file for r in manifest.select("file").collect()})  # a name for each task
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    return manifest.withColumns({"file": F.concat(F.lit(f"{folder}/"), "file"), "base": before})


def read_tokens(manifest: DataFrame, bodies: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files; ids as little-endian unsigned 32-bit integers."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != url:
                    url = row["file"]
                    fs, path = _open(url)
                    reader = Reader(fs.open_input_file(path))
                    if reader.starts[-1] != row["ids"]:
                        raise ValueError(f"{url} has {reader.starts[-1]} ids, its manifest says {row['ids']}")
                k, last = np.searchsorted(reader.starts[:-1], [row["first"], row["first"] + RUN]).tolist()
                while k < last:  # documents that start in this run
                    to = max(k + 1, min(last, int(np.searchsorted(reader.starts, reader.starts[k] + READ, "right")) - 1))
                    at = reader.starts[k : to + 1]
                    ids = reader.ids(int(at[0]), int(at[-1])).astype("<u4")
                    spans = [ids[s:e].tobytes() for s, e in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                    columns = [pa.array(reader.names[k:to], pa.int64(), mask=~reader.known[k:to]), pa.array(at[:-1] + row["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, pa.binary())] * bodies, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * bodies])
                    k = to

    runs = manifest.select("file", "ids", "base", F.explode(F.sequence(F.lit(0), F.col("ids") - 1, F.lit(RUN))).alias("first"))
    spread = runs.repartitionByRange(parts(manifest), "file", "first").sortWithinPartitions("file", "first")
    return spread.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * bodies)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write every document, read every document back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, tokenizer))
