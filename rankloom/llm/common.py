"""Shared pieces: tables written to the shared folder, Arrow batches as numpy, word and shingle hashes.

Every hash below is 64 bits wide and a pure function of the bytes, so a lost task recomputes the same rows.
"""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
_own_dirs: dict[str, str] = {}
_cleaned: list[str] = []
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

#: The six ASCII white-space bytes: space, tab, line feed, vertical tab, form feed, carriage return.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.array([_LOWER[c] if c > 127 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed on them."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))
    return spark


def is_local(master: str) -> bool:
    """True where driver and executors are one process, so that any folder is shared."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
            atexit.register(_remove, _own_dirs[app])
        found = _own_dirs[app]
    return f"{found.rstrip('/')}/rankloom-{app}"


def _remove(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    folder, _, last = name.rpartition("/")
    return f"{shared_dir(spark)}/{folder}{'/' if folder else ''}{uuid.uuid4().hex[:12]}-{last}"


def _drop_tables() -> None:
    """Delete the intermediate tables of this application, if its session is still there at exit."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _delete(spark, f"{shared_dir(spark)}/tables")


def _delete(spark: SparkSession, url: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and no reader repeats the work above.

    Such tables go when the driver ends.
    """
    path = new_path(df.sparkSession, f"tables/{name}")
    if not _cleaned:
        _cleaned.append(path)
        atexit.register(_drop_tables)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes not to meet a column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for a keyed shuffle: the session's own number, which the cluster sizes to its input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            if n > 4 * CHUNK_BYTES:  # one very long text: don't hold on to so much
                return _powers(self.base, n), _powers(self.inverse, n)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def powers(which: int) -> Powers:
    return Powers(BASES[which])


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal spans hash alike wherever they stand."""
    up, down = powers(which).get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `most` bytes of text; a longer text comes alone, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of a batch of texts: runs of bytes that hold none of the six ASCII white-space characters."""

    def __init__(self, column: pa.Array, lower: bool = False, plain: bool = False):
        """lower: A-Z count as a-z. plain: all letters in lower case, and other ASCII signs than letters and digits part words."""
        data, self.text_at = utf8(pc.utf8_lower(column) if plain else column)
        self.data = data = _PLAIN[data] if plain else _LOWER[data] if lower else data
        n = len(data)
        inside = ~_WHITE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.text_at] = True
        edge[n] = True
        before = np.ones(n, bool)
        if n:
            before[1:] = ~inside[:-1]
            self.start = np.flatnonzero(inside & (before | edge[:-1]))
            after = np.ones(n, bool)
            after[:-1] = ~inside[1:]
            self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: first word of each text, and the number of all words at the end
        self.first = np.searchsorted(self.start, self.text_at)
        self.first[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, 0)

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run of n words inside one text, index of its first word)."""
        at = np.arange(max(0, len(self) - n + 1))
        at = at[at + n <= self.first[1:][self.doc[at]]] if len(at) else at
        return span_hash(self.hashes, at, at + n, 1), at

    def join(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
