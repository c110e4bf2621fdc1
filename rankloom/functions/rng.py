"""Order-free random numbers: a hash of (seed, stream, keys), the same on every engine that has md5."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(*keys: object) -> Column:
    """Uniform in (0, 1). Plain values are literals; pass Columns for row keys."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10)
    return (head.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def unit_sql(*keys: str) -> str:
    """The same number in DuckDB; every key is a SQL expression."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)"


def position(n: int, *keys: object) -> Column:
    """Draw with replacement from 0 to n-1 on 52 random bits, so that it stays even for tables of billions of rows."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10)
    return F.least(F.floor(head.cast("double") / F.lit(float(2**52)) * F.lit(float(n))).cast("long"), F.lit(n - 1).cast("long"))


def position_sql(n: str, *keys: str) -> str:
    """The same number in DuckDB; n and every key are SQL expressions."""
    return f"least(cast(floor(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::BIGINT / {float(2**52)!r}::double * ({n})::double) as bigint), ({n}) - 1)"


def gumbel(weight: Column, u: Column) -> Column:
    """Sort key of weighted sampling without replacement: the k largest keys are the sample."""
    return F.log(weight.cast("double")) - F.log(-F.log(u))


def bounded_int(u: Column, n: Column | int) -> Column:
    """Draw with replacement from 0 to n-1."""
    return F.floor(u * n).cast("long")


def slots(seed: int, replicate: int, count: int, first: int, end: int) -> np.ndarray:
    """Positions that the slots first to end - 1 of a replicate draw from 0 to count - 1.

    Slot k draws bounded_int(unit(seed, "group", replicate, k), count).
    """
    start = hashlib.md5(f"{seed}|group|{replicate}|".encode())
    raw = bytearray()
    for k in range(first, end):
        h = start.copy()
        h.update(b"%d" % k)
        raw += h.digest()[:4]
    return np.floor((np.frombuffer(raw, ">u4") + 0.5) / 4294967296.0 * count).astype(np.int64)
