"""Bootstrap over rows, groups or both, of macro and pooled metrics, without an evaluation table on the driver.

Rows are put in order of (group, row_id) by ranges, and alike rows (label, scores and masks all equal) are one cell: a piece
of up to PIECE consecutive rows of a group is its cells and a code of one or two bytes a row. Replicates come in chunks, and
only pieces travel to (group, chunk), where a replicate draws as many places as the group has rows, with replacement and in
order of row_id, once for each time the group itself was drawn, and counts the cells they fall on. From one pass come the sums
of the three metrics by replicate and arm, for macro values, and, where asked for, the drawn counts by score, whose merger
over groups gives pooled metrics of the same draws. Pooled rows are streams in order of score, one for each arm and chunk,
so no task holds all scores.

Arms share the draws of a group where their masks keep the same of its rows. Where they don't, the arms draw from their own
rows, each for itself (own_rows), or all select from one draw of all rows (the default), as regimes of one table do.

Every draw is a function of (seed, group, replicate) and the group's size alone, so a repeated task draws the same, and so
does a call with other arms. The number of rows, groups and replicates has no bound; a task holds one group's label and
scores in numpy, and a large group is spread over its chunks.

Defined results: rows without a group take no part; a group of one class has no metric in a replicate and is left out of its
mean; a replicate without any scorable group is null; an empty table raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.tables import checkpointed, drop

CHUNK, PIECE = 50, 1 << 16  # replicates of a task, rows of a piece
MEASURED = 1 << 16  # blocks of scores measured at once
METRICS = ("auroc", "ap", "auc01")


def block_metrics(p: np.ndarray, n: np.ndarray, fpr: float = 0.1) -> np.ndarray:
    """(draws, 3): auroc, ap, auc01 of counts of positives and negatives (draws, blocks of falling score); NaN for one class."""
    tp, fp = np.cumsum(p, axis=1), np.cumsum(n, axis=1)
    pos, neg = tp[:, -1:], fp[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        t1, f1 = tp / pos, fp / neg
        t0, f0 = t1 - p / pos, f1 - n / neg
        area = (f1 - f0) * (t0 + t1) / 2
        part = np.where(f1 <= fpr, area, np.where(f0 < fpr, (fpr - f0) * (2 * t0 + (t1 - t0) * (fpr - f0) / (f1 - f0)) / 2, 0.0))
        ap = np.where(tp + fp > 0, p / pos * tp / (tp + fp), 0.0)
        low = fpr * fpr / 2
        out = np.stack([area.sum(1), ap.sum(1), 0.5 * (1 + (part.sum(1) - low) / (fpr - low))], 1)
    out[(pos[:, 0] <= 0) | (neg[:, 0] <= 0)] = np.nan
    return out


def evaluation_rows(rows: DataFrame, group: str, label: str, arms: list[str], row_id: str, masks: dict[str, str] | None = None) -> DataFrame:
    """(g, i, y, s0, s1 ..., m0, m1 ...) of the rows that some arm keeps."""
    masks = masks or {}
    keep = [(F.coalesce(F.col(masks[a]).cast("boolean"), F.lit(False)) if a in masks else F.lit(True)).alias(f"m{i}") for i, a in enumerate(arms)]
    scores = [F.col(f"`{a}`").cast("double").alias(f"s{i}") for i, a in enumerate(arms)]
    own = rows.filter(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(row_id).alias("i"), F.col(label).cast("int").alias("y"), *scores, *keep)
    return own.filter(" or ".join(f"m{i}" for i in range(len(arms))))


def cells(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each row, equal for rows that are equal in all columns, and the first row of each code."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = pd.factorize(c, use_na_sentinel=False)[0]
        code = pd.factorize(code * (int(own.max()) + 1) + own)[0]
    first = np.empty(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def narrow(code: np.ndarray, size: int) -> np.ndarray:
    return code.astype("<u1" if size <= 1 << 8 else "<u2" if size <= 1 << 16 else "<u4")


def runs(batches: Iterator[pa.RecordBatch], by: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows that are equal in `by`, as one table, or cut in tables of `most` rows."""
    kept: pa.Table | None = None

    def cut(part: pa.Table, last: bool) -> Iterator[pa.Table]:
        size = most or max(part.num_rows, 1)
        for at in range(0, part.num_rows if last else part.num_rows - size + 1, size):
            yield part.slice(at, size)

    for batch in batches:
        new = pa.Table.from_batches([batch])
        kept = new if kept is None else pa.concat_tables([kept, new])
        if not kept.num_rows:
            continue
        keys = [kept.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in by]
        edge = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield from cut(kept.slice(a, b - a), True)
        kept = kept.slice(edge[-1])
        if most and kept.num_rows >= most:
            yield from cut(kept, False)
            kept = kept.slice(kept.num_rows - kept.num_rows % most)
    if kept is not None and kept.num_rows:
        yield from cut(kept, True)


def pieces(table: DataFrame, arms: int) -> DataFrame:
    """Written table of (g, part, seq, code, y, s0 ..., m0 ..., has): consecutive rows of a group in order of (i, all columns).

    code: the cell of each row among the piece's; y, s and m: label, scores and masks of its cells; has: which classes each
    arm keeps, 2 * arm + label.
    """
    columns = ["y", *(f"s{i}" for i in range(arms)), *(f"m{i}" for i in range(arms))]
    sizes = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.repartitionByRange(sizes, "g", "i").sortWithinPartitions("g", "i", *columns).select("g", *columns)
    kinds = dict.fromkeys(columns, "<f8") | {"y": "<i4"} | {f"m{i}": "?" for i in range(arms)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for seq, part in enumerate(runs(batches, ["g"], PIECE)):
            own = {c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(kinds[c]) for c in columns}
            code, first = cells(list(own.values()))
            held = {c: v[first] for c, v in own.items()}
            has = [2 * i + v for i in range(arms) for v in (0, 1) if (held[f"m{i}"] & (held["y"] == v)).any()]
            body = [narrow(code, len(first)), *held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("g")[0].as_py()]), pa.array([place], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in body), pa.array([has], pa.list_(pa.int32()))],
                ["g", "part", "seq", "code", *columns, "has"])

    return checkpointed(dealt.mapInArrow(pack, "g string, part int, seq int, code binary, " + ", ".join(f"{c} binary" for c in columns) + ", has array<int>"))


def scorable(packed: DataFrame, arms: int) -> DataFrame:
    """(g) of the groups that have both classes under every arm's mask."""
    return packed.groupBy("g").agg(F.size(F.array_distinct(F.flatten(F.collect_list("has")))).alias("n")).filter(f"n = {2 * arms}").select("g")


def group_times(groups: DataFrame, n: int, mode: str, seed: int) -> DataFrame:
    """(g, chunk, r, t): how often each replicate drew a group. Groups are numbered in order of name."""
    spark = groups.sparkSession
    if mode == "rows":
        drawn = groups.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(1))
        return drawn.select("g", F.floor(F.col("r") / CHUNK).cast("int").alias("chunk"), F.col("r").cast("int").alias("r"), "t")
    numbered = checkpointed(groups.withColumn("i", F.row_number().over(Window.orderBy("g")) - 1))  # names only, one a group
    count = numbered.count()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                gen = np.random.Generator(np.random.Philox(key=np.array([seed, r], np.uint64)))
                i, t = np.unique(gen.integers(0, count, count), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.full(len(i), r), pa.int32()), pa.array(t, pa.int32())], ["i", "r", "t"])

    replicates = spark.range(0, n, 1, max(1, min(n, 2 * spark.sparkContext.defaultParallelism)))
    times = replicates.mapInArrow(draw, "i int, r int, t int")
    return times.join(numbered, "i").select("g", F.floor(F.col("r") / CHUNK).cast("int").alias("chunk"), "r", "t")


class _Group:
    """One group's rows as codes of cells, and the metrics of draws from them."""

    def __init__(self, code: np.ndarray, y: np.ndarray, scores: list[np.ndarray], masks: list[np.ndarray]):
        self.code, self.y, self.masks = code, y, masks
        self.same = all((m == masks[0]).all() for m in masks)
        self.arms = []
        for s in scores:
            order = np.argsort(-s, kind="stable")
            first = np.flatnonzero(np.r_[True, s[order[1:]] != s[order[:-1]]])
            self.arms.append((order, first, s[order[first]]))

    def draw(self, gen: np.random.Generator, code: np.ndarray) -> np.ndarray:
        """How often each cell is drawn, by as many draws as there are codes; the generator goes on from block to block."""
        n, out = len(code), np.zeros(len(self.y), np.int64)
        block, kind = max(PIECE, len(out)), np.uint32 if n < 1 << 32 else np.uint64  # the same places in either
        for at in range(0, n, block):
            out += np.bincount(code.take(gen.integers(0, n, min(block, n - at), dtype=kind), mode="clip"), minlength=len(out))
        return out

    def counts(self, arm: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drawn positives and negatives by block of falling score."""
        order, first, _ = self.arms[arm]
        w = (w * self.masks[arm])[order]
        p = w * self.y[order]
        return np.add.reduceat(p, first), np.add.reduceat(w - p, first)


def samples(
    rows: DataFrame, group: str, label: str, arms: list[str], row_id: str, n: int, mode: str = "both", seed: int = 0, masks: dict[str, str] | None = None,
    every_group: bool = False, own_rows: bool = False, pooled: bool = False,
) -> DataFrame:
    """Written table of (r, arm, auroc, ap, auc01, scored) sums over a group's draws, and with `pooled` of (arm, chunk, s, p, n) counts.

    Groups that some arm can't score are drawn only with every_group.
    """
    if mode not in ("rows", "groups", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    source = checkpointed(evaluation_rows(rows, group, label, arms, row_id, masks))
    width = len(arms)
    packed = pieces(source, width)
    drop(source)
    groups = packed.select("g").distinct() if every_group else scorable(packed, width)
    if groups.isEmpty():
        raise ValueError("no rows to draw" if every_group else "no group that all arms can score")
    table = packed.drop("has") if every_group else packed.drop("has").join(groups, "g", "left_semi")
    times = group_times(groups, n, mode, seed)
    columns = [c for c in table.columns if c != "g"]
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))).alias("chunk")
    none = lambda c: F.lit(None).cast(dict(table.dtypes)[c]).alias(c)
    drawn = times.select("g", "chunk", F.lit(0).alias("kind"), "r", "t", *(none(c) for c in columns))
    held = table.select("g", chunks, F.lit(1).alias("kind"), F.lit(0).alias("r"), F.lit(0).alias("t"), *columns)
    sizes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = drawn.unionByName(held).repartition(sizes, "g", "chunk").sortWithinPartitions("g", "chunk", "kind", "r", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["g", "chunk"]):
            yield from one(part)

    def unpacked(body: pa.Table) -> _Group:
        take = lambda c, kind: [np.frombuffer(x, kind) for x in body.column(c).to_pylist()]
        ys = take("y", "<i4")
        own = [np.concatenate(x) for x in (ys, *(take(f"s{i}", "<f8") for i in range(width)), *(take(f"m{i}", "?") for i in range(width)))]
        code, first = cells(own)
        codes, at = [], 0
        for raw, y in zip(body.column("code").to_pylist(), ys, strict=True):
            codes.append(narrow(code[at : at + len(y)], len(first))[np.frombuffer(raw, narrow(np.zeros(0), len(y)).dtype)])
            at += len(y)
        own = [x[first] for x in own]
        return _Group(np.concatenate(codes), own[0].astype(np.int64), own[1 : width + 1], own[width + 1 :])

    def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = part.column("kind").to_numpy()
        edge = int((kind == 0).sum())
        if not edge or edge == len(kind):
            return
        name, chunk = part.column("g")[0].as_py(), part.column("chunk")[0].as_py()
        own = unpacked(part.slice(edge))
        r, t = part.column("r").to_numpy()[:edge], part.column("t").to_numpy()[:edge]
        kept = [own.code[m[own.code]] for m in own.masks] if own_rows and not own.same else []
        sums = np.zeros((len(r), width, 4))
        merged = [np.zeros((2, len(arm[2]), CHUNK), np.int32) for arm in own.arms] if pooled else []
        waiting: list[tuple[int, list]] = []  # draws counted but not measured: place of the replicate, counts by arm

        def measure() -> None:
            at = np.array([k for k, _ in waiting])
            for i in range(width):
                both = np.stack([c[i] for _, c in waiting], 1)
                m = block_metrics(*both)
                ok = np.isfinite(m[:, 0])
                np.add.at(sums[:, i], at[ok], np.column_stack([m[ok], np.ones(int(ok.sum()))]))
                if pooled:
                    for k in np.unique(at):
                        merged[i][:, :, r[k] % CHUNK] += both[:, at == k].sum(1).astype(np.int32)
            waiting.clear()

        most = max(1, MEASURED // max(len(arm[2]) for arm in own.arms))
        for place, (number, times_) in enumerate(zip(r.tolist(), t.tolist(), strict=True)):
            gen = np.random.Generator(np.random.Philox(key=np.array([zlib.crc32(name.encode()) << 32 | (seed & 0xFFFFFFFF), number], np.uint64)))
            for _ in range(times_):
                if mode == "groups":
                    w = [np.bincount(own.code, minlength=len(own.y))] * width
                elif kept:
                    w = [own.draw(gen, k) for k in kept]
                else:
                    w = [own.draw(gen, own.code)] * width
                waiting.append((place, [np.stack(own.counts(i, w[i])) for i in range(width)]))
                if len(waiting) >= most:
                    measure()
        if waiting:
            measure()
        found = [(number, i, *sums[place, i].tolist()) for place, number in enumerate(r.tolist()) for i in range(width)]
        cols = list(zip(*found, strict=True))
        m = len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:6]), *(pa.nulls(m, k) for k in (pa.int32(), pa.float64(), pa.binary(), pa.binary()))], _NAMES)
        for i in range(len(merged)):
            s = own.arms[i][2]
            m = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.array(np.full(m, i), pa.int32()), *(pa.nulls(m, pa.float64()) for _ in range(4)), pa.array(np.full(m, chunk), pa.int32()), pa.array(s), *(pa.array([x.tobytes() for x in merged[i][k]], pa.binary()) for k in (0, 1))], _NAMES)

    out = checkpointed(dealt.mapInArrow(run, _SCHEMA))
    drop(packed)
    return out


_SCHEMA = "r int, arm int, auroc double, ap double, auc01 double, scored double, chunk int, s double, p binary, n binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def macro_samples(table: DataFrame, arms: list[str]) -> DataFrame:
    """(replicate, arm, auroc, ap, auc01): means over a replicate's scorable draws; null without any."""
    sums = table.filter("r is not null").groupBy("r", "arm").agg(*(F.sum(m).alias(m) for m in METRICS), F.sum("scored").alias("scored"))
    names = F.array(*map(F.lit, arms))
    return sums.select(F.col("r").cast("long").alias("replicate"), F.element_at(names, F.col("arm") + 1).alias("arm"), *(F.when(F.col("scored") > 0, F.col(m) / F.col("scored")).alias(m) for m in METRICS))


def pooled_samples(table: DataFrame, arms: list[str], n: int) -> DataFrame:
    """(replicate, arm, auroc, ap) over all drawn rows of a replicate; null where they are of one class."""
    sizes = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.filter("s is not null").select("arm", "chunk", "s", "p", "n").repartition(sizes, "arm", "chunk").sortWithinPartitions("arm", "chunk", F.desc("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, score = None, None

        def finish() -> pa.RecordBatch:
            t, f, x, y = add(waiting_p[None], waiting_n[None], tp, fp, area, ap)
            with np.errstate(divide="ignore", invalid="ignore"):
                x, y, ok = x / (t * f), y / t, (t > 0) & (f > 0)
            r = key[1] * CHUNK + np.arange(CHUNK)
            ok, inside = ok[r < n], r < n
            return pa.RecordBatch.from_arrays([pa.array(r[inside], pa.int64()), pa.array(np.full(inside.sum(), key[0]), pa.int32()), *(pa.array(np.where(ok, v[inside], 0.0), mask=~ok) for v in (x, y))], ["r", "arm", "auroc", "ap"])

        for batch in batches:
            arm, chunk, s = (batch.column(c).to_numpy() for c in ("arm", "chunk", "s"))
            counts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, CHUNK) for c in ("p", "n")]
            edge = np.flatnonzero(np.r_[True, (arm[1:] != arm[:-1]) | (chunk[1:] != chunk[:-1])])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(s)], strict=True):
                if key != (arm[a], chunk[a]):
                    if key is not None:
                        yield finish()
                    key, score = (arm[a], chunk[a]), None
                    tp = fp = waiting_p = waiting_n = np.zeros(CHUNK)
                    area = ap = np.zeros(CHUNK)
                first = np.flatnonzero(np.r_[True, s[a + 1 : b] != s[a : b - 1]])
                p, q = (np.add.reduceat(c[a:b], first, axis=0).astype(float) for c in counts)
                if score == s[a]:  # the block before goes on
                    p[0] += waiting_p
                    q[0] += waiting_n
                elif score is not None:
                    p, q, first = np.r_[waiting_p[None], p], np.r_[waiting_n[None], q], np.r_[0, first]
                waiting_p, waiting_n, score = p[-1], q[-1], s[b - 1]
                tp, fp, area, ap = add(p[:-1], q[:-1], tp, fp, area, ap)

        if key is not None:
            yield finish()

    def add(p: np.ndarray, q: np.ndarray, tp: np.ndarray, fp: np.ndarray, area: np.ndarray, ap: np.ndarray) -> tuple[np.ndarray, ...]:
        t, f = tp + np.cumsum(p, axis=0), fp + np.cumsum(q, axis=0)
        if len(p):
            area = area + (q * (t - p / 2)).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                ap = ap + np.where(t + f > 0, p * t / (t + f), 0.0).sum(0)
            tp, fp = t[-1], f[-1]
        return tp, fp, area, ap

    names = F.array(*map(F.lit, arms))
    found = dealt.mapInArrow(run, "r long, arm int, auroc double, ap double")
    return found.select(F.col("r").alias("replicate"), F.element_at(names, F.col("arm") + 1).alias("arm"), "auroc", "ap")
