"""Nearest-positive retrieval inside a group, and nearest-neighbour joins with bands.

Only distinct (group, sequence) queries meet distinct (group, sequence) entries, through an equi-join on the group, so AQE
can split a hot group; the best match is a plain aggregate with a partial step before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.sources.tables import checkpointed

Similarity = Callable[[Column, Column], Column]
FAR = 1_000_000


def database(train: DataFrame, group: str, seq: str, label: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """Distinct positive (group, entry) pairs; all pairs without a label column."""
    rows = train.filter(F.col(label).cast("int") == 1) if label else train
    return rows.select(group, F.col(seq).alias("entry"), *(extra or [])).distinct()


def nearest_positive(
    queries: DataFrame, entries: DataFrame, group: str, seq: str, similarity: Similarity = text.edit_similarity,
    default: float = 0.0, leave_out_exact: bool = False, top_k: int = 1, other_fold: str | None = None,
    query_vector: str | None = None, entry_vector: str | None = None,
) -> DataFrame:
    """`queries` with score, nearest, has_database and database_size.

    score: the largest similarity to an entry of the group (mean of the `top_k` largest, if more), `default` without one.
    Ties go to the smallest entry. leave_out_exact ignores similarities of 1 and more, but still counts their entries.
    other_fold: only entries of another value of that column count. Vectors, where named, are compared in place of text.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    keys = [group, seq, *([other_fold] if other_fold else [])]
    own = [*keys, *([query_vector] if query_vector else [])]
    distinct = queries.select(*own).dropDuplicates(keys)
    right = entries
    if other_fold:  # an entry counts once, however many folds hold it: it has another fold unless all of its own are the query's
        vectors = [F.first(entry_vector).alias(entry_vector)] if entry_vector else []
        right = entries.groupBy(group, "entry").agg(F.min(other_fold).alias("_low"), F.max(other_fold).alias("_high"), *vectors)
    if similarity is text.edit_similarity and not entry_vector:
        found = _nearest_texts(distinct, right, group, seq, other_fold, leave_out_exact, top_k)
        score = F.when(F.col("_used") == F.least(F.lit(top_k), F.col("_size")), F.col("_mean")).otherwise(-F.col("_best.d"))
        return _answered(queries, found, keys, score, default)
    right = right.withColumnRenamed(entry_vector, "_vector") if entry_vector else right
    pairs = distinct.join(right, group)
    if other_fold:
        pairs = pairs.filter((F.col(other_fold) != F.col("_low")) | (F.col(other_fold) != F.col("_high")))
    sim = similarity(F.col(query_vector or seq), F.col("_vector" if entry_vector else "entry"))
    pairs = pairs.select(*keys, "entry", sim.alias("sim"))
    usable = F.col("sim") < 1 if leave_out_exact else F.lit(True)
    best = F.min(F.when(usable, F.struct((-F.col("sim")).alias("d"), "entry")))
    found = pairs.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))
    score = -F.col("_best.d")
    if top_k > 1:  # a limit by group, which Spark applies within tasks before it shuffles
        order = Window.partitionBy(*keys).orderBy(F.desc("sim"))
        ranked = pairs.filter(usable).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top_k)
        found = found.join(ranked.groupBy(*keys).agg(F.avg("sim").alias("_mean"), F.count(F.lit(1)).alias("_used")), keys, "left")
        score = F.when(F.col("_used") == F.least(F.lit(top_k), F.col("_size")), F.col("_mean")).otherwise(score)
    return _answered(queries, found, keys, score, default)


def _answered(queries: DataFrame, found: DataFrame, keys: list[str], score: Column, default: float) -> DataFrame:
    return queries.join(found, keys, "left").select(
        *queries.columns,
        F.coalesce(score, F.lit(default)).alias("score"), F.coalesce(F.col("_best.entry"), F.lit("")).alias("nearest"),
        F.col("_size").isNotNull().alias("has_database"), F.coalesce("_size", F.lit(0)).cast("long").alias("database_size"),
    )


CELLS = 1 << 24  # distances that are held at once


def edit_distances(q: list[str], e: list[str]) -> np.ndarray:
    """Edit distance of each q from each e, cell by cell for many pairs of two lengths at once."""
    out = np.zeros((len(q), len(e)), np.int32)
    codes = lambda texts, n: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), n)
    by_length = lambda texts: {n: np.flatnonzero(np.array([len(t) for t in texts]) == n) for n in sorted({len(t) for t in texts})}
    columns_of = by_length(e)
    for m, rows in by_length(q).items():
        for n, columns in columns_of.items():
            r = min(len(rows), max(1, CELLS // (n + 1)))
            c = max(1, CELLS // ((n + 1) * r))
            for x in (rows[k : k + r] for k in range(0, len(rows), r)):
                for y in (columns[k : k + c] for k in range(0, len(columns), c)):
                    out[np.ix_(x, y)] = _distances(codes([q[i] for i in x], m), codes([e[i] for i in y], n))
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of code points, each side of one length."""
    m, n = a.shape[1], b.shape[1]
    kind = np.uint8 if max(m, n) < 255 else np.int32
    row = [np.full((len(a), len(b)), j, kind) for j in range(n + 1)]
    for i in range(m):
        corner, row[0] = row[0], np.full_like(row[0], i + 1)
        for j in range(n):
            above = row[j + 1]
            cell = np.minimum(corner + (a[:, i, None] != b[None, :, j]), np.minimum(above, row[j]) + kind(1))
            corner, row[j + 1] = above, cell
    return row[n]


MANY_PAIRS = 1 << 28  # pairs of texts from which on those one edit apart are looked up first
LONGEST = 32  # characters of texts that are looked up


def _nearest_texts(queries: DataFrame, entries: DataFrame, group: str, seq: str, fold: str | None, leave_out_exact: bool, top_k: int, block: int = 1024) -> DataFrame:
    """(keys, _best, _size, _mean, _used) by edit similarity. Of many pairs, what _one_edit() settles isn't compared in blocks."""
    if top_k == 1 and not leave_out_exact:
        sizes = queries.groupBy(group).agg(F.count(F.lit(1)).alias("_q")).join(entries.groupBy(group).agg(F.count(F.lit(1)).alias("_e")), group)
        if (sizes.agg(F.sum(F.col("_q").cast("double") * F.col("_e"))).first()[0] or 0) > MANY_PAIRS:
            near = checkpointed(_one_edit(queries, entries, group, seq, fold))
            rest = queries.join(near, [group, seq, *([fold] if fold else [])], "left_anti")
            return near.unionByName(_compared(rest, entries, group, seq, fold, leave_out_exact, top_k, block))
    return _compared(queries, entries, group, seq, fold, leave_out_exact, top_k, block)


def _one_edit(queries: DataFrame, entries: DataFrame, group: str, seq: str, fold: str | None) -> DataFrame:
    """(keys, _best, _size, _mean, _used) of queries whose nearest entry is equal or one edit away for certain.

    Texts one edit apart have in common one of themselves and what is left of them without one character. With d >= 2 edits
    the longer text has at most d characters more than a query of n, so its similarity is at most 1 - 2 / (n + 2); what is
    better than that can't be beaten or tied. A variant has at most as many texts as there are ways to put in a character.
    """
    parts = lambda c: F.array_distinct(F.expr(f"transform(sequence(0, length(`{c}`)), i -> case when i = 0 then `{c}` else concat(substring(`{c}`, 1, i - 1), substring(`{c}`, i + 1)) end)"))
    some = lambda df, c: df.filter(F.length(c) <= LONGEST).withColumn("_part", F.explode(parts(c)))
    counts = ~(F.col(fold).eqNullSafe(F.col("_low")) & F.col(fold).eqNullSafe(F.col("_high"))) if fold else F.lit(True)
    asked = queries.filter(F.col(fold).isNotNull()) if fold else queries
    keys = [group, seq, *([fold] if fold else [])]
    pairs = some(asked.select(*keys), seq).join(some(entries, "entry"), [group, "_part"]).filter(counts)
    longest = F.greatest(F.length(seq), F.length("entry"), F.lit(1))
    pairs = pairs.withColumn("_edits", F.levenshtein(F.col(seq), F.col("entry"), 1)).filter("_edits >= 0")
    sim = F.lit(1.0) - F.col("_edits").cast("double") / longest
    best = pairs.groupBy(*keys).agg(F.min(F.struct((-sim).alias("d"), "entry")).alias("_best"))
    sure = best.filter(-F.col("_best.d") > 1.0 - F.lit(2.0) / (F.length(seq) + 2) + 1e-9)
    counted = entries.filter(F.col(group).isNotNull() & F.col("entry").isNotNull())
    sized = sure.join(counted.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    size = F.col("_n")
    if fold:  # without the entries that the query's fold alone holds
        alone = counted.filter("_low = _high").groupBy(group, F.col("_low").alias(fold)).agg(F.count(F.lit(1)).alias("_own"))
        sized = sized.join(alone, [group, fold], "left")
        size = size - F.coalesce("_own", F.lit(0))
    return sized.select(*keys, "_best", size.alias("_size"), F.lit(1).alias("_used"), (-F.col("_best.d")).alias("_mean"))


def _compared(queries: DataFrame, entries: DataFrame, group: str, seq: str, fold: str | None, leave_out_exact: bool, top_k: int, block: int) -> DataFrame:
    """(keys, _best, _size, _mean, _used) by edit similarity: blocks of queries against blocks of entries of a group.

    No pair is a row of Spark's; of each query a block passes on its top_k best and the number of entries that count.
    """
    kinds = dict(queries.dtypes)
    sides = []
    for df, columns in ((queries, [F.col(seq).alias("t"), *([F.col(fold).alias("f")] if fold else [])]), (entries, [F.col("entry").alias("t"), *([F.col("_low"), F.col("_high")] if fold else [])])):
        own = df.select(group, *columns).filter(F.col(group).isNotNull() & F.col("t").isNotNull())
        sized = own.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_n"))
        dealt = own.join(sized, group).withColumn("_block", F.pmod(F.xxhash64("t"), F.col("_n")))
        sides.append(dealt.groupBy(group, "_block").agg(F.array_sort(F.collect_list(F.struct(*[c for c in own.columns if c != group]))).alias("rows")))
    pairs = sides[0].select(F.col(group).alias("g"), F.col("rows").alias("q")).join(sides[1].select(F.col(group).alias("g"), F.col("rows").alias("e")), "g")
    pairs = pairs.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("q", "e"))  # a hot group's blocks over all tasks
    names = ["g", "t", *(["f"] if fold else []), "entry", "sim", "size"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, e = (batch.column(c)[i].values for c in ("q", "e"))
                qt, et = q.field("t").to_pylist(), e.field("t").to_pylist()
                longest = np.maximum(np.array([len(x) for x in qt])[:, None], np.array([len(x) for x in et])[None, :])
                s = 1.0 - edit_distances(qt, et) / np.maximum(longest, 1)
                counts = np.ones(s.shape, bool)
                if fold:
                    f, low, high = (np.array(c.to_pylist(), object) for c in (q.field("f"), e.field("_low"), e.field("_high")))
                    counts = (f[:, None] != low[None, :]) | (f[:, None] != high[None, :])
                s = np.where(counts & ((s < 1) if leave_out_exact else True), s, -np.inf)
                best = np.argsort(-s, axis=1, kind="stable")[:, :top_k] if top_k > 1 else s.argmax(1)[:, None]  # entries are in order: ties to the smallest
                at, name = np.repeat(np.arange(len(qt)), best.shape[1]), best.ravel()
                value, head = s[at, name], np.tile(np.arange(best.shape[1]) == 0, len(qt))
                size = np.where(head, counts.sum(1)[at], 0)
                ok = np.isfinite(value)
                some = ok | (size > 0)
                take = lambda c, k: c.take(pa.array(k[some]))
                columns = [pa.array([batch.column("g")[i].as_py()] * int(some.sum()), batch.column("g").type), take(q.field("t"), at), *([take(q.field("f"), at)] if fold else []), take(e.field("t"), name)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(ok, value, 0.0)[some], mask=~ok[some]), pa.array(size[some], pa.int64())], names)

    found = pairs.mapInArrow(compare, f"g {kinds[group]}, t {kinds[seq]}, {f'f {kinds[fold]}, ' if fold else ''}entry string, sim double, size long")
    found = found.withColumnsRenamed({"g": group, "t": seq, **({"f": fold} if fold else {})})
    keys = [group, seq, *([fold] if fold else [])]
    best = F.min(F.when(F.col("sim").isNotNull(), F.struct((-F.col("sim")).alias("d"), "entry"))).alias("_best")
    top = F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, top_k)  # top_k of each block of entries
    per = found.groupBy(*keys).agg(best, F.sum("size").alias("_size"), top.alias("_top"))
    return per.select(*keys, "_best", "_size", F.size("_top").alias("_used"), F.when(F.size("_top") > 0, F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top")).alias("_mean")).filter("_size > 0")


def nearest_vectors(queries: DataFrame, entries: DataFrame, group: str, key: str, query_vector: str, entry_vector: str, top_k: int = 1, block: int = 2048) -> DataFrame:
    """`queries` with score, nearest, has_database and database_size, by cosine and as blocked matrix products.

    Queries and entries of a group are dealt into blocks of about `block` rows; a task multiplies one block of either side,
    so a hot group is many tasks and no pair of rows is a row of Spark's. Of each query a block passes on its top_k best.
    Similarities are compared to 12 places; ties go to the smallest entry; a zero vector has no similarity. (group, key) is
    unique among the queries, (group, entry) among the entries; score is the mean of the top_k, or the best if there are fewer.
    """
    kind, entry_kind = dict(queries.dtypes)[key], dict(entries.dtypes)["entry"]
    group_kind = dict(queries.dtypes)[group]
    sides = []
    for df, name, vector in ((queries, key, query_vector), (entries, "entry", entry_vector)):
        own = df.select(group, F.col(name).alias("name"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter(F.col(group).isNotNull() & F.col("v").isNotNull())
        blocks = own.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_n"))
        dealt = own.join(blocks, group).withColumn("_block", F.pmod(F.xxhash64("name"), F.col("_n")))
        sides.append(dealt.groupBy(group, "_block").agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("rows")))
    pairs = sides[0].select(group, F.col("rows").alias("q")).join(sides[1].select(group, F.col("rows").alias("e")), group)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda rows: (lambda m: m / np.sqrt((m * m).sum(1, keepdims=True)))(rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        for batch in batches:
            for i in range(batch.num_rows):
                q, e = (batch.column(c)[i].values for c in ("q", "e"))
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.round(unit(q) @ unit(e).T, 12)
                s = np.where(np.isnan(s), -np.inf, s)
                best = np.argsort(-s, axis=1, kind="stable")[:, :top_k] if top_k > 1 else s.argmax(1)[:, None]  # entries are in order, so the first of equals is the smallest
                at, name = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                score = s[at, name]
                ok = np.isfinite(score)
                head = np.r_[True, at[1:] != at[:-1]]  # one row of each query carries the number of entries
                some = ok | head
                take = lambda c, k: c.field("name").take(pa.array(k[some]))
                groups = pa.array([batch.column("g")[i].as_py()] * int(some.sum()), batch.column("g").type)
                yield pa.RecordBatch.from_arrays([groups, take(q, at), take(e, name), pa.array(np.where(ok, score, 0.0)[some], mask=~ok[some]), pa.array(np.where(head, len(e), 0)[some], pa.int64())], ["g", "name", "entry", "sim", "size"])

    found = pairs.withColumnRenamed(group, "g").mapInArrow(multiply, f"g {group_kind}, name {kind}, entry {entry_kind}, sim double, size long")
    aggs = [F.min(F.when(F.col("sim").isNotNull(), F.struct((-F.col("sim")).alias("d"), "entry"))).alias("_best"), F.sum("size").alias("_size")]
    if top_k > 1:
        aggs.append(F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, top_k).alias("_top"))  # top_k of each block
    per = found.groupBy(F.col("g").alias(group), F.col("name").alias(key)).agg(*aggs)
    score = -F.col("_best.d")
    if top_k > 1:
        score = F.when(F.size("_top") == F.least(F.lit(top_k), F.col("_size")), F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top")).otherwise(score)
    return queries.join(per, [group, key], "left").select(
        *queries.columns, F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(F.col("_best.entry").cast("string"), F.lit("")).alias("nearest"),
        F.col("_size").isNotNull().alias("has_database"), F.coalesce("_size", F.lit(0)).cast("long").alias("database_size"),
    )


def exact_match_mask(test: DataFrame, train: DataFrame, group: str, seq: str, label: str | None = None) -> DataFrame:
    """`test` with `exact`: the pair is a training pair (a positive one, where there is a label)."""
    known = database(train, group, seq, label).select(group, F.col("entry").alias(seq), F.lit(True).alias("_hit"))
    return test.join(known, [group, seq], "left").withColumn("exact", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seen_mask(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    known = train.select(key).distinct().withColumn("_hit", F.lit(True))
    return test.join(known, key, "left").withColumn("seen", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _pieces(text: str, length: str, k: int) -> str:
    """SQL of the k + 1 nearly equal pieces of a text of that length: array of (i, begin, size)."""
    return f"transform(sequence(0, {k}), i -> named_struct('i', i, 'begin', cast(i * {length} div {k + 1} as int), 'size', cast((i + 1) * {length} div {k + 1} - i * {length} div {k + 1} as int)))"


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(a, b, distance) of distinct texts of either side that are at most k edits apart, through a segment index.

    Of the k + 1 pieces of b, k edits leave one intact, and a holds it moved by no more than the edits before it: a piece i
    moves by at most i places, and by at most k - i counted from the other end. So a is looked up by these few substrings
    under (length of b, piece, its text). Texts of k letters or fewer have empty pieces and meet all texts of near length.
    """
    if k < 0:
        raise ValueError("edits can't be negative")
    q = left.select(F.col(a).alias("a")).filter("a is not null").distinct().withColumn("m", F.length("a"))
    e = right.select(F.col(b).alias("b")).filter("b is not null").distinct().withColumn("l", F.length("b"))
    keyed = e.withColumn("p", F.explode(F.expr(_pieces("b", "l", k)))).select("b", "l", "p.i", F.expr("substring(b, p.begin + 1, p.size)").alias("piece"))
    lengths = q.withColumn("l", F.explode(F.sequence(F.greatest(F.col("m") - k, F.lit(0)), F.col("m") + k)))
    asked = lengths.withColumn("p", F.explode(F.expr(_pieces("a", "l", k)))).select("a", "m", "l", "p.*")
    low, high = f"greatest(-i, m - l - ({k} - i))", f"least(i, m - l + ({k} - i))"
    moved = asked.filter(f"{low} <= {high}").withColumn("s", F.explode(F.expr(f"sequence({low}, {high})"))).filter("begin + s >= 0 and begin + s + size <= m")
    looked = moved.select("a", "l", "i", F.expr("substring(a, begin + s + 1, size)").alias("piece")).distinct()
    pairs = looked.join(keyed, ["l", "i", "piece"]).select("a", "b").distinct()
    found = pairs.withColumn("distance", text.edit_distance("a", "b", k)).filter(F.col("distance").between(0, k))
    return found.select(F.col("a").alias(a), F.col("b").alias(b), "distance") if a != b else found


def nearest_levenshtein(queries: DataFrame, entries: DataFrame, seq: str, band: int) -> DataFrame:
    """(seq, distance): distance to the nearest entry, band + 1 where none is within `band`."""
    q = queries.select(seq).distinct()
    best = within_edits(q, entries.select(F.col(seq).alias("_entry")), seq, "_entry", band).groupBy(seq).agg(F.min("distance").alias("distance"))
    return q.join(best, seq, "left").select(seq, F.coalesce("distance", F.lit(band + 1)).cast("int").alias("distance"))


RADII = (1, 3, 7)


def nearest_hamming(queries: DataFrame, entries: DataFrame, seq: str, radii: tuple[int, ...] = RADII) -> DataFrame:
    """(seq, distance): places that differ from the nearest entry of the same length, FAR where there is none.

    For each radius r, a match within r leaves one of r + 1 pieces intact at its place, so texts meet by (length, piece, text);
    a query that finds an entry within r is done, as all entries so near were met. What is left after the last radius meets
    all entries of its length.
    """
    q, e = queries.select(seq).distinct(), entries.select(F.col(seq).alias("entry")).filter("entry is not null").distinct()
    left, e = q.withColumn("l", F.length(seq)), e.withColumn("l", F.length("entry"))
    done = []
    for r in radii:
        cut = lambda df, c: df.withColumn("p", F.explode(F.expr(_pieces(c, "l", r)))).select(c, "l", "p.i", F.expr(f"substring(`{c}`, p.begin + 1, p.size)").alias("piece"))  # noqa: E731, B023
        pairs = cut(left, seq).join(cut(e, "entry"), ["l", "i", "piece"])
        near = pairs.groupBy(seq).agg(F.min(text.hamming(F.col(seq), F.col("entry"))).alias("distance")).filter(F.col("distance") <= r)
        near = checkpointed(near)
        done.append(near)
        left = checkpointed(left.join(near, seq, "left_anti"))
    rest = left.join(e, "l").groupBy(seq).agg(F.min(text.hamming(F.col(seq), F.col("entry"))).alias("distance"))
    for near in done:
        rest = rest.unionByName(near)
    return q.join(rest, seq, "left").select(seq, F.coalesce("distance", F.lit(FAR)).alias("distance"))


def nearest_training_distance(queries: DataFrame, entries: DataFrame, seq: str) -> DataFrame:
    """(seq, distance): 1 - largest edit similarity to any entry, null where there is no entry or no text.

    Texts of either side meet in blocks, as in nearest_positive(), so either may be of any size.
    """
    q = queries.select(seq).distinct()
    side = lambda df, name: df.select(F.lit(0).alias("_all"), F.col(seq).alias(name))
    found = _nearest_texts(side(q, seq), side(entries, "entry").distinct(), "_all", seq, None, False, 1)
    return q.join(found.select(seq, (1 + F.col("_best.d")).alias("distance")), seq, "left")


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, if it has no more than `rows` rows; else an error. For sides that go to every task."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows can't go to every task")
    return df


def neighbour_ranks(names: DataFrame, name: str, k: int) -> DataFrame:
    """(name, other, distance, rank): the k names nearest to each by (edit distance, name). Names are distinct keys, few enough to meet all."""
    n = bounded(names.select(F.col(name).alias("name")).filter("name is not null").distinct())
    pairs = n.join(F.broadcast(n.select(F.col("name").alias("other")))).filter("name <> other").withColumn("distance", text.edit_distance("name", "other"))
    order = Window.partitionBy("name").orderBy("distance", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("name", "other", "distance", "rank")


def radius_masks(distances: DataFrame, seq: str, distance: str, radii: list[int]) -> DataFrame:
    """A boolean column keep_r for each radius: farther than r from every training sequence."""
    return distances.select(seq, distance, *((F.col(distance) > r).alias(f"keep_{r}") for r in radii))


def removal_summary(rows: DataFrame, seq: str, masks: list[str]) -> DataFrame:
    """(regime, rows_kept, rows_removed, seqs_removed, pct_rows_removed, pct_seqs_removed)."""
    long = rows.select(seq, F.explode(F.array(*(F.struct(F.lit(m).alias("regime"), F.col(m).alias("keep")) for m in masks))).alias("r")).select(seq, "r.*")
    per = long.groupBy("regime", seq).agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"))
    return per.groupBy("regime").agg(
        F.sum("kept").cast("long").alias("rows_kept"), F.sum(F.col("n") - F.col("kept")).cast("long").alias("rows_removed"),
        F.count_if(F.col("kept") < F.col("n")).alias("seqs_removed"),
        (100.0 * F.sum(F.col("n") - F.col("kept")) / F.sum("n")).alias("pct_rows_removed"),
        (100.0 * F.count_if(F.col("kept") < F.col("n")) / F.count(F.lit(1))).alias("pct_seqs_removed"),
    )


def surviving_support(rows: DataFrame, group: str, seq: str, label: str, masks: list[str], least: int = 1) -> DataFrame:
    """What each regime leaves of each group: (regime, group, n_before, n_after, seqs_before, seqs_after, pos_after, neg_after, scorable, below).

    scorable: both classes are left. below: fewer than `least` rows of either class are left. A mask that is null removes its row.
    Sequences are counted once a group by a first grouping on (regime, group, sequence), so no group's sequences meet in one task.
    """
    long = rows.select(group, seq, label, F.explode(F.array(*(F.struct(F.lit(m).alias("regime"), F.coalesce(F.col(m), F.lit(False)).alias("keep")) for m in masks))).alias("r")).select(group, seq, label, "r.*")
    kept = lambda y: F.count_if(F.col("keep") & (F.col(label) == y))
    per = long.groupBy("regime", group, seq).agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("k"), kept(1).alias("p"), kept(0).alias("m"))
    out = per.groupBy("regime", group).agg(
        F.sum("n").alias("n_before"), F.sum("k").alias("n_after"), F.count(seq).alias("seqs_before"), F.count_if((F.col("k") > 0) & F.col(seq).isNotNull()).alias("seqs_after"),
        F.sum("p").alias("pos_after"), F.sum("m").alias("neg_after"),
    )
    fewest = F.least("pos_after", "neg_after")
    return out.withColumns({"scorable": fewest > 0, "below": fewest < least})


def nearest_source(target: DataFrame, sources: DataFrame, name: str, sequence: str, length: int) -> DataFrame:
    """(target, source, distance): the source nearest by normalised Hamming distance, then by name; a target among the sources is an error."""
    from rankloom.operators.checks import require_none

    require_none(target.join(sources, name, "left_semi").select(name), "targets among the sources")
    s = bounded(sources.select(F.col(name).alias("source"), F.col(sequence).alias("_seq")))
    distance = text.hamming(F.col(sequence), F.col("_seq")).cast("double") / length
    best = target.join(F.broadcast(s)).groupBy(name).agg(F.min(F.struct(distance.alias("distance"), "source")).alias("b"))
    return best.select(F.col(name).alias("target"), "b.source", "b.distance")


def row_dot(rows: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str = "vec") -> DataFrame:
    """`rows` with score: inner product of the two projected vectors of each row; a missing vector is an error."""
    from rankloom.functions import vector as V
    from rankloom.operators.checks import require_none

    a = left.select(left_key, F.col(vector).alias("_a"))
    b = right.select(right_key, F.col(vector).alias("_b"))
    for key, side in ((left_key, a), (right_key, b)):
        require_none(rows.select(key).distinct().join(side, key, "left_anti"), f"no vector for {key}", show=3)
    return rows.join(a, left_key).join(b, right_key).withColumn("score", V.dot("_a", "_b")).select(*rows.columns, "score")
