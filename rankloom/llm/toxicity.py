"""Toxicity by compression distance.

Three zstandard dictionaries are trained on labelled texts. The base one is trained on ordinary texts. The other two are
trained on what sets each class apart: of either class the stretches that no run of SHORT bytes covers which at least
`1 + documents // 1000` other ordinary texts hold; of the toxic class also those made up of runs of LONG bytes that recur in
LEAST_TEXTS toxic texts, or one in OFTEN, and in fewer ordinary ones than that bound. A text is lower-cased, its ASCII signs
become spaces, and overlapping windows of WINDOW bytes, STEP apart, are compressed twice, with base and ordinary and with
base and toxic dictionary. The two share their entropy tables and their size, so the lengths differ only by what the last
part explains. Labelled texts measured with dictionaries they had no part in calibrate the differences: each gets the ratio
of its frequency in toxic and ordinary texts, and thresholds on that ratio sort the windows into tiers. A document's score
is a logistic function of its windows by tier and of the bytes they save; where more than FALSE_SHARE of the ordinary
texts would score a half, its constant is lowered until they don't.

Matches are of LEAST_MATCH bytes at least, so a window without any such run of either class dictionary has the same
length under both; it is counted as difference 0 without being compressed.

The labelled sample is bounded: SAMPLE_TOXIC and SAMPLE_ORDINARY documents, those with the smallest hash of doc_id, are
learned from, in one task. Where a class has more, each of its sampled rows counts for as many labelled rows as it stands
for, so a score means the same whatever the size of the input. Scoring covers every window of every text.

Defined results: null or empty text, or one of signs only, scores as a text with one empty window; a very long text is
scored whole, its memory is a small multiple of its own bytes; repeated rows score alike; a score of exactly the threshold
counts as toxic; without labelled toxic and ordinary rows every score is 0; an empty table gives an empty result; columns
other than doc_id and text are never read for a score, and drop_toxic() keeps them, whatever their names.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pieces, ready

SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 6000
WINDOW, STEP = 64, 32
BASE_BYTES, CLASS_BYTES, TRAIN_BYTES = 100_000, 6144, 8 << 20
SHORT, LONG, LEAST_MATCH, LEAST_TEXTS, OFTEN, COPY = 6, 8, 6, 5, 60, 24
STRATEGY = zstandard.STRATEGY_BTLAZY2
FOLDS, FALSE_SHARE = 3, 0.01
TIERS = (20.0, 6.0, 2.5, 1.5)
LOWEST, HIGHEST = -2, 9
_CUT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_MAGIC = b"\x37\xa4\x30\xec"


def plain(text: str | None) -> bytes:
    """The text as it is compared: lower case, words joined by one space, a space at either end."""
    return b" " + b" ".join((text or "").lower().encode().translate(_CUT).split()) + b" "


def window_starts(n: int) -> range:
    """Where the windows of a text of n bytes begin; the last one may be shorter."""
    return range(0, max(n - WINDOW + STEP, 1), STEP)


def runs(data: bytes, n: int) -> np.ndarray:
    """The n bytes from each place on, as one number (from nine bytes on, a hash)."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(len(raw) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(257 if n > 8 else 256) + raw[i : i + len(out)]
    return out


class _Seen:
    """In how many of some texts a run of n bytes occurs, by a table of hashes."""

    def __init__(self, texts: list[bytes], n: int, bits: int = 24):
        self.table, self.shift, self.run = np.zeros(1 << bits, np.uint16), np.uint64(64 - bits), n
        for text in texts:
            self.table[np.unique(self.slots(text))] += 1  # a sample has fewer than 2**16 texts

    def slots(self, data: bytes) -> np.ndarray:
        return (runs(data, self.run) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def covered(self, data: bytes, marked: np.ndarray) -> np.ndarray:
        """The places of data that a marked run covers."""
        change = np.zeros(len(data) + 1, np.int32)
        change[: len(marked)] += marked
        change[self.run : self.run + len(marked)] -= marked
        return np.cumsum(change[:-1]) > 0


def _stretches(data: bytes, here: np.ndarray, least: int, margin: int = 0) -> list[bytes]:
    edge = np.flatnonzero(np.diff(np.r_[False, here, False].astype(np.int8)))
    return [data[max(a - margin, 0) : b + margin] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def unexplained(data: bytes, ordinary: _Seen, least: int) -> list[bytes]:
    """The stretches of three bytes or more that no run of `least` ordinary texts covers, with two bytes on either side."""
    return _stretches(data, ~ordinary.covered(data, ordinary.table[ordinary.slots(data)] >= least), 3, 2)


def without_copies(texts: list[bytes]) -> list[bytes]:
    """One of each group of texts that have the same smallest hash among their runs of COPY bytes: near copies, most likely."""
    found: dict[int, bytes] = {}
    for text in texts:
        own = runs(text, COPY) * np.uint64(0x9E3779B97F4A7C15)
        found.setdefault(int((own ^ own >> np.uint64(29)).min()) if len(own) else zlib.crc32(text), text)
    return list(found.values())


def peculiar(data: bytes, toxic: _Seen, often: int, ordinary: _Seen, least: int) -> list[bytes]:
    """The stretches made up of runs that `often` toxic texts have and fewer than `least` ordinary ones."""
    at = toxic.slots(data)
    return _stretches(data, toxic.covered(data, (toxic.table[at] >= often) & (ordinary.table[at] < least)), 1)


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary trained by zstandard; where there is too little to train on, the end of the samples themselves."""
    some = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, some, k=k, d=6, level=19).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(some)[-size:]


class Lengths:
    """Compressed length of a window under one dictionary."""

    def __init__(self, dictionary: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            19, strategy=STRATEGY, search_log=5, target_length=32, min_match=LEAST_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False
        )
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary.startswith(_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        data.precompute_compress(compression_params=settings)
        self.compress = zstandard.ZstdCompressor(compression_params=settings, dict_data=data).compress

    def __call__(self, window: bytes) -> int:
        return len(self.compress(window))


class Model:
    """The dictionaries, the tier of each difference of lengths, and the weights of the final logistic function."""

    def __init__(self, base: bytes, ordinary: bytes, toxic: bytes, tier: np.ndarray, weights: np.ndarray):
        self.base, self.ordinary, self.toxic, self.tier, self.weights = base, ordinary, toxic, tier, weights
        self.by_ordinary, self.by_toxic = Lengths(base + ordinary), Lengths(base + toxic)
        own = np.unique(np.concatenate([runs(base[-LEAST_MATCH:] + x, LEAST_MATCH) for x in (ordinary, toxic)]))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slots(own)] = True

    @staticmethod
    def _slots(own: np.ndarray) -> np.ndarray:
        return (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def differences(self, text: str | None) -> np.ndarray:
        """Number of windows by difference of lengths, from LOWEST to HIGHEST; what lies beyond counts as the last."""
        data = plain(text)
        out = np.zeros(HIGHEST - LOWEST + 1, np.int64)
        n = len(window_starts(len(data)))
        out[-LOWEST] = n
        hit = np.flatnonzero(self.filter[self._slots(runs(data, LEAST_MATCH))])
        if not len(hit):
            return out
        asked = np.zeros(n + 1, np.int64)
        np.add.at(asked, np.minimum(np.maximum(-(-(hit + LEAST_MATCH - WINDOW) // STEP), 0), n), 1)
        np.add.at(asked, np.minimum(hit // STEP + 1, n), -1)
        for i in np.flatnonzero(np.cumsum(asked[:-1]) > 0).tolist():
            part = data[i * STEP : i * STEP + WINDOW]
            d = min(max(self.by_ordinary(part) - self.by_toxic(part), LOWEST), HIGHEST)
            out[-LOWEST] -= 1
            out[d - LOWEST] += 1
        return out

    def score(self, text: str | None) -> float:
        z = float(_features(self.differences(text)[None, :], self.tier)[0] @ self.weights)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

    def dump(self) -> bytes:
        return json.dumps([self.base.hex(), self.ordinary.hex(), self.toxic.hex(), self.tier.tolist(), self.weights.tolist()]).encode()


@functools.lru_cache(2)
def load(dumped: bytes) -> Model:
    *dictionaries, tier, weights = json.loads(dumped)
    return Model(*map(bytes.fromhex, dictionaries), np.array(tier), np.array(weights))


def _features(counts: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """Of each document, from its windows by difference: all windows, those of each tier and their share, and the bytes saved."""
    by_tier = np.stack([counts[:, tier == n].sum(1) for n in range(len(TIERS) + 1)], 1)
    total, hits = by_tier.sum(1), by_tier[:, 1:]
    saved = counts @ np.where(tier > 0, np.arange(LOWEST, HIGHEST + 1), 0)
    return np.column_stack([np.ones(len(total)), np.log1p(total) / 5, np.log1p(saved), saved / (total + 3), np.log1p(hits), 10 * hits / (total[:, None] + 20)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(rows: list[tuple[int, str | None, int]]) -> tuple[bytes, bytes, bytes]:
    """Base, ordinary and toxic dictionary from (doc_id, text, label) rows; the last two are of one size."""
    ordinary, toxic = (without_copies([plain(r[1]) for r in rows if bool(r[2]) == own]) for own in (False, True))
    windows = [text[i : i + WINDOW] for text in ordinary for i in range(0, len(text), WINDOW)]
    every = max(1, -(-len(windows) * WINDOW // TRAIN_BYTES))
    base = trained(windows[::every], BASE_BYTES, 64)
    least, often = 1 + len(ordinary) // 1000, max(LEAST_TEXTS, len(toxic) // OFTEN)
    short, long, long_toxic = _Seen(ordinary, SHORT), _Seen(ordinary, LONG), _Seen(toxic, LONG)
    marks = [[b"\n".join(unexplained(t, short, least) + peculiar(t, long_toxic, often, long, least)) for t in toxic]]
    marks += [[b"\n".join(unexplained(t, short, least + 1)) for t in ordinary]]  # itself is one of those that hold its runs
    rest = [trained(m, CLASS_BYTES, 16) for m in marks]
    rest = [r[len(r) // 8 :] if r.startswith(_MAGIC) else r for r in rest]  # without the tables at the head of a trained one
    size = len(rest[0])
    own, other = (r[-size:].rjust(size, b"\n") if size else b"" for r in rest)
    return base, other, own


def fit(rows: list[tuple[int, str | None, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """Model from (doc_id, text, label) rows; None unless both labels occur in every one of the FOLDS parts of the rows.

    Each part is measured with dictionaries of the others, which calibrates tiers and weights; the dictionaries of the
    model are trained on all rows. stands_for: labelled rows to a sampled one, for ordinary and toxic rows.
    """
    parts: list[list[tuple[int, str | None, int]]] = [[] for _ in range(FOLDS)]
    for r in rows:
        parts[zlib.crc32(f"part {r[0]}".encode()) % FOLDS].append(r)
    if any({bool(r[2]) for r in some} != {True, False} for some in parts):
        return None
    empty = np.zeros(HIGHEST - LOWEST + 1, np.int64), np.zeros(4 + 2 * len(TIERS))
    measured = []
    for n, some in enumerate(parts):
        probe = Model(*dictionaries([r for k, other in enumerate(parts) if k != n for r in other]), *empty)
        measured += [probe.differences(text) for _, text, _ in some]
    counts, label = np.stack(measured), np.array([bool(r[2]) for some in parts for r in some])
    model = Model(*dictionaries(rows), *empty)
    often = np.minimum(counts, 3)
    ratio = ((often[label].sum(0) + 0.1) / label.sum()) / ((often[~label].sum(0) + 0.5) / (~label).sum())
    for n, bound in reversed(list(enumerate(TIERS, 1))):
        model.tier[ratio > bound] = n
    model.tier[: -LOWEST + 1] = 0  # not shorter under the toxic dictionary: no sign of toxicity
    x = _features(counts, model.tier)
    model.weights[:] = _logistic(x, label.astype(float), np.where(label, stands_for[1], stands_for[0]))
    highest = np.sort((x @ model.weights)[~label])[::-1]
    model.weights[0] -= max(0.0, float(highest[int(FALSE_SHARE * len(highest))]) + 1e-9)
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY) -> bytes:
    """Fitted model, from labelled rows outside the held-out fold."""
    ready(docs.sparkSession)
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    there = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    stands_for = tuple(there.get(v, 0) / max(1, min(there.get(v, 0), n)) for v, n in ((0, ordinary), (1, toxic)))
    order = F.xxhash64("doc_id")
    chosen = functools.reduce(DataFrame.unionByName, [usable.filter(F.col("label") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, toxic), (0, ordinary))])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most toxic + ordinary small rows

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}
        for batch in batches:
            for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True):
                rows[doc] = min(rows.get(doc, (doc, text, label)), (doc, text, label), key=lambda r: r[1] or "")  # one of rows that share an id
        model = fit([rows[d] for d in sorted(rows)], stands_for)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0][0]) if found else b""


def scores(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(model) if model else None
        for batch in pieces(batches, "text"):
            score = [use.score(t) if use else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    ready(docs.sparkSession)
    rated = docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(model) if model else None
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array([use is None or use.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    ready(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
