"""Removal of word windows that already start in an earlier document, by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash among its runs of `core` words, so equal windows
have equal minimisers. Consecutive windows with one minimiser form a super-k-mer, and at first only its place travels:
(minimiser, hash of its words, doc_id, start, windows). These are counted by word sequence with a partial aggregate before
the shuffle, so copies meet as one row. Of every minimiser that occurs in several documents each different super-k-mer then
travels once, as a packed string, to the bucket of that minimiser, where sorting the windows finds the smallest document of
each; neighbours in that order are compared byte by byte. Strings of a minimiser with more than HOT different ones are cut
again by the minimisers of another hash function, up to SPLITS times, and go to the buckets of those; what is crowded even
then is cut into strings of one window, where strings with equal minimiser and name, two hashes of 64 bits, are taken as
equal windows. A super-k-mer of more than LONGEST windows, as in a text that repeats itself, is cut before it travels. So no
bucket holds more than HOT strings, nor more than HOT * LONGEST windows.

The windows of every document are judged on the input, and rows that share a doc_id each for itself: spans belong to a
doc_id and the hash of a text. Nothing is capped or sampled.

Defined results: null text and texts shorter than a window lose nothing; rows with a null doc_id neither remove words nor
lose any; rows of one doc_id, with equal or other texts, don't remove each other's words; a very long text is one row of its task, whose memory is a
small multiple of its bytes; of equal windows that with the smallest doc_id stays; an empty table gives an empty result;
further columns are ignored by removed_spans() and substring_digest() and kept by cut_repeats(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BASES, Words, mix, parts, pieces, ready, signed, span_hash, written

WINDOW, CORE, HOT, SPLITS = 50, 8, 1000, 2
LONGEST = 200  # windows of a super-k-mer; words that don't repeat give fewer than WINDOW
BATCH_BYTES = 1 << 20
_RUNS = "array<struct<at: int, n: int, doc: long>>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def super_kmers(text: Words, window: int, core: int, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, number of windows) of each super-k-mer of a batch of texts; `order` picks the hash function."""
    core = min(core, window)
    n = len(text) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, at = text.grams(core)
    whole = np.full(len(text) - core + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[at] = mix(grams + np.uint64(order) * np.uint64(BASES[0])) if order else grams
    least = sliding_min(whole, window - core + 1)
    place = np.arange(n)
    inside = place + window <= text.first[1:][text.doc[:n]]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(fresh)
    stop = np.flatnonzero(inside & ~np.r_[inside[1:] & ~fresh[1:], False]) + 1
    cuts = -(-(stop - start) // LONGEST)  # equal super-k-mers are cut at equal places
    if (cuts > 1).any():
        start = np.repeat(start, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        stop = np.minimum(np.repeat(stop, cuts), start + LONGEST)
    return least[start], start, stop - start


def mark() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def _places(docs: DataFrame, window: int, core: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text = Words(batch.column("text"))
            least, start, n = super_kmers(text, window, core)
            doc = text.doc[start]
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            name = span_hash(text.hashes, start, start + n + window - 1, 2)
            cols = [signed(least), signed(name), ids[doc], batch.column("mark").to_numpy()[doc], (start - text.first[doc]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["core", "name", "doc_id", "mark", "start", "n"])

    some = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", mark().alias("mark"))
    return some.mapInArrow(find, "core long, name long, doc_id long, mark long, start int, n int")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, body): UTF-8 texts under zstd, so that a shuffle of whole texts stays small."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            body = [None if t is None else press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array(body, pa.binary())], ["doc_id", "mark", "body"])

    return docs.select("doc_id", "text", mark().alias("mark")).mapInArrow(shrink, "doc_id long, mark long, body binary")


def unpack(body: bytes | None) -> bytes:
    return b"" if body is None else zstandard.ZstdDecompressor().decompress(body)


def _strings(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted super-k-mers (core, name, doc_id, mark, start, n, hot), read from the documents that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, body, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "asked")), strict=True):
                text = Words(pa.array([unpack(body).decode()]))
                start = np.array([a["start"] for a in asked])
                n = np.array([a["n"] for a in asked])
                fits = start + n + window - 1 <= len(text)
                name = signed(span_hash(text.hashes, np.where(fits, start, 0), np.where(fits, start + n + window - 1, 0), 2))
                for a, ok, got in zip(asked, fits.tolist(), name.tolist(), strict=True):
                    if ok and got == a["name"]:  # else another text has the same doc_id and mark
                        rows.append((a["core"], a["name"], doc, a["n"], a["hot"], text.join(a["start"], a["start"] + a["n"] + window - 1)))
                        held += len(rows[-1][-1])
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["core", "name", "doc_id", "n", "hot", "body"])

    asked = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("core", "name", "start", "n", "hot")).alias("asked"))
    found = packed(docs.filter("doc_id is not null and text is not null")).join(asked, ["doc_id", "mark"])
    return found.mapInArrow(cut, "core long, name long, doc_id long, n int, hot boolean, body binary")


def _windows(bodies: list[bytes], window: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of packed strings, the first word of each window, and the string of each window."""
    text = Words(pa.array([b.decode() for b in bodies], pa.large_string()))
    n = np.diff(text.first) - window + 1
    of = np.repeat(np.arange(len(bodies)), n)
    at = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + text.first[:-1][of]
    return text, at, of


def smallest_by_window(bodies: list[bytes], docs: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string of each window, smallest document of an equal window), by sorting the windows of all strings."""
    text, at, of = _windows(bodies, window)
    key = span_hash(text.hashes, at, at + window, 1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    raw = text.data.tobytes()
    left, right = text.start[at].tolist(), text.end[at + window - 1].tolist()
    for i in np.flatnonzero(same).tolist():
        x, y = order[i], order[i + 1]
        if raw[left[x] : right[x]] != raw[left[y] : right[y]]:  # equal hashes, other words: sort by the words themselves
            spans = [raw[a:b] for a, b in zip(left, right, strict=True)]
            order = np.array(sorted(range(len(spans)), key=spans.__getitem__), np.int64)
            same = np.array([spans[a] == spans[b] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], bool)
            break
    first = np.flatnonzero(np.r_[True, ~same])
    own = np.array(docs, np.int64)[of]
    least = np.empty(len(at), np.int64)
    if len(at):
        least[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.r_[first, len(order)]))
    return of, least


def _answer(core: list[int], name: list[int], of: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Runs of windows with one smallest document, by string."""
    fresh = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (least[1:] != least[:-1])]) if len(of) else np.zeros(0, np.int64)
    size = np.diff(np.r_[fresh, len(of)])
    head = np.searchsorted(of, np.arange(len(core)))
    runs = pa.StructArray.from_arrays(
        [pa.array((fresh - head[of[fresh]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(least[fresh])], ["at", "n", "doc"]
    )
    offsets = np.searchsorted(of[fresh], np.arange(len(core) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(name, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs)], ["core", "name", "runs"])


def _buckets(strings: DataFrame, window: int) -> DataFrame:
    """Answer of each string from the bucket of its minimiser."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, name, doc, body, held = [], [], [], [], 0
        for batch in batches:
            for c, s, d, b in zip(*(batch.column(x).to_pylist() for x in ("core", "name", "doc_id", "body")), strict=True):
                if held > BATCH_BYTES and c != core[-1]:
                    yield _answer(core, name, *smallest_by_window(body, doc, window))
                    core, name, doc, body, held = [], [], [], [], 0
                core.append(c)
                name.append(s)
                doc.append(d)
                body.append(b)
                held += len(b)
        if core:
            yield _answer(core, name, *smallest_by_window(body, doc, window))

    sorted_ = strings.repartition(parts(strings), "core").sortWithinPartitions("core", "name")
    return sorted_.mapInArrow(judge, f"core long, name long, runs {_RUNS}")


def _answers(strings: DataFrame, window: int, core: int, hot: int, order: int = 0) -> DataFrame:
    """Answer of each string (core, name, doc_id, n, hot, body), a written table."""
    crowded = strings.filter("hot")
    if crowded.isEmpty():
        return _buckets(strings, window)
    return _buckets(strings.filter("not hot"), window).unionByName(_cut_again(crowded, window, core, hot, order + 1))


def _cut_again(strings: DataFrame, window: int, core: int, hot: int, order: int) -> DataFrame:
    """Answers of strings whose buckets are too full, from those of their parts under another hash function."""
    last = order > SPLITS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            text, start, of = _windows(batch.column("body").to_pylist(), window)
            least, n = np.zeros(len(start), np.uint64), np.ones(len(start), np.int64)
            if not last:
                least, start, n = super_kmers(text, window, core, order)
                of = text.doc[start]
            end = start + n + window - 1
            name = signed(span_hash(text.hashes, start, end, 2))
            least = signed(span_hash(text.hashes, start, end, 1) if last else least)
            body = [text.join(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            take = lambda c: batch.column(c).take(pa.array(of))
            cols = [take("core"), take("name"), take("doc_id"), pa.array((start - text.first[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least), pa.array(name), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["above", "whole", "doc_id", "at", "n", "core", "name", "body"])

    cuts = written(strings.select("core", "name", "doc_id", "body").mapInArrow(cut, "above long, whole long, doc_id long, at int, n int, core long, name long, body binary"), "cuts")
    kinds = cuts.groupBy("core", "name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("body").alias("body"))
    if last:
        answers = kinds.select("core", "name", F.array(F.struct(F.lit(0).alias("at"), "n", F.col("doc_id").alias("doc"))).cast(_RUNS).alias("runs"))
    else:
        crowds = kinds.groupBy("core").agg((F.count(F.lit(1)) > hot).alias("hot"))
        answers = _answers(written(kinds.join(crowds, "core").select("core", "name", "doc_id", "n", "hot", "body"), "strings"), window, core, hot, order)
    found = cuts.select("above", "whole", "at", "core", "name").join(answers, ["core", "name"]).select("above", "whole", "at", F.explode("runs").alias("r"))
    runs = F.collect_list(F.struct((F.col("at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"), F.col("r.doc").alias("doc")))
    return found.groupBy(F.col("above").alias("core"), F.col("whole").alias("name")).agg(runs.cast(_RUNS).alias("runs"))


def removed_spans(docs: DataFrame, window: int = WINDOW, core: int = CORE, hot: int = HOT) -> DataFrame:
    """(doc_id, mark, spans) for each text that loses words; spans holds word intervals (first, end), which may overlap."""
    ready(docs.sparkSession)
    places = written(_places(docs, window, core), "places")
    kinds = places.groupBy("core", "name").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.max("doc_id").alias("last"), F.first("n").alias("n")).select("core", "name", "first.*", "last", "n")
    # two aggregates with a partial step and a join that can be split, so a minimiser of a common passage is no task's burden
    shared = kinds.groupBy("core").agg(F.min("doc_id").alias("low"), F.max("last").alias("high"), F.count(F.lit(1)).alias("kinds")).filter("low < high")
    wanted = written(kinds.join(shared, "core").select("core", "name", "doc_id", "mark", "start", "n", (F.col("kinds") > hot).alias("hot")), "kinds")
    strings = written(_strings(docs, wanted, window), "strings")
    answers = _answers(strings, window, core, hot)

    hits = places.select("core", "name", "doc_id", "mark", "start").join(answers, ["core", "name"]).select("doc_id", "mark", "start", F.explode(F.filter("runs", lambda r: r["doc"] < F.col("doc_id"))).alias("r"))
    first = F.col("start") + F.col("r.at")
    return hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(first.alias("first"), (first + F.col("r.n") + (window - 1)).alias("end"))).alias("spans"))


def _mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """True for each word that stays."""
    if not spans:
        return np.ones(n, bool)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [min(s["first"], n) for s in spans], 1)
    np.add.at(change, [min(s["end"], n) for s in spans], -1)
    return np.cumsum(change[:-1]) == 0


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "spans")), strict=True):
                found = unpack(body).split()  # bytes.split() cuts at exactly the six ASCII white-space characters
                stays = _mask(len(found), spans)
                rows.append((doc, len(found), int((~stays).sum()), hashlib.sha256(b" ".join(compress(found, stays.tolist()) if spans else found)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = removed_spans(docs, window)
    return packed(docs).join(spans, ["doc_id", "mark"], "left").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the repeated words cut out of text (n_chars follows, where there is one); other texts stay to the byte."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(names, batch.column("row").flatten(), strict=True))
            out = []
            for text, spans in zip(own["text"].to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if text and spans:
                    raw = text.encode()
                    found = Words(pa.array([text]))
                    stays = _mask(len(found), spans)
                    ends = np.r_[found.start[1:], len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(found.start[stays].tolist(), ends[stays].tolist(), strict=True)).decode()
                out.append(text)
            own["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(own.values()), names)

    names = docs.columns
    spans = removed_spans(docs, window)
    joined = docs.select("doc_id", mark().alias("mark"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("row")).join(spans, ["doc_id", "mark"], "left").select("row", "spans")
    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
