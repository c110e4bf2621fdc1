"""Language identification as a mixture of languages, fitted to each document by expectation-maximisation.

Each language is a table of probabilities of byte trigrams inside words (with the spaces around them), lower-cased. A word's
likelihood in a language is the product over its trigrams. A document's words are drawn from a mixture of languages whose
proportions are estimated by expectation-maximisation over all its words, equal words counted together. Then sets of the
one, two, three ... most plausible languages are tried for as long as the log-likelihood less PENALTY * languages *
log(words + 1) rises; the prediction is the language with the largest proportion in the best set, and the score is this
proportion.

The tables are learned from a bounded sample: of each language about PER_LANGUAGE documents, fewer where all languages
together would exceed SAMPLE; those whose hash of doc_id lies under a threshold that follows from the language's count, so
nothing is ranked or shuffled. Every language with a letter in its training texts is learned, from one text at least; with
very many the tables have fewer cells, so that all of them together stay within CELLS. What a language hasn't shown has the
share UNSEEN in each, whatever its size, so a language of few texts doesn't win the words that none knows. Every word of
every text is used in a prediction.

Defined results: `und` with score 0 where the text is null, empty or has no letter, or where nothing was learned; a text
whose letters are in no word of a learned script still gets a learned language; a very long text is looked at whole, with
memory of a small multiple of its bytes and of its distinct words times languages; ties go to the language first in order
of name; repeated rows score alike; an empty table gives an empty result; lang, source and doc_id are never read in a
prediction, nor are further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import CHUNK_BYTES, Words, pieces, ready

PER_LANGUAGE, SAMPLE = 2000, 128_000
BITS, CELLS, UNSEEN = 16, 1 << 24, 0.01
ROUNDS, PENALTY = 8, 2.0
FEW = 100_000  # languages, a name and a number each, that may be broadcast
_LETTER = regex.compile(r"\p{L}")


def trigrams(text: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram number at each byte, first and end trigram of each word); a word's neighbours count as spaces."""
    padded = np.full(len(text.data) + 2, 0x20, np.uint32)
    padded[1:-1] = text.data
    gram = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    lead, last = text.start, text.end - 1  # the byte before or after may belong to the next text
    gram[lead] = np.uint32(0x20 << 16) | (gram[lead] & np.uint32(0xFFFF))
    gram[last] = (gram[last] & np.uint32(0xFFFFFF00)) | np.uint32(0x20)
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), text.start, text.end


def table_bits(languages: int) -> int:
    """Bits of a trigram number, so that the tables of all languages stay within CELLS."""
    return max(1, min(BITS, (CELLS // max(1, languages)).bit_length() - 1))


def held_out(doc_id: Column, folds: int = 4, which: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == which, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and log-probabilities (languages, 2**bits)."""
    spark = ready(docs.sparkSession)
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    most = 1 << 30
    usable = usable.filter(F.rlike("text", F.lit(r"\p{L}"))).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(most)))
    there = usable.groupBy("lang").agg(F.count(F.lit(1)), F.min("draw")).collect()  # a row for each language
    if not there:
        return [], np.zeros((0, 1 << BITS), np.float32)
    want = max(1, min(per_language, sample // len(there)))
    bounds = spark.createDataFrame([(r[0], most if r[1] <= want else max(r[2] + 1, most * want // r[1])) for r in there], "lang string, below long")
    chosen = usable.join(F.broadcast(bounds) if len(there) <= FEW else bounds, "lang").filter(F.col("draw") < F.col("below")).select("lang", "text")
    bits = table_bits(len(there))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            text = Words(batch.column("text"), plain=True)
            gram, start, end = trigrams(text, bits)
            size = np.add.reduceat(end - start, text.first[:-1][np.diff(text.first) > 0]) if len(text) else np.zeros(0, np.int64)
            inside = gram[np.repeat(start - np.r_[0, np.cumsum(end - start)[:-1]], end - start) + np.arange((end - start).sum())]
            at = np.r_[0, np.cumsum(size)]
            full = np.flatnonzero(np.diff(text.first) > 0)
            langs = batch.column("lang").to_pylist()
            for n, d in enumerate(full.tolist()):
                total.setdefault(langs[d], np.zeros(1 << bits, np.int64))
                total[langs[d]] += np.bincount(inside[at[n] : at[n + 1]], minlength=1 << bits)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    names = sorted(r[0] for r in there)
    table = np.zeros((len(names), 1 << bits), np.float32)
    for name, own in counts.groupby("lang"):
        table[names.index(name), own["gram"].to_numpy()] += own["n"].to_numpy()
    share = table / table.sum(1, keepdims=True, dtype=np.float64)
    return names, np.log((1 - UNSEEN) * share + UNSEEN / (1 << bits)).astype(np.float32)


def _mixture(like: np.ndarray, weight: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document. `like`: (words, languages); share is the start, zero keeps out."""
    size = np.add.reduceat(weight, first)[:, None]
    for n in range(rounds + 1):
        weighted = like * share[doc]
        total = np.maximum(weighted.sum(1), 1e-300)
        if n == rounds:
            return share, np.add.reduceat(weight * np.log(total), first)
        share = np.add.reduceat(weighted * (weight / total)[:, None], first) / size
    raise AssertionError


def distinct_words(text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a word of each kind, its count, its text): the distinct words of each text, text by text."""
    order = np.lexsort((text.hashes, text.doc))
    word, doc = text.hashes[order], text.doc[order]
    head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])
    return order[head], np.diff(np.r_[head, len(order)]).astype(np.float64), doc[head]


def mixtures(text: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers with words, their proportions after the choice of a set)."""
    full = np.flatnonzero(np.diff(text.first) > 0)
    if not len(full):
        return full, np.zeros((0, len(table)))
    gram, start, end = trigrams(text, table.shape[1].bit_length() - 1)
    word, weight, own = distinct_words(text)
    log = np.empty((len(word), len(table)))
    spans = np.stack([start[word], end[word]], 1).ravel()
    for k, row in enumerate(table):
        log[:, k] = np.add.reduceat(np.append(row[gram], np.float32(0)), spans, dtype=np.float64)[::2]
    like = np.exp(log - log.max(1)[:, None])
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    doc = np.repeat(np.arange(len(full)), np.diff(np.r_[first, len(own)]))
    n_words = np.diff(text.first)[full]
    whole = np.full((len(full), len(table)), 1 / len(table))
    whole, _ = _mixture(like, weight, first, doc, whole, ROUNDS)
    order = np.argsort(-whole, axis=1, kind="stable")
    best, share = np.full(len(full), -np.inf), whole
    left = np.arange(len(full))  # texts whose penalised likelihood still rises
    for k in range(1, len(table) + 1):
        words = np.isin(doc, left)
        of = np.searchsorted(left, doc[words])
        keep = np.zeros((len(left), len(table)))
        np.put_along_axis(keep, order[left, :k], np.maximum(np.take_along_axis(whole[left], order[left, :k], 1), 1e-6), 1)
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        found, fit = _mixture(like[words], weight[words], head, of, keep / keep.sum(1, keepdims=True), ROUNDS // 2 if k > 1 else 0)
        fit = fit - PENALTY * k * np.log(n_words[left] + 1)
        better = fit > best[left]
        left = left[better]
        if not len(left):
            break
        if k == 1:
            share = np.zeros_like(whole)
        best[left], share[left] = fit[better], found[better]
    return full, share


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (name to proportion) of every document."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max(1 << 16, CHUNK_BYTES * 8 // max(8, len(names)))):
            raw = batch.column("text").to_pylist()
            lang, score, share = ["und"] * len(raw), [0.0] * len(raw), [[] for _ in raw]
            if names:
                full, found = mixtures(Words(batch.column("text"), plain=True), table)
                best = found.argmax(1)
                for d, k, own in zip(full.tolist(), best.tolist(), found, strict=True):
                    if _LETTER.search(raw[d]):
                        lang[d], score[d] = names[k], float(min(own[k], 1.0))
                        share[d] = [(names[i], float(own[i])) for i in np.flatnonzero(own > 0).tolist()]
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, kind)], ["doc_id", "lang_pred", "score", "languages"])

    ready(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(guess, "doc_id long, lang_pred string, score double, languages map<string, double>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
