"""Token ids of a byte-level BPE tokenizer file with word ends, for whole batches of text at once.

The ids are those of the `tokenizers` library for the same file. Plain words (code points below U+0250 without
apostrophes, '<' or control characters) are merged together in numpy by the file's own merge table; each distinct word
of a batch is merged once. All other words go to the library one by one, through a bounded cache. White space never
reaches a token in this kind of file, so words can be encoded apart.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from rankloom.llm.common import span_hash, utf8

EDGE = 0x250
LONGEST = 64
_SPACE, _LETTER, _NUMBER, _OTHER, _HARD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(EDGE + 1, _HARD, np.uint8), np.arange(EDGE + 1, dtype=np.uint32)
    for c in range(EDGE):
        char, group = chr(c), unicodedata.category(chr(c))
        if c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            kind[c] = _SPACE
        elif group[0] in "CZ" or char in "'<" or len(char.lower()) != 1 or ord(char.lower()) >= EDGE or unicodedata.normalize("NFC", char) != char:
            continue
        else:
            kind[c] = {"L": _LETTER, "N": _NUMBER}.get(group[0], _OTHER)
            lower[c] = ord(char.lower())
    return kind, lower


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, tail = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + tail] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.none = len(pairs)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.joined = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self.bits = max(10, int(len(pairs) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32), np.full(1 << self.bits, self.none, np.int32)
        at = self._slot(key)
        for k, rank, i in zip(key.tolist(), range(self.none), at.tolist(), strict=True):
            while self.keys[i] != 0xFFFFFFFF:
                i = (i + 1) & ((1 << self.bits) - 1)
            self.keys[i], self.ranks[i] = k, rank
        self.kind, self.lower = _classes()
        self.hard = functools.lru_cache(1 << 16)(lambda word: self.library.encode(word, add_special_tokens=False).ids)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = self._slot(key)
        out = self.ranks[at]
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found != 0xFFFFFFFF))
        out[found != key] = self.none
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != 0xFFFFFFFF)]
        return out

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes in a row; returns ids in a row and their number by word."""
        n = len(length)
        last = np.cumsum(length) - 1
        ids = self.inner[data]
        ids[last] = self.final[data[last]]
        owner = np.repeat(np.arange(n), length)
        rank = np.full(len(ids), self.none, np.int32)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self.rank(ids[:-1][same], ids[1:][same])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            over = least == self.none
            if over.any():
                done.append((ids[over], owner[over]))
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]  # the leftmost of each word
            ids[at] = self.joined[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol has gone before each later place
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                ok = i + 1 < len(ids)
                ok[ok] = owner[i[ok]] == owner[i[ok] + 1]
                rank[i] = self.none
                rank[i[ok]] = self.rank(ids[i[ok]], ids[i[ok] + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ids, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and len+1 offsets; null counts as empty."""
        data, at = utf8(column)
        n_texts = len(at) - 1
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[at]
        if not len(point):
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
        kind = self.kind[np.minimum(point, EDGE)]
        inside = kind != _SPACE
        edge = np.zeros(len(point) + 1, bool)
        edge[at] = True
        prior = np.r_[np.uint8(_SPACE), kind[:-1]]
        word_start = inside & ((prior == _SPACE) | edge[:-1])
        start = np.flatnonzero(word_start)
        end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
        hard_total = np.r_[0, np.cumsum(kind == _HARD)]
        hard = (hard_total[end] > hard_total[start]) | (end - start > LONGEST)
        in_hard = np.zeros(len(point), bool)
        in_hard[np.repeat(start[hard] - np.r_[0, np.cumsum((end - start)[hard])[:-1]], (end - start)[hard]) + np.arange((end - start)[hard].sum())] = True
        unit_start = word_start | (inside & ~in_hard & ((kind != prior) | (kind == _NUMBER)))
        u0 = np.flatnonzero(unit_start)
        word_of = np.searchsorted(start, u0, "right") - 1
        u1 = np.minimum(np.r_[u0[1:], len(point)], end[word_of])
        hard = hard[word_of]
        plain = np.where(in_hard, point, self.lower[np.minimum(point, EDGE)])
        key = span_hash(plain.astype(np.uint64) + np.uint64(1), u0, u1)
        key = np.where(hard, ~key, key)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        easy, tough = np.flatnonzero(~hard[one]), np.flatnonzero(hard[one])
        a, b = u0[one[easy]], u1[one[easy]]
        size = b - a
        flat = plain[np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(a) else plain[:0]
        raw = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        size = np.add.reduceat((flat >= 0x80).astype(np.int64) + 1, np.r_[0, np.cumsum(size)[:-1]]) if len(a) else size
        pool, length = self.merge(raw, size) if len(a) else (np.zeros(0, np.int32), size)
        others = [self.hard(plain[s:e].astype("<u4").tobytes().decode("utf-32-le")) for s, e in zip(u0[one[tough]].tolist(), u1[one[tough]].tolist(), strict=True)]
        counts = np.zeros(len(one), np.int64)
        counts[easy], counts[tough] = length, [len(x) for x in others]
        offset = np.zeros(len(one), np.int64)
        offset[easy] = np.r_[0, np.cumsum(length)[:-1]] if len(length) else length
        offset[tough] = len(pool) + np.r_[0, np.cumsum(counts[tough])[:-1]] if len(tough) else 0
        pool = np.concatenate([pool, *(np.array(x, np.int32) for x in others)])
        n = counts[back]
        total = np.r_[0, np.cumsum(n)]
        ids = pool[np.repeat(offset[back] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(u0, at)]


@functools.lru_cache(4)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)
