"""Token ids of a byte-level BPE tokenizer file without word ends, for whole batches of text at once.

The ids are those of the `tokenizers` library for the same file. A text is cut before every single space between two plain
signs, where such a tokenizer never joins. Stretches of plain signs (code points below U+0250 without apostrophes, '<' or
control characters) are split into units by numpy and each distinct unit of a batch is merged once, by the file's own merge
table; all other stretches go to the library whole, through a bounded cache.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from rankloom.llm.common import span_hash, utf8
from rankloom.llm.tokens import EDGE, LONGEST, WordBpe, _byte_chars

_SPACE, _LETTER, _NUMBER, _OTHER, _HARD = range(5)


def _classes() -> np.ndarray:
    kind = np.full(EDGE + 1, _HARD, np.uint8)
    for c in range(EDGE):
        group = unicodedata.category(chr(c))[0]
        if c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            kind[c] = _SPACE
        elif group not in "CZ" and chr(c) not in "'<":
            kind[c] = {"L": _LETTER, "N": _NUMBER}.get(group, _OTHER)
    return kind


class ByteBpe(WordBpe):
    """Encoder for one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.inner = self.final = np.array([vocab[c] for c in _byte_chars()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.none = len(pairs)
        self.joined = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self.bits = int(len(pairs) * 4).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32), np.full(1 << self.bits, self.none, np.int32)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        for rank, (k, i) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[i] != 0xFFFFFFFF:
                i = (i + 1) & ((1 << self.bits) - 1)
            self.keys[i], self.ranks[i] = k, rank
        self.kind = _classes()
        self.hard = functools.lru_cache(1 << 16)(lambda text: self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and len+1 offsets; null counts as empty."""
        data, at = utf8(column)
        n_texts = len(at) - 1
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        n = len(point)
        if not n:
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
        kind = self.kind[np.minimum(point, EDGE)]
        head = np.zeros(n + 1, bool)
        head[at] = True
        head[n] = True
        start = self._units(point, kind, head)
        u0 = np.flatnonzero(start)
        u1 = np.r_[u0[1:], n]
        hard = np.r_[0, np.cumsum(kind == _HARD)]
        tough = (hard[u1] > hard[u0]) | (u1 - u0 > LONGEST)
        key = span_hash(point.astype(np.uint64) + np.uint64(1), u0, u1)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        pool, offset, count = self._pool(point, u0[one], u1[one], tough[one])
        number = count[back]
        total = np.r_[0, np.cumsum(number)]
        ids = pool[np.repeat(offset[back] - total[:-1], number) + np.arange(total[-1])]
        return ids, total[np.searchsorted(u0, at)]

    @staticmethod
    def _units(point: np.ndarray, kind: np.ndarray, head: np.ndarray) -> np.ndarray:
        """First place of each unit. A stretch that holds a hard sign is one unit."""
        n = len(point)
        prior, after = np.r_[np.uint8(_SPACE), kind[:-1]], np.r_[kind[1:], np.uint8(_SPACE)]
        space = kind == _SPACE
        blank = point == 0x20
        plain = lambda k: (k != _SPACE) & (k != _HARD)
        cut = head[:-1] | (blank & plain(prior) & plain(after) & ~head[1:])  # the text of `after` is this one's
        stretch = np.cumsum(cut)
        hard = np.zeros(stretch[-1] + 1, bool)
        hard[stretch[kind == _HARD]] = True
        easy = ~hard[stretch]
        # a space before a sign belongs to that sign's unit; of more white space the last goes apart
        last = space & ~head[1:] & (after != _SPACE)
        joined = np.r_[False, last[:-1] & blank[:-1]]
        sign = ~space & ~joined & ((kind != prior) | head[:-1])
        white = space & ((prior != _SPACE) | head[:-1] | last)
        return cut | (easy & (sign | white))

    def _pool(self, point: np.ndarray, u0: np.ndarray, u1: np.ndarray, tough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units in a row, and each unit's first place there and number of ids."""
        text = lambda s, e: point[s:e].tobytes().decode("utf-32-le")
        easy, others = np.flatnonzero(~tough), np.flatnonzero(tough)
        size = (u1 - u0)[easy]
        before = np.r_[0, np.cumsum(size)]
        flat = point[np.repeat(u0[easy] - before[:-1], size) + np.arange(before[-1])]
        bytes_before = np.r_[0, np.cumsum(1 + (flat >= 0x80))][before]
        raw = np.frombuffer(flat.tobytes().decode("utf-32-le").encode(), np.uint8)
        merged, length = self.merge(raw, np.diff(bytes_before)) if len(easy) else (np.zeros(0, np.int32), size)
        by_library = [self.hard(text(s, e)) for s, e in zip(u0[others].tolist(), u1[others].tolist(), strict=True)]
        count = np.zeros(len(u0), np.int64)
        count[easy], count[others] = length, [len(x) for x in by_library]
        order = np.r_[easy, others]
        offset = np.zeros(len(u0), np.int64)
        offset[order] = np.r_[0, np.cumsum(count[order])][:-1]
        return np.concatenate([merged, *(np.array(x, np.int32) for x in by_library)]), offset, count


@functools.lru_cache(2)
def byte_encoder(path: str) -> ByteBpe:
    return ByteBpe(path)
