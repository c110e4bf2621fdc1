import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from rankloom.llm import packing
from rankloom.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, length string"


def odd_texts():
    r = random.Random(1)
    letters = "abcXYZéÈñßÜİΣςſ '\t\n\x0b\x1c\x85\xa0 <|>endoftext12²½三🙂́,.!?-'sʼ"
    out = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(800)]
    return out + ["<|endoftext|> it's I'LL we've <|startoftext|>x", None, "", " \n", "a" * 300 + " " + "ab" * 200, "don't", "﻿hi", "\x00a b​", "aaaaaaaaaaaa bbbbbbb"]


def test_ids_equal_the_library():
    texts = odd_texts()
    ids, at = encoder(PATH).encode(pa.array(texts))
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_ids_of_documents(spark, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    ids, at = encoder(PATH).encode(pa.array(texts).slice(1))
    library = Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts[1:]], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("draw", ["even", "half", "small"])
def test_pack_is_whole_and_tight(draw):
    r = np.random.default_rng(3)
    lengths = {"even": r.integers(1, 2049, 3000), "half": r.integers(500, 1100, 1500), "small": r.integers(1, 9, 400)}[draw]
    start = packing.best_fit(lengths, 2048)
    bins = packing.local_search(start, lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    assert -(-lengths.sum() // 2048) <= len(bins) <= len(start)
    if draw == "half":
        assert len(bins) < len(start)


def test_pack_of_nothing():
    assert packing.pack(np.zeros(0, np.int64)) == []


def test_documents_round_trip(spark):
    docs = [(1, "alpha beta gamma"), (2, None), (3, ""), (3, ""), (4, "word " * 5000), (None, "x y"), (5, "alpha beta gamma")]
    df = spark.createDataFrame([Row(d, t, "p", "q") for d, t in docs], SCHEMA)
    rows = packing.pack_documents(df, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []
