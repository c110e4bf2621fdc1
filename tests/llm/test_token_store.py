"""Token files: blocks, footers and whole round trips against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rankloom.llm import registry, token_store
from rankloom.llm.bytebpe import byte_encoder
from tests.llm.test_packing_tokens import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    """Rows of round_trip() by the library, one document at a time; rows are (doc_id, text) with different ids."""
    library, start, out = Tokenizer.from_file(PATH), 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def got(df):
    assert df.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_ids_equal_the_library():
    r = random.Random(5)
    texts = odd_texts() + ["".join(r.choice("ab  \n\n\t.,12é'") for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["a  b", "a ", " a", "  ", "a\n b", "a \n b", "x" * 70 + " y" * 3, "don't 'll x's", "a \xa0b", "1 2  3", " .", "<|endoftext|>"]
    ids, at = byte_encoder(PATH).encode(pa.array(texts))
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("percentiles", [token_store.PERCENTILES, (0.5,), (1.0,), (0.9,)])
def test_blocks_come_back(percentiles):
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 4096, 65535):
        for ids in (r.integers(0, 50257, n), r.zipf(1.3, n) % 50257, np.full(n, 9), np.where(r.random(n) < 0.03, 2**32 - 1, r.integers(5, 9, n)), np.arange(n) + 2**31):
            raw = token_store.pack(ids, percentiles)
            assert token_store.unpack(raw).tolist() == ids.tolist()


def test_outliers_are_exceptions():
    ids = np.full(1000, 5)
    ids[::2] = 6
    ids[10] = 50000
    assert len(token_store.pack(ids)) == 9 + 125 + 6  # one bit an id, one exception


class _Out(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()
        super().close()


def test_a_file_is_read_by_its_index():
    r = random.Random(2)
    docs = [[r.randrange(50257) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 700]))] for _ in range(200)]
    out = _Out()
    writer = token_store.Writer(out, block=64)
    for a in range(0, 200, 7):
        part = docs[a : a + 7]
        writer.add(np.arange(a, a + len(part)), np.ones(len(part)), np.array([len(d) for d in part]), np.array([x for d in part for x in d], np.int64))
    documents, ids, size = writer.close()
    assert (documents, ids, size) == (200, sum(map(len, docs)), len(out.whole))

    class Counting:
        def __init__(self):
            self.file, self.read = pa.BufferReader(out.whole), 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

    file = Counting()
    reader = token_store.Reader(file)
    for k, d in enumerate(docs):
        file.read = 0
        assert reader.document(k).tolist() == d
        assert file.read <= (len(d) // 64 + 2) * (9 + 64 * 8)  # its own blocks only
    with pytest.raises(ValueError, match="no token file"):
        token_store.Reader(pa.BufferReader(b"x" * 40))


def test_round_trip_of_documents(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert got(registry.QUERIES["op12_patched_token_blocks"](spark, tiny)) == want(rows)


def test_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    rows = [(5, None), (None, "no id"), (-4, ""), (2**40, "last"), (9, " ".join(r.choice(["alpha", "beta,", "gamma."]) for _ in range(120_000)))] + [(100 + i, f"text {i} " * (i % 9)) for i in range(300)]
    df = spark.createDataFrame([(*x, 1, "f", 2) for x in rows], "doc_id long, text string, start int, file string, IDS int").repartition(3)
    monkeypatch.setattr(token_store, "RUN", 1000)  # many runs a file
    monkeypatch.setattr(token_store, "READ", 300)
    out = token_store.read_tokens(token_store.write_tokens(df, PATH, block=128), bodies=True)
    assert got(out) == want(rows)
    assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.n_tokens for x in out.collect())
    assert got(token_store.round_trip(df.filter("false"), PATH)) == {}


def test_rows_that_share_an_id_are_each_stored(spark):
    df = spark.createDataFrame([(1, "one two")] * 5 + [(1, "three"), (2, "end")], "doc_id long, text string").repartition(3)
    rows = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in token_store.round_trip(df, PATH).collect())
    assert [x[1] for x in rows] == [1] * 6 + [2] and rows[0][0] == 0
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert len({x[3] for x in rows}) == 3
