import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from rankloom.llm import neardup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shingles string, rep long"


def frame(spark, docs):
    return spark.createDataFrame([Row(d, t, None, "s", 0, "x", 1) for d, t in docs], SCHEMA)


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(seed, base, n, edits):
    """Copies of one text with a few words changed each."""
    r = random.Random(seed)
    w = [f"w{r.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        v = list(w)
        for _ in range(edits(r)):
            v[r.randrange(len(v))] = f"e{r.randrange(10**6)}"
        out.append((base + i, " ".join(v)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, k):
    docs = family(1, 100, 60, lambda r: r.randrange(5)) + family(2, 400, 40, lambda r: r.randrange(9)) + family(3, 700, 20, lambda r: 0)
    docs += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one two three"), (8, "x " * 9000)]
    random.Random(0).shuffle(docs)
    got = result(neardup.near_duplicates(frame(spark, docs), words=k))
    assert got == brute.near_duplicates(docs, k)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    docs = family(5, 100, 90, lambda r: r.randrange(3, 9)) + family(6, 900, 30, lambda r: r.randrange(12))
    assert result(neardup.near_duplicates(frame(spark, docs), words=4)) == brute.near_duplicates(docs, 4)


def test_on_documents(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert result(neardup.near_duplicates(df, words=4)) == brute.near_duplicates(docs, 4)


def test_one_word_runs_and_repeated_rows(spark):
    docs = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (None, "a b c d e"), (3, "q")]
    rows = neardup.near_duplicates(frame(spark, docs), words=4).collect()
    assert len(rows) == 5
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = neardup.keep_one(frame(spark, docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "3", "None"]


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_min_max_estimates_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = x[:1000], x[200:]
    low, high = neardup.min_max(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    same = ((low[0] == low[1]).mean() + (high[0] == high[1]).mean()) / 2
    assert abs(same - 800 / 1200) < 0.06


def test_sets_of_a_sliced_column():
    column = pa.array(["skip", "a b c d e", None, "A b", "a b c d e"]).slice(1)
    values, at = neardup.shingle_sets(column, 4)
    assert np.diff(at).tolist() == [2, 0, 1, 2]
    assert values[:2].tolist() == values[3:].tolist()
