import random

import numpy as np
from pyspark.sql import Row

from rankloom.llm import substring
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name long, core long"


def frame(spark, docs):
    return spark.createDataFrame([Row(d, t, None, "s", 0, 1, 2) for d, t in docs], SCHEMA)


def digest(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, other = draw(80), draw(55)
    docs = []
    for i in range(80):
        w = draw(r.randrange(150))
        if r.random() < 0.6:
            at = r.randrange(len(w) + 1)
            w = w[:at] + passage[r.randrange(20) : 80 - r.randrange(15)] + w[at:]
        if r.random() < 0.3:
            w = w + other
        docs.append((i * 3, "\n".join(w[: len(w) // 2]) + " \t" + " ".join(w[len(w) // 2 :])))
    docs += [(500 + i, docs[7][1]) for i in range(6)] + [(600, None), (601, ""), (602, " \n"), (603, "a " * 400), (604, "a " * 60), (605, "é x " * 70), (606, "é x " * 70)]
    return docs


def test_against_all_windows(spark):
    docs = corpus(1)
    random.Random(0).shuffle(docs)
    assert digest(substring.substring_digest(frame(spark, docs))) == brute.substring_dedup(docs)


def test_hot_minimisers_take_the_other_way(spark):
    docs = corpus(2)
    spans = {r.doc_id: r.spans for r in substring.removed_spans(frame(spark, docs), hot=1).collect()}
    want = brute.substring_dedup(docs)
    for d, (n, removed, _) in want.items():
        assert int((~substring._mask(n, spans.get(d))).sum()) == removed


def test_on_documents(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert digest(substring.substring_digest(df)) == brute.substring_dedup(docs)


def test_cut_repeats_keeps_rows_and_other_texts(spark):
    docs = corpus(3)
    before = dict(docs)
    want = brute.substring_dedup(docs)
    out = substring.cut_repeats(frame(spark, docs))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, removed, _ = want[r.doc_id]
        assert len(brute.words(r.text)) == n - removed
        if not removed:
            assert r.text == before[r.doc_id]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70))
    docs = [(1, long), (1, long), (None, long), (0, "w0 " * 10), (2, long)]
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.substring_digest(frame(spark, docs)).collect())
    assert rows == [("0", 10, 0), ("1", 70, 0), ("1", 70, 0), ("2", 70, 70), ("None", 70, 0)]
    assert substring.substring_digest(frame(spark, [])).collect() == []


def test_equal_hashes_of_other_words(monkeypatch):
    monkeypatch.setattr(substring, "span_hash", lambda v, a, b, which=0: np.zeros(len(a), np.uint64))
    of, least = substring.smallest_by_window([b"a b c", b"b c d", b"x b c"], [5, 3, 1], 2)
    assert of.tolist() == [0, 0, 1, 1, 2, 2]
    assert least.tolist() == [5, 1, 1, 3, 1, 1]


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 100, 60)
    for width in (1, 2, 3, 7, 8, 43):
        assert substring.sliding_min(v, width).tolist() == [v[i : i + width].min() for i in range(len(v) - width + 1)]


def test_texts_that_share_an_id_are_judged_apart(spark):
    """A row of the same doc_id but another text keeps its own words; it may still lose those that an earlier document has."""
    r = random.Random(8)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(70)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " " + c), (3, c), (3, c), (2, None), (2, "short")]
    for hot in (1000, 1):
        spans = substring.removed_spans(frame(spark, rows), hot=hot)
        assert {(x.doc_id, len(x.spans) > 0) for x in spans.collect()} == {(2, True), (3, True)}
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring.substring_digest(frame(spark, rows)).collect())
    assert got == [(1, 70, 0), (2, 0, 0), (2, 1, 0), (2, 70, 0), (2, 70, 70), (3, 70, 0), (3, 70, 0), (3, 140, 70)]
    kept = sorted((x.doc_id, x.text or "") for x in substring.cut_repeats(frame(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, ""), (2, b), (3, c), (3, c), (3, c), (2, ""), (2, "short")])


def test_texts_that_repeat_themselves_travel_in_bounded_strings(spark):
    docs = [(d, "again " * (300 + 7 * d) + f"end{d} ") for d in range(60)] + [(100 + d, ("a b " * (400 + d)) + f"x{d}") for d in range(20)]
    assert digest(substring.substring_digest(frame(spark, docs))) == brute.substring_dedup(docs)
    text = substring.Words(substring.pa.array(["again " * 20_000]))
    _, start, n = substring.super_kmers(text, 50, 8)
    assert n.max() <= substring.LONGEST and n.sum() == 20_000 - 49 and (start[1:] == start[:-1] + n[:-1]).all()
    strings = substring._strings(frame(spark, docs), _wanted(spark, docs), 50).collect()
    assert max(len(x.body.split()) for x in strings) <= substring.LONGEST + 49


def _wanted(spark, docs):
    places = substring._places(frame(spark, docs), 50, 8)
    return places.selectExpr("core", "name", "doc_id", "mark", "start", "n", "false AS hot")
