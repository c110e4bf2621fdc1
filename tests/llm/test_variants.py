"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from rankloom.llm import registry, variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(docs, error=199, length=6, count=5):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % error == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= count}


def brute(words, ratio=5):
    out = {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, n, len(others), -best[0] if form else None]
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {tuple(r) for r in df.collect()}


def found(spark, words, **kw):
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return {tuple(r) for r in variants.roots(variants.forms(table, **kw)).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("most", [2, 5, 128])
def test_all_pairs_at_any_block_size(spark, most):
    """Two letters make crowded blocks, which are divided down to one open place."""
    r = random.Random(most)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(6, 12))): r.choice([5, 6, 30, 160, 900, 5000]) for _ in range(500)}
    words |= {"".join(r.choice("abcdéÿ×") for _ in range(r.randrange(6, 9))): r.choice([5, 7, 40]) for _ in range(300)}
    assert found(spark, words, most=most) == brute(words)


def test_each_pair_once(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(6, 10))) for _ in range(400)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for most in (3, 40, 1000):
        pairs = [(x.word, x.other) for x in variants.near_words(table, most).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if near(a, b)}


def test_blocks_stay_small_where_all_words_share_a_prefix(spark):
    r = random.Random(4)
    words = sorted({"pre" * 5 + "".join(r.choice("abcdef") for _ in range(r.randrange(8, 14))) for _ in range(3000)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = variants.blocks(table, 50).groupBy("m", "a", "b", "cap", "head", "tail").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 50


def test_long_chains_and_ties(spark):
    chain = {"aaaaaa" + "b" * i: 5 * 6**i for i in range(9)}
    ties = {"zzzzzzx": 5, "zzzzzzé": 50, "zzzzzzy": 50, "zzzzzzw": 49}
    rows = found(spark, chain | ties)
    assert rows == brute(chain | ties)
    assert {x[2] for x in rows if x[0].startswith("a")} == {"aaaaaa" + "b" * 8}


def test_whole_operator_on_texts(spark):
    r = random.Random(6)
    stems = ["receive", "straße", "Naïveté", "computer", "ÀÉÎ×÷ø", "language", "languages", "modelling"]
    docs = []
    for d in range(400):
        w = [r.choice(stems) for _ in range(60)]
        w = [x[:2] + r.choice("aeE") + x[3:] if r.random() < 0.15 else x.upper() if r.random() < 0.1 else x for x in w]
        docs.append((d, r.choice([" ", "-", "\n", "9", "."]).join(w)))
    docs += [(None, "receive " * 300), (7, docs[7][1]), (1000, None), (1001, ""), (1002, "computer " * 50_000), (1003, "x" * 30_000 + " " + "x" * 29_999 + "y "), (1004, ("w" * 3000 + " ") * 6 + ("w" * 2999 + " ") * 40)]
    df = spark.createDataFrame([(*x, 3, "q") for x in docs], "doc_id long, text string, n int, Word string").repartition(4)
    for error in (199, 3):
        words = brute_words(docs, error)
        assert got(variants.variants(df, error=error)) == brute(words)
    assert got(variants.variants(df.filter("false"))) == set()


def test_query_equals_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    words = brute_words(docs)
    assert len(words) > 100
    assert got(registry.QUERIES["op13_spelling_variants"](spark, tiny)) == brute(words)
