"""Clashing column names, the shared folder, components in few rounds, repeated attempts and recall at a larger size."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.llm import anisotropic, common, components, language, packing, sharding, substring, warc


def labels(df):
    return {r.node: r.label for r in df.collect()}


def test_long_paths_and_stars_take_few_rounds(spark):
    r = random.Random(0)
    names = list(range(2000))
    for order in (names, names[::-1], r.sample(names, 2000), names[::2] + names[1::2][::-1]):
        edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
        found, rounds = components._rounds(edges)
        assert set(labels(found).values()) == {0} and found.count() == 2000
        assert rounds <= 25, rounds
    star = spark.createDataFrame([(1999, i) for i in range(1999)] + [(5000, 5001), (5001, 5001), (None, 3)], "a long, b long")
    found, rounds = components._rounds(star)
    assert rounds <= 4
    assert labels(found) == {i: 0 for i in range(2000)} | {5000: 5000, 5001: 5000}


def test_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = labels(components.components(spark.createDataFrame(edges, "a long, b long")))
    assert got == {n: find(n) for e in edges for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_cluster_needs_a_shared_folder():
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(applicationId="x", master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(fake(master))
    assert common.is_local("local") and common.is_local("local[*]")


def test_cut_repeats_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(d, text, [1, 2], "a", "b", "c") for d in (1, 2)], "doc_id long, text string, spans array<int>, _doc string, row string, body string")
    out = substring.cut_repeats(df)
    assert out.dtypes == df.dtypes  # no n_chars where there was none
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == text and got[2].text == "" and all((r.spans, r._doc, r.row, r.body) == ([1, 2], "a", "b", "c") for r in got.values())


def test_hot_strings_are_cut_at_every_level(spark, monkeypatch):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    docs = [(d, " ".join([f"{d}a{k}" for k in range(r.randrange(9))] + passage[r.randrange(30) : 90 - r.randrange(10)] + [f"{d}z{k}" for k in range(r.randrange(9))])) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {x.doc_id: (x.n_removed, x.kept_sha256) for x in substring.substring_digest(df).collect()}
    for splits in (0, 1, 2):
        monkeypatch.setattr(substring, "SPLITS", splits)
        spans = {x.doc_id: x.spans for x in substring.removed_spans(df, hot=2).collect()}
        for d, text in docs:
            n = len(text.split())
            assert int((~substring._mask(n, spans.get(d))).sum()) == want[d][0]


def test_hilbert_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", 1, 2, 3, "row") for i in range(64)], "id long, source string, place long, _n int, _p int, row string")
    out = sharding.hilbert_shards(df, ["source", "id"], ["id"], 4)
    assert set(out.columns) == {*df.columns, "curve_index", "shard", "slot"}
    assert {(r.place, r._n, r._p, r.row) for r in out.collect()} == {(1, 2, 3, "row")}
    ordered = sharding.hilbert_order(df, ["source"], ["id"])
    assert sorted(r.place for r in ordered.collect()) == list(range(64))  # the result's own column


def test_each_dimension_leaves_shards_unread(spark):
    """Names with one long prefix; a predicate on any dimension must not touch most of the shards."""
    r = random.Random(4)
    rows = [(i, f"https://one.example.org/collection/{r.randrange(40):02d}", r.choice("abcd"), r.randrange(10**6)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, source string, lang string, size long")
    out = sharding.hilbert_shards(df, ["source", "lang", "size"], ["id"], 16).toPandas()
    for dim in ("source", "lang"):
        assert out.groupby(dim).shard.nunique().mean() < 10, dim
    low = out[out["size"] < 200_000]
    assert low.shard.nunique() <= 9


def test_pack_rows_replaces_an_offset(spark):
    df = spark.createDataFrame([(i, 100, "mine", 5) for i in range(30)], "id long, length long, offset string, sequence_id int")
    out = packing.pack_rows(df)
    assert out.columns == ["id", "length", "sequence_id", "offset"] and sorted(r.offset for r in out.collect())[:3] == [0, 0, 100]


def test_search_stops_only_without_a_step():
    lengths = np.r_[np.full(40, 5), np.full(40, 3)]
    worst = [[i] for i in range(80)]  # every bin underfull: more donors than any short list
    assert len(packing.local_search(worst, lengths, 8)) == 40
    tiny = np.r_[np.ones(5000, np.int64), np.full(30, 700)]
    bins = packing.pack(tiny, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5030)) and len(bins) == 15  # two of the long ones a bin


def test_archives_of_lost_attempts_go(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "part-000000-999.warc.gz").write_bytes(b"left by an attempt that was lost")
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>") for i in range(40)], "page_id long, url string, html string")
    index = warc.write_archives(df.repartition(3), folder)
    named = {r.file.rpartition("/")[2] for r in index.select("file").distinct().collect()}
    assert {p.name for p in (tmp_path / "archive").iterdir() if p.name.startswith("part-")} == named
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == 40 and sum(r.record_type == "response" for r in got.values()) == 3
    again = warc.write_archives(df.repartition(5).orderBy(F.desc("page_id")))  # rows in another order, other files
    assert {(r.page_id, r.payload_digest, r.refers_to) for r in warc.read_records(again).collect()} == {(r.page_id, r.payload_digest, r.refers_to) for r in got.values()}


def test_many_revisits_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "same" if i % 3 else f"own {i}") for i in range(60)] + [(None, "u", "same")], "page_id long, url string, html string")
    want = sorted(map(str, warc.plan_records(df).collect()))
    monkeypatch.setattr(warc, "FEW", 0)
    assert sorted(map(str, warc.plan_records(df).collect())) == want


def test_more_than_64_languages(spark):
    r = random.Random(6)
    names = [f"l{k:02d}" for k in range(70)]
    words = {n: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}{v}" for c in "bcdfg" for v in "aeiou"] for k, n in enumerate(names)}
    docs = [(i, " ".join(r.choice(words[n]) for _ in range(40)), n) for i, n in enumerate(names * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found, table = language.learn(df)
    assert found == names and table.shape[0] == 70
    got = language.identify(df, found, table).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(x.lang_pred == x.lang for x in got)
    assert language.table_bits(1 << 12) == 12


def test_recall_at_200000_vectors(spark, tmp_path):
    n = 200_000
    x = np.random.default_rng(0).normal(size=(n, 64)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    got = anisotropic.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 2000 == 0).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        hit += len(set(np.argpartition(-score, 20)[:20].tolist()) & set(own["vec_id"]))
    assert len(got) == 2000 and hit / 2000 >= 0.95
