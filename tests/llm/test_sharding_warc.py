import base64
import hashlib
import zlib

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from rankloom.llm import sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, place long, shard string"


def test_curve_visits_each_cell_by_unit_steps(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = [(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"c{k}") for k in range(dims)]
        df = spark.range(side**dims).select(*cells)
        got = np.array(df.select(*df.columns, sharding.hilbert_index([F.col(c) for c in df.columns], bits)).collect())
        got = got[np.argsort(got[:, -1])]
        assert got[:, -1].tolist() == list(range(side**dims))
        assert (np.abs(np.diff(got[:, :-1], axis=0)).sum(1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    docs = [(i, f"text {i % 7}" * (i % 50), ["en", "fr", None][i % 3], f"s{i % 5}", 0, "z") for i in range(205)] + [(900, None, None, None, 0, "z"), (901, "", "en", "s1", 0, "z"), (901, "", "en", "s1", 0, "z")]
    df = spark.createDataFrame([Row(*d) for d in docs], SCHEMA)
    rows = sharding.shard_documents(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    texts = {d[0]: d[1] or "" for d in docs}
    by = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows", None)
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    order = [r.curve_index for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.shard_documents(df.limit(0)).collect() == []
    few = sharding.shard_documents(df.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)


def test_write_shards_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([Row(i, "t" * i, "en", f"s{i % 4}", 0, "z") for i in range(64)], SCHEMA).withColumn("size", F.length("text"))
    out = sharding.hilbert_shards(df.drop("shard", "place"), ["source", "size"], ["doc_id"], 4)
    sharding.write_shards(out, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 64
    lines = sharding.manifest(out, ["source", "size"]).collect()
    assert len(lines) == 4 and all(r.n_rows == 16 for r in lines)


PAGES = "page_id long, url string, html string, length long, payload string"


def test_round_trip(spark):
    pages = [(i, f"http://x/{i}", f"<p>{'é' * (i % 9)}</p>", 0, "z") for i in range(50)] + [(100, None, None, 0, "z"), (101, "http://e\r\n/", "", 0, "z"), (102, "", "long " * 50_000, 0, "z"), (None, "http://n", "<p></p>", 0, "z")]
    df = spark.createDataFrame([Row(*p) for p in pages], PAGES)
    rows = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(rows) == len(pages)
    head, sha = {}, {}
    for p in pages:
        body = (p[2] or "").encode()
        sha[p[0]] = (base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body))
        if p[0] is not None:
            head[sha[p[0]][0]] = max(head.get(sha[p[0]][0], -1), p[0])
    for p, r in rows.items():
        assert (r.payload_digest, r.payload_bytes) == sha[p]
        first = p is None or head[sha[p][0]] == p
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", head[sha[p][0]]))
    assert warc.round_trip(df.limit(0)).collect() == []


def test_selected_records_come_with_bodies(spark):
    df = spark.createDataFrame([Row(i, f"http://x/{i}", f"<p>{i}</p>", 0, "z") for i in range(30)], PAGES)
    index = warc.write_archives(df.repartition(3))
    got = warc.read_records(index.filter("page_id % 4 = 1"), bodies=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: f"<p>{i}</p>" for i in range(1, 30, 4)}


def test_coalesce():
    assert warc.coalesce([(0, 10), (10, 5), (100, 10), (400, 10)], gap=100, span=1000) == [(0, 110, 3), (400, 410, 1)]
    assert warc.coalesce([(0, 10), (10, 10)], gap=0, span=15) == [(0, 10, 1), (10, 20, 1)]
    assert warc.coalesce([]) == []
