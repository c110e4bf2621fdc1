"""The pipeline against plain versions of its stages, each on the input that stage had."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import decontamination, toxicity
from rankloom.llm.common import written
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, d), name)
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
    assert list(steps) == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    before, after = map(text, steps["toxicity"])
    score = toxicity.load(model).score if model else lambda t: 0.0
    assert after == {k: t for k, t in before.items() if score(t) < 0.5}

    before, after = map(text, steps["near_duplicates"])
    assert after == {k: before[k] for k, (_, c) in brute.near_duplicates(list(before.items()), 5).items() if k == c}

    before, after = map(text, steps["substring_dedup"])
    want = brute.substring_dedup(list(before.items()))
    assert set(after) == set(before)
    assert all(len(brute.words(after[k])) == n - gone and (gone or after[k] == before[k]) for k, (n, gone, _) in want.items())

    before, after = map(text, steps["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    whole = {k for k, t in before.items() if any(f" {plain(i)} " in f" {plain(t)} " for _, i in items)}
    assert whole.isdisjoint(after)
    hits = {r.doc_id for r in decontamination.matches(steps["decontamination"][0], spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == hits

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, rows = text(steps["packing"][0]), steps["packing"][1].collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in before.items()}


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
