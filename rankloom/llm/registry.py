"""Registered corpus queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import anisotropic, decontamination, language, licences, neardup, packing, sharding, sortmeans, substring, token_store, toxicity, variants, warc
from rankloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op1_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return anisotropic.search(vectors, F.col("vec_id") % 20 == 0)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, *language.learn(docs))


def op9_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_patched_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which lies beside this package and is needed by this query alone."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op10_minmax_near_duplicates": op10_minmax_near_duplicates,
    "op1_super_kmer_dedup": op1_super_kmer_dedup,
    "op7_compression_toxicity": op7_compression_toxicity,
    "op5_seeded_alignment": op5_seeded_alignment,
    "op3_anisotropic_search": op3_anisotropic_search,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op6_language_mixture": op6_language_mixture,
    "op9_licence_dice": op9_licence_dice,
    "op11_sort_means": op11_sort_means,
    "op12_patched_token_blocks": op12_patched_token_blocks,
    "op13_spelling_variants": op13_spelling_variants,
}


def _sort_means_sql() -> str:
    """Every round of op11 as two queries: nearest centroid of each vector by a full scan, then the new centroids."""
    k, dims = sortmeans.K, sortmeans.DIMS
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor({sortmeans.SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"named AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{sortmeans.SEED}:' || vec_id)) - 1 AS c FROM kept)",
        f"c0 AS MATERIALIZED (SELECT named.c, v.i, v.x FROM v JOIN named USING (vec_id) WHERE named.c < {k})",
    ]
    for n in range(sortmeans.ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} AS c USING (i) GROUP BY ALL) GROUP BY vec_id)")
        if n < sortmeans.ROUNDS:
            steps.append(f"s{n} AS (SELECT a.c, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{n} AS a USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{n} AS c LEFT JOIN s{n} AS s USING (c, i))")
    last = sortmeans.ROUNDS
    steps.append(f"names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, names.centroid_sha256 FROM a{last} AS a JOIN names USING (c)"


#: Of the others, compression, hashing, alignment, learning, tokenizing and packing have no SQL form; tests compare with brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {"op11_sort_means": _sort_means_sql()}
