"""Readers with strict contracts, and sinks for tables, results and score files."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import RESIDUES
from rankloom.operators.checks import ContractError, require_columns, require_counts, require_none

PAIRS = "Peptide string, HLA string, CDR3a string, CDR3b string, CDR1a string, CDR2a string, CDR1b string, CDR2b string, Target int"
SOLUTIONS = PAIRS.replace("Target int", "ID string, Label int, Usage string")
THRESHOLD, ARTIFICIAL = 0.426, 0.01


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", columns: list[str] | None = None, hint: str = "") -> DataFrame:
    """CSV or TSV with a header, as strings or by name with the given types; a missing file names the hint."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} is missing{'; ' + hint if hint else ''}")
    raw = spark.read.csv(path, header=True, sep=sep)
    if schema:
        kinds = dict(x.split() for x in schema.split(", "))
        require_columns(raw, *kinds)
        raw = raw.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in kinds.items()))
    return raw.select(*(F.col(f"`{c}`") for c in columns)) if columns else raw


def load_train(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAIRS)


def load_test(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_csv(spark, path), "ID")


def load_solutions(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path)
    return require_columns(raw, "ID", "Label", "Usage").withColumn("Label", F.col("Label").cast("int"))


def read_folds(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """(Peptide, Affinity, Allele, Fold, Target, RowType) of exactly these files of three white-space-separated fields.

    A line with another number of fields (a blank one too), a letter outside the alphabet, or an affinity outside [0, 1] is
    an error that names file and line.
    """
    present = sorted(Path(r[0]).name for r in spark.read.format("binaryFile").load(f"{folder}/*_ba").select("path").collect())
    require_counts("fold files", dict.fromkeys(files, 1), dict.fromkeys(present, 1))
    parts = []
    for name in files:
        # whole text by file, split with its line numbers: fold files are small, and a number can't come from a split file
        text = spark.read.text(f"{folder}/{name}", wholetext=True)
        lines = text.select(F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("line", "raw"))
        parts.append(lines.select(F.lit(name).alias("Fold"), (F.col("line") + 1).alias("line"), F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"\s+").alias("f")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    affinity = F.expr("try_cast(f[1] as double)")
    fine = (F.size("f") == 3) & F.col("f")[0].rlike(rf"\A[{RESIDUES}]+\z") & affinity.isNotNull() & ~F.isnan(affinity) & affinity.between(0, 1)
    require_none(rows.filter(~F.coalesce(fine, F.lit(False))).orderBy("Fold", "line").select("Fold", "line"), "bad lines (file, line)")
    rows = rows.select(F.col("f")[0].alias("Peptide"), affinity.alias("Affinity"), F.col("f")[2].alias("Allele"), "Fold")
    return with_labels(rows)


def with_labels(rows: DataFrame) -> DataFrame:
    """Target (affinity above the threshold, strictly) and RowType."""
    kind = F.when(F.col("Affinity") > THRESHOLD, "positive").when(F.col("Affinity") == ARTIFICIAL, "artificial_negative").otherwise("measured_nonbinder")
    return rows.withColumns({"Target": F.col("Affinity") > THRESHOLD, "RowType": kind})


def nine_mers(rows: DataFrame, length: int = 9) -> DataFrame:
    allele = F.col("Allele")
    return rows.filter((allele.startswith("HLA-A") | allele.startswith("HLA-B") | allele.startswith("HLA-C")) & (F.length("Peptide") == length))


def load_pseudo_sequences(spark: SparkSession, path: str, alleles: DataFrame, length: int = 34) -> DataFrame:
    """(Allele, sequence) of the alleles; keys in the file have no colon, the last of repeated keys wins."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    f = F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"\s+")
    rows = text.filter(F.length(F.regexp_replace("raw", r"\s", "")) > 0).groupBy(f[0].alias("_key")).agg(F.max_by(f[1], "line").alias("sequence"))
    out = alleles.select("Allele").distinct().withColumn("_key", F.replace("Allele", F.lit(":"), F.lit(""))).join(rows, "_key", "left")
    require_none(out.filter(F.col("sequence").isNull() | (F.length("sequence") != length)).select("Allele"), "alleles without a sequence of the right length")
    return out.select("Allele", "sequence")


def load_contract(spark: SparkSession, path: str) -> dict[str, Any]:
    """The JSON object of a small file, wherever Spark can read it."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} is missing")
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ContractError(f"{path} holds no object")
    return found


def file_digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 by file name."""
    rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha")).collect()
    return {r["path"].rpartition("/")[2]: r["sha"] for r in rows}


def source_counts(rows: DataFrame) -> dict[str, int]:
    hla = F.col("Allele").rlike("^HLA-[ABC]")
    nine = hla & (F.length("Peptide") == 9)
    row = rows.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(hla).alias("hla_rows"), F.count_if(hla & F.col("Target")).alias("hla_positive"),
        F.count_if(hla & (F.col("RowType") == "artificial_negative")).alias("hla_artificial"),
        F.count_if(nine).alias("nine_mer_rows"), F.count_if(nine & F.col("Target")).alias("nine_mer_positive"), F.count_if(nine & ~F.col("Target")).alias("nine_mer_negative"),
    ).first()
    return row.asDict()


def headline_counts(rows: DataFrame, group: str = "Allele") -> dict[str, int]:
    return rows.agg(
        F.countDistinct(group).alias("alleles"), F.count(F.lit(1)).alias("rows"), F.count_if("Target").alias("positive"), F.count_if(~F.col("Target")).alias("negative"),
        F.count_if(F.col("RowType") == "measured_nonbinder").alias("measured"), F.count_if(F.col("RowType") == "artificial_negative").alias("artificial"),
    ).first().asDict()


def verify_source(digests: dict[str, str], contract: dict[str, Any], counts: dict[str, int], headline: dict[str, int]) -> None:
    """Digests and counts equal the contract's, key sets included."""
    want = contract["file_sha256"]
    missing = sorted(want.keys() ^ digests.keys())
    wrong = sorted(k for k in want.keys() & digests.keys() if want[k] != digests[k])
    if missing or wrong:
        raise ContractError(f"file digests: not in both {missing}, different {wrong}")
    require_counts("source_counts", contract["source_counts"], counts)
    require_counts("headline_counts", contract["headline_counts"], headline)


def require_cohort(counts: dict[str, int], fixed: dict[str, int]) -> None:
    require_counts("cohort", fixed, counts)


def read_joined_objects(spark: SparkSession, path: str, left: str, right: str, fields: list[str]) -> DataFrame:
    """(key, fields of both sides) of two objects in one JSON document, joined by key; a missing side or field is an error."""
    raw = spark.read.text(path, wholetext=True)
    side = lambda name: raw.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), "map<string, map<string, double>>")).alias("key", name))
    a, b = side(left), side(right)
    both = a.join(b, "key", "full")
    require_none(both.filter(F.col(left).isNull() | F.col(right).isNull()).select("key"), "keys on one side only")
    out = both.select("key", *(F.coalesce(F.try_element_at(left, F.lit(f)), F.try_element_at(right, F.lit(f))).alias(f) for f in fields))
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    require_none(out.filter(missing).select("key"), "missing fields")
    return out


def write_vectors(df: DataFrame, path: str) -> None:
    """(model, layer, sequence, vec) by model and layer, so a reader of one layer opens only its files."""
    require_columns(df, "model", "layer", "sequence").write.partitionBy("model", "layer").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str, layer: int) -> DataFrame:
    out = spark.read.parquet(path).filter((F.col("model") == model) & (F.col("layer") == layer))
    if out.isEmpty():
        raise ContractError(f"{path} holds no vectors of {model}, layer {layer}")
    return out


RAGGED = "model string, layer int, sequence string, n int, residues array<float>"


def write_residues(df: DataFrame, path: str, rows_a_group: int = 4096) -> None:
    """(model, layer, sequence, residues: one vector a residue) as a ragged store: by model and layer, sorted by sequence.

    A row holds all components of a sequence in one flat array and their number n of residues, so nothing is padded; sorted
    files of small row groups let a reader of selected sequences skip the rest by the groups' smallest and largest sequence.
    """
    require_columns(df, "model", "layer", "sequence", "residues")
    empty = df.filter("residues is null or size(residues) = 0").select("sequence")
    require_none(empty, "sequences without residues")
    require_none(df.filter(F.exists("residues", lambda v: F.size(v) != F.size(F.col("residues")[0]))).select("sequence"), "sequences with residues of different width")
    flat = df.select("model", "layer", "sequence", F.size("residues").alias("n"), F.flatten("residues").cast("array<float>").alias("residues"))
    dealt = flat.repartitionByRange("model", "layer", "sequence").sortWithinPartitions("model", "layer", "sequence")
    dealt.write.partitionBy("model", "layer").option("parquet.block.row.count.limit", rows_a_group).option("parquet.page.row.count.limit", 256).parquet(path)


def read_residues(spark: SparkSession, path: str, model: str, layer: int, sequences: list[str] | DataFrame | None = None) -> DataFrame:
    """(sequence, residues) of one model and layer, of the selected sequences only where they are given.

    A list reaches the scan as a filter that skips row groups; a table is joined. A sequence that isn't there, or no vectors
    of the model and layer, is an error.
    """
    stored = spark.read.schema(RAGGED).parquet(path).filter((F.col("model") == model) & (F.col("layer") == layer))
    if stored.isEmpty():
        raise ContractError(f"{path} holds no residues of {model}, layer {layer}")
    if sequences is not None:
        asked = sequences.select("sequence").distinct() if isinstance(sequences, DataFrame) else spark.createDataFrame([(x,) for x in sorted(set(sequences))], "sequence string")
        stored = stored.join(asked, "sequence", "left_semi") if isinstance(sequences, DataFrame) else stored.filter(F.col("sequence").isin(sorted(set(sequences))))
        require_none(asked.join(stored, "sequence", "left_anti"), "sequences without residues")
    width = F.expr("cast(size(residues) div n as int)")
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.slice("residues", k * width + 1, width))
    return stored.select("sequence", rows.alias("residues"))


def validate_vectors(vectors: DataFrame, expected: DataFrame, key: str = "sequence", vec: str = "vec") -> DataFrame:
    """The same vectors, if their keys are exactly the expected ones and every component is finite."""
    from rankloom.operators.checks import same_keys

    same_keys(vectors, expected, key)
    require_none(vectors.filter(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(key), "vectors that are not finite")
    return vectors


def load_or_build_vectors(spark: SparkSession, path: str, model: str, layer: int, expected: DataFrame, build) -> DataFrame:
    """Vectors from `path`, made by `build(expected)` first where there are none."""
    if not _exists(spark, path):
        write_vectors(build(expected).withColumns({"model": F.lit(model), "layer": F.lit(layer)}), path)
    return validate_vectors(read_vectors(spark, path, model, layer), expected)


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """One small file, through Spark's file system; an existing one is never overwritten."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(content.encode()))
    out.close()


def write_json(record: dict[str, Any], path: str, sort_keys: bool = True, allow_nan: bool = False) -> None:
    """A small result record, two spaces deep; a number that is not finite is an error."""
    text = json.dumps(record, indent=2, sort_keys=sort_keys, allow_nan=allow_nan)
    Path(path).write_text(text + "\n")


def null_nan(value: Any) -> Any:
    """NaN as null, at every depth."""
    if isinstance(value, dict):
        return {k: null_nan(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [null_nan(v) for v in value]
    return None if isinstance(value, float) and math.isnan(value) else value


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.csv(path, header=True)


def submission(test: DataFrame, scores: DataFrame, columns: list[str], row_id: str, score: str = "score", out: str = "Prediction", order: str | None = None) -> DataFrame:
    """Template columns in the order of the test rows, with scores clipped to [0, 1]; a row without a score is an error.

    order: the column that holds the template's order, where that isn't row_id.
    """
    require_none(test.join(scores.filter(F.col(score).isNotNull()), row_id, "left_anti").select(row_id), "rows without a score")
    joined = test.join(scores.select(row_id, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))).alias(out)), row_id)
    return joined.orderBy(order or row_id).select(*columns, out)


def external_predictions(predictions: DataFrame, supported: DataFrame, group: str, affinity: str, least_groups: int = 0, least_share: float = 0.0) -> DataFrame:
    """Predictions of supported groups with score = -affinity.

    Coverage comes first: fewer supported groups than least_groups, or a smaller share of rows than least_share, is an error.
    """
    names = supported.select(group).distinct().withColumn("_in", F.lit(True))
    marked = predictions.join(names, group, "left")
    if least_groups or least_share:
        found = marked.agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("inside"), F.countDistinct(F.when(F.col("_in"), F.col(group))).alias("groups")).first()
        if found.groups < least_groups or found.inside < least_share * found.n:
            raise ContractError(f"{found.groups} groups and {found.inside} of {found.n} rows are supported, too few")
    return marked.filter("_in").drop("_in").withColumn("score", -F.col(affinity)).select(*predictions.columns, "score")
