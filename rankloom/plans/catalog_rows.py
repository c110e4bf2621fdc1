"""Registered queries of the readers, guards, row operators and expressions, with the DuckDB SQL that checks them."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import rng, text, vector
from rankloom.operators import checks, metrics, models, ordering, resampling, retrieval, rows, sampling, splits, stats, summary
from rankloom.plans import experiment
from rankloom.plans.catalog import AFFIN, GRADED, OWNERS, PART_G, affin, graded, metrics_sql, owners, paired, points, query, r6, regions
from rankloom.sources import io
from rankloom.sources.tables import scratch, table

LETTERS = "translate(lpad(cast(c_custkey as varchar), 9, '0'), '0123456789', 'ACDEFGHIKL')"
LETTERS_SPARK = "translate(lpad(cast(c_custkey as string), 9, '0'), '0123456789', 'ACDEFGHIKL')"
FOLDS = [f"c00{k}_ba" for k in range(5)]


def _csv(spark: SparkSession, df: DataFrame, sep: str = ",") -> str:
    path = scratch(spark, "csv")
    df.write.csv(path, header=True, sep=sep)
    return path


# ---- readers and sinks: each query writes its files first ---------------------------------------------------------------


@query("A01_csv_scan", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, d):
    path = _csv(spark, table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return io.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("A02_training_rows", "select p_name peptide, p_brand hla, cast(p_size > 25 as int) target, count(*) n from part group by all")
def _(spark, d):
    blank = [F.lit("x").alias(c) for c in ("CDR3a", "CDR3b", "CDR1a", "CDR2a", "CDR1b", "CDR2b")]
    path = _csv(spark, table(spark, d, "part").select(F.col("p_name").alias("Peptide"), F.col("p_brand").alias("HLA"), *blank, (F.col("p_size") > 25).cast("int").alias("Target")))
    return io.load_train(spark, path).groupBy(F.col("Peptide").alias("peptide"), F.col("HLA").alias("hla"), F.col("Target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("A02_solutions", "select cast(p_partkey as varchar) id, cast(p_size > 25 as int) label_value, case when p_partkey % 2 = 0 then 'Public' else 'Private' end usage from part")
def _(spark, d):
    p = table(spark, d, "part")
    path = _csv(spark, p.select(F.col("p_partkey").alias("ID"), (F.col("p_size") > 25).cast("int").alias("Label"), F.when(F.col("p_partkey") % 2 == 0, "Public").otherwise("Private").alias("Usage")))
    return io.load_solutions(spark, path).select(F.col("ID").alias("id"), F.col("Label").alias("label_value"), F.col("Usage").alias("usage"))


@query("A03_wide_tsv", "select cast(c_custkey as varchar) c_custkey, c_name, c_mktsegment from customer")
def _(spark, d):
    path = _csv(spark, table(spark, d, "customer"), "\t")
    return io.read_csv(spark, path, sep="\t", columns=["c_custkey", "c_name", "c_mktsegment"])


def _fold_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers as fold files of peptide, affinity and allele, read back."""
    c = table(spark, d, "customer").selectExpr("c_custkey", f"{LETTERS_SPARK} as p", "(c_custkey % 101) / 100 as a", "concat('HLA-A', c_nationkey) as h", "c_custkey % 5 as f")
    folder = scratch(spark, "folds")
    for k, name in enumerate(FOLDS):
        lines = c.filter(F.col("f") == k).orderBy("c_custkey").select(F.concat_ws(" ", "p", "a", "h")).collect()  # a fixture of small files
        io.write_text(spark, "\n".join(r[0] for r in lines) + "\n", f"{folder}/{name}")
    return io.read_folds(spark, folder, FOLDS)


FOLD_SQL = f"select {LETTERS} peptide, (c_custkey % 101) / 100e0 affinity, 'HLA-A' || c_nationkey allele, 'c00' || (c_custkey % 5) || '_ba' fold, (c_custkey % 101) / 100e0 > 0.426e0 target from customer"


@query("A04_fold_rows", f"select peptide, round(affinity, 6) affinity, allele, fold, target from ({FOLD_SQL})")
def _(spark, d):
    return _fold_files(spark, d).select(F.col("Peptide").alias("peptide"), F.round("Affinity", 6).alias("affinity"), F.col("Allele").alias("allele"), F.col("Fold").alias("fold"), F.col("Target").alias("target"))


@query("A05_exact_file_set", f"select fold, count(*) n, count(*) filter (target) n_positive from ({FOLD_SQL}) group by fold")
def _(spark, d):
    return _fold_files(spark, d).groupBy(F.col("Fold").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("Target").alias("n_positive"))


@query("A06_pseudo_sequences", "select n_name allele, rpad(n_name, 34, 'X') sequence from nation")
def _(spark, d):
    n = table(spark, d, "nation").select("n_name", F.rpad("n_name", 34, "X"))
    path = f"{scratch(spark, 'pseudo')}.dat"
    io.write_text(spark, "\n".join(" ".join(r) for r in n.collect()) + "\n", path)  # 25 nations
    return io.load_pseudo_sequences(spark, path, n.select(F.col("n_name").alias("Allele"))).select(F.col("Allele").alias("allele"), "sequence")


@query("A07_contract", "select r_name key, cast(r_regionkey as bigint) n from region")
def _(spark, d):
    path = f"{scratch(spark, 'contract')}.json"
    io.write_text(spark, json.dumps({r[0]: r[1] for r in table(spark, d, "region").select("r_name", "r_regionkey").collect()}), path)  # 5 regions
    return spark.createDataFrame(sorted(io.load_contract(spark, path).items()), "key string, n long")


@query("A08_file_digests", "select 'names.txt' name, sha256(string_agg(n_name, chr(10) order by n_name) || chr(10)) sha from nation")
def _(spark, d):
    folder = scratch(spark, "files")
    io.write_text(spark, "\n".join(r[0] for r in table(spark, d, "nation").select("n_name").orderBy("n_name").collect()) + "\n", f"{folder}/names.txt")  # 25 nations
    return spark.createDataFrame(list(io.file_digests(spark, [f"{folder}/names.txt"]).items()), "name string, sha string")


@query("A09_equal_counts", "select c_mktsegment field, count(*) n from customer group by 1")
def _(spark, d):
    counted = summary.support(affin(spark, d), "g")
    field, n = counted.columns
    found = {r[0]: r[1] for r in counted.collect()}  # a row for each segment
    again = {r[0]: r[1] for r in table(spark, d, "customer").groupBy("c_mktsegment").count().collect()}
    checks.require_counts("segments", again, found)
    return counted.select(F.col(field).alias("field"), F.col(n).alias("n"))


VECTORS_SQL = "select cast(vec_id as varchar) as sequence, round(list_sum(cast(embedding as double[])), 4) total from embeddings"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sequence"), F.col("embedding").alias("vec"))


def _total(df: DataFrame) -> DataFrame:
    return df.select("sequence", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("A10_vector_store", VECTORS_SQL)
def _(spark, d):
    path = scratch(spark, "vectors")
    io.write_vectors(_vectors(spark, d).withColumns({"model": F.lit("small"), "layer": F.lit(3)}), path)
    return _total(io.read_vectors(spark, path, "small", 3))


@query("A19_vector_gate", VECTORS_SQL)
def _(spark, d):
    return _total(io.load_or_build_vectors(spark, scratch(spark, "vectors"), "small", 3, _vectors(spark, d), lambda expected: expected))


@query("A13_csv_sink", "select p_brand, cast(count(*) as varchar) n from part group by 1")
def _(spark, d):
    path = scratch(spark, "sink")
    io.write_csv(table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), path)
    return io.read_csv(spark, path)


@query("A17_external_predictions", "select c_custkey, -c_acctbal score from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def _(spark, d):
    some = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return io.external_predictions(table(spark, d, "customer"), some, "c_nationkey", "c_acctbal").select("c_custkey", "score")


@query("A20_fixed_cohort", f"select count(distinct allele) alleles, count(*) as n, count(*) filter (target) positive from ({FOLD_SQL})")
def _(spark, d):
    rows_ = _fold_files(spark, d)
    found = io.headline_counts(rows_)
    io.require_cohort(found, io.headline_counts(rows_.distinct()))
    return spark.createDataFrame([(found["alleles"], found["rows"], found["positive"])], "alleles long, n long, positive long")


# ---- filters, lookups and set operations ------------------------------------------------------------------------------------


@query("B02_equal_and_not_null", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_custkey is not null and o_totalprice is not null")
def _(spark, d):
    return rows.where_equal(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_custkey", "o_totalprice"]).select("o_orderkey")


@query("B05_nine_mers", f"select peptide, allele from (select {LETTERS} peptide, 'HLA-' || substr('ABCDE', cast(c_custkey % 5 as int) + 1, 1) || c_nationkey allele from customer) where allele[1:5] in ('HLA-A', 'HLA-B', 'HLA-C') and length(peptide) = 9")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr(f"{LETTERS_SPARK} as Peptide", "concat('HLA-', substr('ABCDE', cast(c_custkey % 5 as int) + 1, 1), c_nationkey) as Allele")
    return io.nine_mers(c).select(F.col("Peptide").alias("peptide"), F.col("Allele").alias("allele"))


@query("B08_named_slices", f"""with {GRADED}, x as (select unnest(list_filter([case when y = 1 then 'positive' end, case when s < 0.05e0 then 'low' end, case when not (y = 1 and s < 0.05e0) then 'rest' end, 'all'], lambda z: z is not null)) as slice, y from graded)
  select slice, count(*) n, cast(sum(y) as bigint) n_pos from x group by slice""")
def _(spark, d):
    pos, low = F.col("y") == 1, F.col("s") < 0.05
    out = rows.slices(graded(spark, d), {"positive": pos, "low": low, "rest": ~(pos & low), "all": F.lit(True)})
    return out.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@query("B11_tidy_scores", "select c_custkey, round(greatest(0e0, least(9000e0, coalesce(nullif(c_acctbal, -999e0), 0.5e0))), 1) v from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", rows.tidy(F.col("c_acctbal"), 0.0, 9000.0, 1, 0.5).alias("v"))


@query("C01_semi_join", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.keep_keys(table(spark, d, "orders"), keys, "o_custkey").select("o_orderkey")


@query("C02_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def _(spark, d):
    return rows.leave_out_keys(table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("C03_pair_anti_join", "select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from lineitem k where k.l_returnflag = 'R' and k.l_partkey = l.l_partkey and k.l_suppkey = l.l_suppkey)")
def _(spark, d):
    line = table(spark, d, "lineitem")
    return rows.leave_out_keys(line, line.filter("l_returnflag = 'R'"), "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("C04_lookup", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def _(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rows.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("C05_guarded_pairs", f"with {OWNERS} select count(*) n, count(distinct pool.g) n_groups from pos, pool where pos.g <> pool.g")
def _(spark, d):
    out = sampling.sample(owners(spark, d), "g", "seq", "i", "uniform", guard=None)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("n_groups"))


@query("C06_best_in_group", """with s as (select n.n_regionkey g, n.n_name seq, m.n_name entry, 1e0 - cast(levenshtein(n.n_name, m.n_name) as double) / greatest(length(n.n_name), length(m.n_name)) sim from nation n join nation m on n.n_regionkey = m.n_regionkey)
  select g, seq, arg_min(entry, row(-sim, entry)) nearest, round(max(sim), 6) score from s where sim < 1 group by g, seq""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("seq"))
    out = retrieval.nearest_positive(n, retrieval.database(n, "g", "seq"), "g", "seq", leave_out_exact=True)
    return out.filter("score > 0").select("g", "seq", "nearest", F.round("score", 6).alias("score"))


@query("C10_joined_objects", "select n_name key, cast(n_nationkey as double) a, cast(n_regionkey as double) b from nation")
def _(spark, d):
    found = table(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey").collect()  # 25 nations
    path = f"{scratch(spark, 'objects')}.json"
    io.write_text(spark, json.dumps({"left": {r[0]: {"a": float(r[1])} for r in found}, "right": {r[0]: {"b": float(r[2])} for r in found}}), path)
    return io.read_joined_objects(spark, path, "left", "right", ["a", "b"])


@query("C11_zip_rows", "select p_partkey, p_brand, p_retailprice score from part")
def _(spark, d):
    p = table(spark, d, "part")
    return rows.zip_rows(p.select("p_partkey", "p_brand"), p.select("p_partkey", F.col("p_retailprice").alias("score")), "p_partkey")


@query("D10_conditional_counts", "select count(*) n, count(*) filter (l_returnflag = 'R') n_r, round(count(*) filter (l_returnflag = 'R') / cast(count(*) as double), 6) rate from lineitem")
def _(spark, d):
    r = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(r).alias("n_r"), F.round(F.count_if(r) / F.count(F.lit(1)), 6).alias("rate"))


@query("S01_mixed_sort", "select o_orderkey, row_number() over (order by o_orderpriority desc, o_orderdate, o_orderkey) place from orders qualify place <= 50")
def _(spark, d):
    top = rows.mixed_sort(table(spark, d, "orders"), ("o_orderpriority", True), ("o_orderdate", False), ("o_orderkey", False)).limit(50)  # a top-k report
    return top.selectExpr("o_orderkey", "row_number() over (order by o_orderpriority desc, o_orderdate, o_orderkey) as place")


@query("S04_stacked", "select 'customer' part_of, c_nationkey nation, count(*) n from customer group by all union all select 'supplier', s_nationkey, count(*) from supplier group by all")
def _(spark, d):
    both = {"customer": table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))}
    return rows.stacked(both, "part_of").groupBy("part_of", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("S05_shared_keys", "select c_nationkey nation from customer intersect select s_nationkey from supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("S06_missing_keys", "select c_custkey k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct())


@query("S10_conserved", "select count(*) n from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    whole = rows.conserved([o.filter(f"o_orderkey % 3 = {k}") for k in range(3)], o, "o_orderkey")
    return whole.agg(F.count(F.lit(1)).alias("n"))


@query("P15_survivors", "select count(*) n_rows, count(*) filter (c_mktsegment <> 'BUILDING') n_kept from customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return rows.survivors(c, c.filter("c_mktsegment <> 'BUILDING'"), "c_custkey")[1]


# ---- expressions ------------------------------------------------------------------------------------------------------------

NATIONS = "nation a join nation b on a.n_nationkey + 1 = b.n_nationkey"


def _two(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(f"{x}k"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, F.col("ak") + 1 == F.col("bk"))


@query("F01_edit_similarity", f"select a.n_name a, round(1e0 - cast(levenshtein(a.n_name, b.n_name) as double) / greatest(length(a.n_name), length(b.n_name)), 6) sim from {NATIONS}")
def _(spark, d):
    return _two(spark, d).select("a", F.round(text.edit_similarity("a", "b"), 6).alias("sim"))


@query("F02_edit_distance", f"select a.n_name a, cast(levenshtein(a.n_name, b.n_name) as int) distance from {NATIONS}")
def _(spark, d):
    return _two(spark, d).select("a", text.edit_distance("a", "b").cast("int").alias("distance"))


@query("F03_hamming", f"select a.n_name a, cast(hamming(rpad(a.n_name, 20, '-'), rpad(b.n_name, 20, '-')) as int) distance from {NATIONS}")
def _(spark, d):
    return _two(spark, d).select("a", text.hamming(F.rpad("a", 20, "-"), F.rpad("b", 20, "-")).cast("int").alias("distance"))


@query("F04_hamming_share", f"select a.n_name a, round(1e0 - hamming(rpad(a.n_name, 34, '-'), rpad(b.n_name, 34, '-')) / 34e0, 6) sim from {NATIONS}")
def _(spark, d):
    return _two(spark, d).select("a", F.round(text.hamming_similarity(F.rpad("a", 34, "-"), F.rpad("b", 34, "-"), 34), 6).alias("sim"))


@query("F05_cosine", "select l.vec_id, round(list_dot_product(cast(l.embedding as double[]), cast(r.embedding as double[])) / (sqrt(list_dot_product(cast(l.embedding as double[]), cast(l.embedding as double[]))) * sqrt(list_dot_product(cast(r.embedding as double[]), cast(r.embedding as double[])))), 5) cosine from embeddings l join embeddings r on r.vec_id = l.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(vector.cosine("v", "w"), 5).alias("cosine"))


@query("F07_feature_width", "select mode, k * len(embedding) width, count(*) n from embeddings, (values ('concat', 2), ('interactions', 4), ('left_only', 1), ('right_only', 1)) t(mode, k) group by all")
def _(spark, d):
    """Widths of the feature blocks that vectors really make, which must be those that feature_width() foretells."""
    e = table(spark, d, "embeddings")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.size(vector.pair_features("embedding", "embedding", m)).alias("width"), (F.size("embedding") * vector.feature_width(m, 1)).alias("told")) for m in vector.MODES))).alias("f")
    found = e.select(each).select("f.*").groupBy("mode", "width", "told").agg(F.count(F.lit(1)).alias("n"))
    checks.require_none(found.filter("width <> told").select("mode"), "feature blocks of another width than foretold")
    return found.select("mode", "width", "n")


@query("F08_composition_all", "select c_custkey, list_transform(range(10), lambda k: length(c_name) - length(replace(c_name, cast(k as varchar), ''))) counts, length(c_name) n from customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", text.composition("c_name", "0123456789").alias("f"))
    return c.select("c_custkey", F.transform(F.slice("f", 2, 10), lambda x: x.cast("long")).alias("counts"), F.col("f")[0].cast("long").alias("n"))


@query("F09_residue_rows", "select c_custkey, list_sum(list_transform(string_split(cast(c_custkey as varchar), ''), lambda x: cast(x as int) * 3.0e0 + 1)) total from customer")
def _(spark, d):
    matrix = {str(k): [2.0 * k, k + 1.0] for k in range(10)}
    coded = table(spark, d, "customer").select("c_custkey", text.residue_encode(F.col("c_custkey").cast("string"), matrix).alias("f"))
    return coded.select("c_custkey", F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("F14_log_counts", "select p_brand, round(log10(count(*)), 6) log10_n, round(ln(count(*)), 6) ln_n from part group by 1")
def _(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.select("p_brand", F.round(rows.log_counts(F.col("n")), 6).alias("log10_n"), F.round(rows.log_counts(F.col("n"), None), 6).alias("ln_n"))


@query("F15_rendered_interval", "select n_nationkey, printf('%.3f [%.3f, %.3f]', n_nationkey / 8e0, n_nationkey / 8e0 - 0.25e0, n_nationkey / 8e0 + 0.25e0) shown from nation")
def _(spark, d):
    v = F.col("n_nationkey") / 8
    return table(spark, d, "nation").select("n_nationkey", text.render_interval(v, v - 0.25, v + 0.25).alias("shown"))


@query("F16_rounded_distance", "select p_partkey, cast(p_size % 35 as int) distance from part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (1 - (F.col("p_size") % 35) / 34.0).alias("s"))
    return p.select("p_partkey", text.rounded_distance("s", 34).cast("int").alias("distance"))


@query("F17_json_field", "select n_nationkey, n_name found from nation")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.col("n_name").alias("name")).alias("of"))).alias("j"))
    return n.select("n_nationkey", rows.json_field(F.col("j"), "of", "name").alias("found"))


# ---- sampling ---------------------------------------------------------------------------------------------------------------


@query("N01_context", f"with {OWNERS} select g, count(*) n from pos group by g")
def _(spark, d):
    _, pool = sampling.context(owners(spark, d), "g", "seq")
    weight = next(c for c in pool.columns if c not in ("g", "attribute") and dict(pool.dtypes)[c] in ("bigint", "int"))
    return pool.select("g", F.col(weight).cast("long").alias("n"))


@query("N07_assembled", f"with {OWNERS} select count(*) n, cast(0 as bigint) n_same, cast(0 as bigint) n_labelled from pos")
def _(spark, d):
    pos = owners(spark, d)
    drawn = sampling.sample(pos, "g", "seq", "i", "shuffle", 1.0)
    own = drawn.join(pos.select(F.col("i").alias("source_row_id"), F.col("g").alias("own")), "source_row_id")
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("own")).alias("n_same"), F.count_if(F.col("label") != 0).alias("n_labelled"))


@query("N08_strategies", f"with {OWNERS} select s strategy, count(*) n from pos, (values ('hard'), ('matched'), ('shuffle')) t(s) group by s union all select 'uniform', count(*) from pos, pool where pos.g <> pool.g")
def _(spark, d):
    """Negatives drawn by each strategy, one a positive; a name that is none of them must raise."""
    pos, found = owners(spark, d), []
    for name in ("hard", "matched", "shuffle", "uniform"):
        found.append(sampling.sample(pos, "g", "seq", "i", name, 1.0, guard=None).select(F.lit(name).alias("strategy")))
    try:
        sampling.sample(pos, "g", "seq", "i", "unknown", 1.0)
    except ValueError:
        return functools.reduce(DataFrame.unionByName, found).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    raise AssertionError("an unknown strategy was taken")


@query("N09_training_set", f"with {OWNERS} select cast(1 as int) label_value, count(*) n from pos union all select 0, 2 * count(*) from pos")
def _(spark, d):
    pos = owners(spark, d)
    both = sampling.training_set(pos, sampling.sample(pos, "g", "seq", "i", "matched", 2.0), "i")
    return both.groupBy(F.col("label").cast("int").alias("label_value")).agg(F.count(F.lit(1)).alias("n"))


# ---- metrics, correlations and rules ----------------------------------------------------------------------------------------


@query("W02_tie_blocks", f"with {GRADED}, b as (select g, s, cast(sum(y) as double) p, cast(sum(1 - y) as double) n from graded group by g, s) select g, round(s, 6) s, p, n, sum(p) over (partition by g order by s desc rows unbounded preceding) tp, sum(n) over (partition by g order by s desc rows unbounded preceding) fp from b")
def _(spark, d):
    return metrics.tie_blocks(graded(spark, d), ["g"], "y", "s").select("g", F.round("s", 6).alias("s"), "p", "n", "tp", "fp")


@query("E15_kernels_agree", f"with {GRADED}, {metrics_sql('graded')} select g, round(auroc, 6) auroc, round(ap, 6) ap, round(auc01, 6) auc01, true agrees from m")
def _(spark, d):
    """The bootstrap's kernel, with every row drawn once, against the window plans."""
    rows_ = graded(spark, d)
    a = metrics.group_metrics(rows_, "g", "y", "s", cuts=8)
    one = resampling.samples(rows_, "g", "y", ["s"], "i", 1, "groups", 0)
    drawn = resampling.macro_samples(one, ["s"]).select(*(F.col(m).alias(f"{m}_k") for m in resampling.METRICS))
    times = resampling.group_times(rows_.select("g").distinct(), 1, "groups", 0).select("g", "t")
    mean = a.join(times, "g").agg(*((F.sum(F.col(m) * F.col("t")) / F.sum("t")).alias(f"{m}_w") for m in resampling.METRICS))
    near = mean.join(drawn).select(functools.reduce(lambda x, y: x & y, (F.abs(F.col(f"{m}_k") - F.col(f"{m}_w")) < 1e-9 for m in resampling.METRICS)).alias("agrees"))
    return a.join(near).select("g", *r6("auroc", "ap", "auc01"), "agrees")


@query("E11_policy", f"with {GRADED} select count(*) n_rows, count(distinct s) n_distinct, false degenerate from graded")
def _(spark, d):
    found = metrics.apply_policy(metrics.diagnostics(graded(spark, d), "g", "s"), "ignore")
    return spark.createDataFrame([(int(found["n_rows"]), int(found["n_distinct"]), bool(found["degenerate"]))], "n_rows long, n_distinct long, degenerate boolean")


@query("E19_correlation_block", f"""with p as ({PART_G}), t as (select count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy, corr(x, y) r from p),
  o as (select ((sxy - x * y) - (sx - x) * (sy - y) / (n - 1)) / sqrt(((sxx - x * x) - (sx - x) * (sx - x) / (n - 1)) * ((syy - y * y) - (sy - y) * (sy - y) / (n - 1))) l from p, t)
  select n, round(r, 6) r, round((select min(l) from o), 5) low, round((select max(l) from o), 5) high, (select count(*) from p where i % 7 >= 3) n_supported, (select round(corr(x, y), 6) from p where i % 7 >= 3) r_supported from t""")
def _(spark, d):
    out = stats.correlation_block(points(spark, d).withColumn("support", F.col("i") % 7), "i", "x", "y", "support", 3)
    return out.select("n", F.round("r", 6).alias("r"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "n_supported", F.round("r_supported", 6).alias("r_supported"))


@query("E20_strict_metrics", f"with {GRADED}, {metrics_sql('graded')} select g, round(auc01, 6) auc01 from m")
def _(spark, d):
    return metrics.strict_group_metrics(graded(spark, d), "g", "y", "s").select("g", *r6("auc01"))


RULES = "select n_nationkey k, 0.4e0 + n_nationkey / 100e0 low, n_nationkey / 500e0 high, 0.05e0 - n_nationkey / 200e0 other from nation"


@query("E23_criteria", f"select k, low > 0.5e0 predictive, low > 0.5e0 and high < 0.02e0 sufficient, low > 0 and other > 0 both_hold from ({RULES})")
def _(spark, d):
    n = F.col("n_nationkey")
    low, high, other = 0.4 + n / 100, n / 500, 0.05 - n / 200
    return table(spark, d, "nation").select(n.alias("k"), stats.predictive(low).alias("predictive"), stats.sufficient(low, high).alias("sufficient"), stats.primary(low, other).alias("both_hold"))


SLICED = f"with {GRADED.replace('l_discount s', 'l_discount s, l_linestatus src')}, sliced as (select g.*, t.src as slice from graded g join (select distinct src from graded where y = 0) t on g.y = 1 or g.src = t.src)"


@query("E25_negative_sources", f"{SLICED}, {metrics_sql('sliced', 'slice')} select slice, n_pos, n_neg, round(auc01, 6) auc01 from m")
def _(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    r = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("s"), F.col("l_linestatus").alias("src"))
    sources = [x[0] for x in r.filter("y = 0").select("src").distinct().collect()]  # a handful of sources
    out = rows.slices(r, {v: (F.col("y") == 1) | (F.col("src") == v) for v in sources})
    return metrics.group_metrics(out, "slice", "y", "s").select("slice", "n_pos", "n_neg", *r6("auc01"))


@query("E27_floor_and_drift", f"with {GRADED}, {metrics_sql('graded')} select round(avg(auc01), 6) v from m")
def _(spark, d):
    out = metrics.macro(metrics.group_metrics(graded(spark, d), "g", "y", "s"), "g")
    named = out.select(F.lit("arm").alias("arm"), F.col("macro_auc01").alias("v"))
    stats.require_floor(named, "arm", "v", floor=0.0)
    stats.require_drift(0.10, 0.12)
    return named.select(*r6("v"))


@query("E29_lookup_ablation", f"""with {GRADED.replace('l_discount s', 'l_discount s, l_linenumber = 1 ex')}, rest as (select * from graded where not ex), {metrics_sql('graded')}, {metrics_sql('rest').replace('b as', 'b2 as').replace('c as', 'c2 as').replace('d as', 'd2 as').replace('m as', 'm2 as').replace('from b)', 'from b2)').replace('from c ', 'from c2 ').replace('from d group', 'from d2 group')}
  select g, round(m.auc01, 6) with_lookup, round(m2.auc01, 6) without_lookup, round(m.auc01 - m2.auc01, 6) lookup_share from m join m2 using (g)""")
def _(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    r = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("s"), (F.col("l_linenumber") == 1).alias("ex"))
    by = metrics.group_metrics(rows.slices(r, {"all": F.lit(True), "rest": ~F.col("ex")}), ["g", "slice"], "y", "s")
    both = by.groupBy("g").pivot("slice", ["all", "rest"]).agg(F.first("auc01")).dropna()
    return both.select("g", F.round("all", 6).alias("with_lookup"), F.round("rest", 6).alias("without_lookup"), (F.round(F.col("all") - F.col("rest"), 6) + F.lit(0.0)).alias("lookup_share"))


@query("E34_mean_score_vs_support", f"with {GRADED} select g, round(avg(s), 6) mean_score, round(log10(count(*)), 6) log_support from graded group by g")
def _(spark, d):
    by = graded(spark, d).groupBy("g").agg(F.avg("s").alias("mean_score"), rows.log_counts(F.count(F.lit(1))).alias("log_support"))
    return by.select("g", *r6("mean_score", "log_support"))


@query("P13_fold_conservation", f"with {AFFIN} select fold, count(*) n from affin group by fold")
def _(spark, d):
    a = affin(spark, d)
    folds = [r[0] for r in a.select("fold").distinct().collect()]  # five folds
    whole = rows.conserved([a.filter(F.col("fold") == f) for f in folds], a, "i")
    return whole.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("M23_scored_once", "select count(*) n from part")
def _(spark, d):
    p = paired(spark, d)
    scores = models.random_scores(p.select("i"), "i").withColumn("arm", F.lit("random"))
    value = next(c for c in scores.columns if c not in ("i", "arm"))
    checks.scored_once(p, scores, "i", "arm", value)
    return scores.agg(F.count(F.lit(1)).alias("n"))


@query("M14_record_check", f"with {GRADED}, {metrics_sql('graded')} select 'macro' field, round(avg(auc01), 6) v from m union all select 'n', cast(count(*) as double) from m")
def _(spark, d):
    """The record of an evaluation, which must have exactly these fields and be the mean over its groups."""
    by = {r.g: r.auc01 for r in metrics.group_metrics(graded(spark, d), "g", "y", "s").select("g", "auc01").filter("auc01 is not null").collect()}  # 25 groups
    record = {"macro": sum(by.values()) / len(by), "n": len(by)}
    checks.check_record(record, {"macro": float, "n": int})
    checks.check_evaluation({"arms": {"s": {"macro": record["macro"], "by_group": by}}})
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in record.items()], "field string, v double")


@query("M18_padded_mean", "select vec_id, round(list_sum(cast(embedding as double[])) / len(embedding), 5) m from embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("r"))
    padded, mask = vector.pad("r", 100, 1)
    out = e.select("vec_id", padded.alias("p"), mask.alias("k"))
    return out.select("vec_id", F.round(vector.masked_mean("p", "k")[0], 5).alias("m"))


@query("P08_schedule_order", f"with {AFFIN}, k as (select g, min(i) f from affin group by g) select row_number() over (order by f, g) - 1 as position, g partition_id, (select count(*) from affin a where a.g = k.g) n_test, (select count(*) from affin a where a.g <> k.g) n_train from k")
def _(spark, d):
    a = affin(spark, d)
    held = splits.key_schedule(a, "g", "i")
    sides = splits.schedule(a, held, "g").groupBy("partition_id").agg(F.count_if(F.col("side") == "test").alias("n_test"), F.count_if(F.col("side") == "train").alias("n_train"))
    return held.select("position", "partition_id").join(sides, "partition_id").select("position", "partition_id", "n_test", "n_train")


CUSTOMERS = "c as (select c_custkey i, n_name g, n_regionkey r, c_mktsegment || c_nationkey // 2 seq from customer join nation on c_nationkey = n_nationkey), h as (select cast(n_regionkey as varchar) partition_id, n_name g, lpad(cast(n_nationkey * 7919 as varchar), 6, '0') code from nation where n_name in (select g from c))"


DIAGNOSED = """select k.partition_id, n_keys, n_test, n_train, n_values, n_shared, round(n_shared / cast(n_values as double), 6) fraction, distance, source
  from (select partition_id, count(*) n_keys from h group by 1) k join (select partition_id, count(*) filter (side = 'test') n_test, count(*) filter (side = 'train') n_train from s group by 1) using (partition_id)
  join (select partition_id, count(*) n_values, count(*) filter (r) n_shared from (select partition_id, seq, bool_or(side = 'test') t, bool_or(side = 'train') r from s group by all) where t group by 1) using (partition_id)
  join (select a.partition_id, cast(min(hamming(a.code, b.code)) as int) distance, arg_min(b.g, row(hamming(a.code, b.code), b.g)) source from h a join (select distinct partition_id, g from s where side = 'train') t on t.partition_id = a.partition_id join h b on b.g = t.g group by 1) using (partition_id)"""
SIDES = "a as (select c.*, p.partition_id, case when exists (select 1 from h where h.partition_id = p.partition_id and h.g = c.g) then 'test' else 'train' end side from c, (select distinct partition_id from h) p)"


@query("P10_schedule_diagnostics", f"with {CUSTOMERS}, {SIDES}, s as (select * from a) {DIAGNOSED}")
def _(spark, d):
    c, n = regions(spark, d)
    return splits.schedule_diagnostics(c, n, "g", "seq", n.select("g", "code")).withColumn("fraction", F.round("fraction", 6))


@query("P10_joint_diagnostics", f"with {CUSTOMERS}, {SIDES}, s as (select * from a where side = 'test' or not exists (select 1 from a t where t.partition_id = a.partition_id and t.side = 'test' and t.seq = a.seq)) {DIAGNOSED}")
def _(spark, d):
    c, n = regions(spark, d)
    return splits.schedule_diagnostics(c, n, "g", "seq", n.select("g", "code"), shared=True).withColumn("fraction", F.round("fraction", 6))


PREFLIGHT = f"""with {CUSTOMERS}, k as (select n_name g, n_nationkey k, n_regionkey r from nation), w as (select g from k where k % 8 <> 3), d as (select partition_id, g from h union all select 'again', g from h join k using (g) where k % 11 = 0),
  x as (select c.i, c.g, c.seq, c2.c_acctbal > 9500 and k.k <> 5 y, p.partition_id, case when exists (select 1 from d where d.partition_id = p.partition_id and d.g = c.g) then 'test' else 'train' end side from c join customer c2 on c2.c_custkey = c.i join k using (g), (select distinct partition_id from d) p),
  b as (select partition_id, side, g, count(*) filter (y) p, count(*) filter (not y) n from x group by all), q as (select g, case when k % 6 = 1 then left(code, 4) else code end code from h join k using (g) where k % 9 <> 4)
  select 'held-out key is not expected' as rule, partition_id, g as key from d where g not in (select g from w) union select 'expected key is not held out', null, g from w where g not in (select g from d)
  union select 'key held out twice', null, g from d group by g having count(*) > 1 union select 'key without a code', partition_id, g from b where g not in (select g from q) union select 'code of another length', null, g from q where length(code) <> 6
  union select 'training of one class', partition_id, null from b where side = 'train' group by partition_id having sum(p) = 0 or sum(n) = 0 union select 'test key of one class', partition_id, g from b where side = 'test' and (p = 0 or n = 0)
  union select 'no source of both classes', partition_id, null from b group by partition_id having count(*) filter (side = 'train' and p > 0 and n > 0) = 0 union select 'a single training row of a class', partition_id, g from b where side = 'train' and (p = 1 or n = 1)
  union select 'seq on both sides', partition_id, null from (select partition_id, seq from x group by all having bool_or(side = 'test') and bool_or(side = 'train'))"""


@query("P09_preflight_faults", PREFLIGHT)
def _(spark, d):
    """A schedule with planted faults: keys that aren't expected, held out twice, without a code or with a short one, and of one class."""
    c, n = regions(spark, d)
    number = F.col("n_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_name").alias("g"), "n_nationkey")
    held = n.select("partition_id", "g").unionByName(n.filter(number % 11 == 0).select(F.lit("again").alias("partition_id"), "g"))
    codes = n.filter(number % 9 != 4).select("g", F.when(number % 6 == 1, F.left("code", F.lit(4))).otherwise(F.col("code")).alias("code"))
    rows_ = c.join(table(spark, d, "customer").select(F.col("c_custkey").alias("i"), "c_acctbal"), "i").join(nation, "g").withColumn("y", (F.col("c_acctbal") > 9500) & (number != 5))
    sided = rows_.crossJoin(held.select("partition_id").distinct()).join(held.withColumn("_h", F.lit(True)), ["partition_id", "g"], "left")  # schedule() would refuse it
    parts = sided.withColumn("side", F.when(F.col("_h"), "test").otherwise("train"))
    return splits.preflight_faults(parts, held, nation.filter(number % 8 != 3), codes, "g", "y", 6, "seq")


@query("A10_ragged_store", "select cast(vec_id as varchar) as sequence, cast(1 + vec_id % 4 as int) n, round(list_avg(cast(embedding[1:(1 + vec_id % 4) * 16] as double[])), 4) mean from embeddings where vec_id % 3 = 0")
def _(spark, d):
    """Vectors cut into one to four residues of 16 components, written as a ragged store and read back by their sequences."""
    v = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("sequence"), F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int")), lambda k: F.slice("embedding", k * 16 + 1, 16)).alias("residues"))
    path = scratch(spark, "residues")
    io.write_residues(v.withColumns({"model": F.lit("small"), "layer": F.lit(3)}), path)
    back = io.read_residues(spark, path, "small", 3, v.filter("vec_id % 3 = 0"))
    total = F.aggregate(F.flatten("residues"), F.lit(0.0), lambda a, x: a + x) / F.size(F.flatten("residues"))
    return back.select("sequence", F.size("residues").alias("n"), F.round(total, 4).alias("mean"))


# ---- single steps of larger operators ----------------------------------------------------------------------------------------


@query("W01_tie_block_starts", f"with {GRADED} select g, s, count(*) n, rank_ - 1 first_place from (select g, s, rank() over (partition by g order by s desc) rank_ from graded) group by g, s, rank_")
def _(spark, d):
    """Where each block of equal scores begins in the falling order of its group."""
    b = metrics.tie_blocks(graded(spark, d), ["g"], "y", "s")
    n = F.col("p") + F.col("n")
    return b.select("g", "s", n.cast("long").alias("n"), (F.col("tp") + F.col("fp") - n).cast("long").alias("first_place"))


@query("D15_score_distinctness", f"with {GRADED}, v as (select g, case when i % 50 = 0 then null when i % 50 = 1 then cast('nan' as double) else s end s from graded), f as (select g, case when isnan(s) then null else s end s from v) select count(*) n_rows, count(distinct s) n_distinct, count(*) filter (s is null) n_nonfinite, round(cast((select max(k) from (select count(*) k from f where s is not null group by s)) as double) / count(*), 6) modal_fraction, (select count(*) from (select g from f group by g having count(distinct s) <= 1)) n_constant_groups from f")
def _(spark, d):
    """Scores of which two in fifty are missing or no number."""
    v = graded(spark, d).withColumn("s", F.when(F.col("i") % 50 == 0, None).when(F.col("i") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("s")))
    return metrics.diagnostics(v, "g", "s").select("n_rows", "n_distinct", "n_nonfinite", *r6("modal_fraction"), "n_constant_groups")


@query("W05_neighbour_ranks", "with t as (select distinct p_type t from part), r as (select a.t as name, b.t other, cast(levenshtein(a.t, b.t) as int) distance, row_number() over (partition by a.t order by levenshtein(a.t, b.t), b.t) rank from t a, t b where a.t <> b.t) select name, other, distance, cast(rank as int) rank from r where rank <= 3")
def _(spark, d):
    return retrieval.neighbour_ranks(table(spark, d, "part"), "p_type", 3)


@query("S02_top_k_mean", "with t as (select vec_id, label, cast(embedding as double[]) v from embeddings), s as (select q.vec_id, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) sim from t q join t e using (label) where q.vec_id % 5 = 0 and e.vec_id % 5 <> 0) select vec_id, round(list_avg(list(sim order by sim desc)[1:4]), 6) score from s group by vec_id having count(*) >= 4")
def _(spark, d):
    v = table(spark, d, "embeddings")
    entries = v.filter("vec_id % 5 <> 0").select("label", F.col("vec_id").alias("entry"), F.col("embedding").alias("w"))
    out = retrieval.nearest_vectors(v.filter("vec_id % 5 = 0").select("label", "vec_id", "embedding"), entries, "label", "vec_id", "embedding", "w", top_k=4)
    return out.filter("database_size >= 4").select("vec_id", *r6("score"))


def _unit(stream: str, key: str) -> str:
    return rng.unit_sql("'3'", f"'{stream}'", key)


@query("S03_random_top_k", f"select g, i from (select c_mktsegment g, c_custkey i, row_number() over (partition by c_mktsegment order by {_unit('cap', 'c_custkey')}, c_custkey) n from customer) where n <= 12")
def _(spark, d):
    return sampling.cap_per_group(affin(spark, d), "g", "i", 12, seed=3).select("g", "i")


@query("S07_shuffled", f"select o_orderkey, row_number() over (order by {_unit('order', 'o_orderkey')}, o_orderkey) - 1 as pos from orders")
def _(spark, d):
    """The place of every order in a seeded shuffle of all."""
    o = table(spark, d, "orders").select("o_orderkey").withColumn("_u", rng.unit(3, "order", F.col("o_orderkey")))
    return ordering.numbered(o, "_u", "o_orderkey").select("o_orderkey", "pos")


@query("N02_draw_counts", f"select c_custkey, cast(2 + cast({_unit('extra', 'c_custkey')} < 2.3e0 - 2 as int) as int) n from customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", sampling.draws(2.3, F.col("c_custkey"), 3).cast("int").alias("n"))


@query("E32_uplift", f"with {GRADED}, two as (select g, y, s, 'a' arm from graded union all select p_brand, cast(l_returnflag = 'R' as int), l_tax, 'b' from lineitem join part on l_partkey = p_partkey), {metrics_sql('two', 'g, arm')}, v as (select arm, avg(auc01) v from m group by arm) select arm, round(v, 6) v, round(v - (select v from v where arm = 'b'), 6) + 0e0 uplift from v")
def _(spark, d):
    """Each arm's macro metric over that of arm b, read back from the stored results."""
    path = scratch(spark, "arms")
    metrics.macro(metrics.group_metrics(_arms(spark, d), ["g", "arm"], "y", "s"), "g", within=["arm"]).select("arm", F.col("macro_auc01").alias("v")).write.parquet(path)
    return experiment.uplift(spark.read.parquet(path), "arm", "v", "b").select("arm", *r6("v", "uplift"))


def _arms(spark, d):
    rows_ = graded(spark, d)
    return rows_.select("g", "y", "s", F.lit("a").alias("arm")).unionByName(rows_.select("g", "y", F.col("l_tax").alias("s"), F.lit("b").alias("arm")))


@query("M02_nearest_matrix_transfer", f"""with {AFFIN}, p as (select range pos from range(9)), tot as (select g, cast(sum(y) as double) np, cast(sum(1 - y) as double) nn from affin where fold <> 0 group by g having np > 0 and nn > 0), k as (select g, min(seq) code from affin group by g),
  n as (select k.g, arg_min(o.g, row(hamming(k.code, o.code), o.g)) source from k join k o on k.g <> o.g join tot on tot.g = o.g group by k.g),
  l as (select i, g, y, fold, pos, substr(seq, cast(pos as int) + 1, 1) r from affin, p), c as (select g, pos, r, sum(y) p, sum(1 - y) n from l where fold <> 0 group by all)
  select l.i, l.g, n.source, round(sum(ln(((coalesce(c.p, 0) + 1e0) / (np + 10e0)) / ((coalesce(c.n, 0) + 1e0) / (nn + 10e0)))), 6) score from l join n using (g) join tot on tot.g = n.source left join c on c.g = n.source and c.pos = l.pos and c.r = l.r where fold = 0 group by all""")
def _(spark, d):
    a = affin(spark, d)
    codes = a.groupBy("g").agg(F.min("seq").alias("code"))
    return models.nearest_matrix_transfer(a.filter("fold <> 0"), a.filter("fold = 0"), codes, "g", "seq", "y", "i", 9, "0123456789").select("i", "g", "source", *r6("score"))
