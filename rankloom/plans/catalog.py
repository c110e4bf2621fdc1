"""All registered queries of the ranking library on the star-schema tables, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import rng, text, vector
from rankloom.operators import bootstrap, checks, linear, metrics, models, projection, retrieval, sampling, splits, stats, summary
from rankloom.plans import experiment
from rankloom.sources import io
from rankloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "E03_auc01_by_group"
DIGITS = "0123456789"
REPLICATES = 1000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]  # no negative zero


# ---- bindings -------------------------------------------------------------------------------------------------------

GRADED = "graded as (select p_brand g, cast(l_returnflag = 'R' as int) y, l_discount s, l_orderkey * 10 + l_linenumber i from lineitem join part on l_partkey = p_partkey)"
PAIRED = "paired as (select p_brand g, p_name seq, cast(p_size > 25 as int) y, p_partkey i, p_type a from part)"
AFFIN = "affin as (select c_mktsegment g, substr(c_name, -9, 9) seq, c_acctbal v, cast(c_acctbal > 5000 as int) y, c_custkey i, c_nationkey % 5 fold from customer)"


def graded(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("p_brand").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_tax", "l_quantity")


def paired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_name").alias("seq"), (F.col("p_size") > 25).cast("int").alias("y"), F.col("p_partkey").alias("i"), F.col("p_type").alias("a"))


def affin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_mktsegment").alias("g"), F.expr("substring(c_name, -9, 9)").alias("seq"), F.col("c_acctbal").alias("v"), (F.col("c_acctbal") > 5000).cast("int").alias("y"), F.col("c_custkey").alias("i"), (F.col("c_nationkey") % 5).alias("fold"))


def metrics_sql(source: str, groups: str = "g", weight: str = "1") -> str:
    """Metrics by tie blocks of a CTE `source` with y and s."""
    return f"""b as (select {groups}, s, cast(sum(({weight}) * y) as double) p, cast(sum(({weight}) * (1 - y)) as double) n from {source} group by {groups}, s),
      c as (select *, sum(p) over (partition by {groups} order by s desc rows unbounded preceding) tp, sum(n) over (partition by {groups} order by s desc rows unbounded preceding) fp,
                   sum(p) over (partition by {groups}) pos, sum(n) over (partition by {groups}) neg from b),
      d as (select *, (fp - n) / neg f0, fp / neg f1, (tp - p) / pos t0, tp / pos t1 from c where pos > 0 and neg > 0),
      m as (select {groups}, max(pos) n_pos, max(neg) n_neg, sum((f1 - f0) * (t0 + t1) / 2) auroc, sum(p / pos * tp / (tp + fp)) ap,
                   0.5e0 * (1 + (sum(case when f1 <= 0.1e0 then (f1 - f0) * (t0 + t1) / 2 when f0 < 0.1e0 then (0.1e0 - f0) * (t0 + (t0 + (t1 - t0) * (0.1e0 - f0) / (f1 - f0))) / 2 else 0 end) - 0.005e0) / 0.095e0) auc01
            from d group by {groups})"""


# ---- ranking metrics ------------------------------------------------------------------------------------------------

GROUP_SQL = f"with {GRADED}, {metrics_sql('graded')}"


@query("E01_auroc_by_group", f"{GROUP_SQL} select g, round(auroc, 6) auroc from m")
def _(spark, d):
    return metrics.group_metrics(graded(spark, d), "g", "y", "s").select("g", *r6("auroc"))


@query("E02_ap_by_group", f"{GROUP_SQL} select g, round(ap, 6) ap from m")
def _(spark, d):
    return metrics.group_metrics(graded(spark, d), "g", "y", "s").select("g", *r6("ap"))


@query("E03_auc01_by_group", f"{GROUP_SQL} select g, n_pos, n_neg, round(auc01, 6) auc01 from m")
def _(spark, d):
    return metrics.group_metrics(graded(spark, d), "g", "y", "s").select("g", "n_pos", "n_neg", *r6("auc01"))


@query("E03_auc01_many_scores", f"with {GRADED.replace('l_discount s', 'l_extendedprice s')}, {metrics_sql('graded')} select g, round(auc01, 6) auc01, round(auroc, 6) auroc from m")
def _(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    return metrics.group_metrics(rows, "g", "y", "s", cuts=16).select("g", *r6("auc01", "auroc"))


@query("E04_macro_metrics", f"{GROUP_SQL} select round(avg(auroc), 6) macro_auroc, count(auroc) n_scored from m")
def _(spark, d):
    return metrics.macro(metrics.group_metrics(graded(spark, d), "g", "y", "s"), "g", "auroc").select(*r6("macro_auroc"), "n_scored")


@query("E05_macro_auc01", f"{GROUP_SQL} select round(avg(auc01), 6) macro_auc01, count(auc01) n_scored from m")
def _(spark, d):
    return metrics.macro(metrics.group_metrics(graded(spark, d), "g", "y", "s"), "g").select(*r6("macro_auc01"), "n_scored")


@query("E06_weighted_auc01", f"with {GRADED.replace('l_discount s', 'l_discount s, cast(l_quantity as bigint) % 3 w')}, {metrics_sql('graded', weight='w')} select g, round(auc01, 6) auc01, round(ap, 6) ap from m")
def _(spark, d):
    rows = graded(spark, d).withColumn("w", F.col("l_quantity").cast("long") % 3)
    return metrics.group_metrics(rows, "g", "y", "s", weight="w").select("g", *r6("auc01", "ap"))


@query("E09_pooled_metrics", f"with {GRADED.replace('p_brand g', '1 g')}, {metrics_sql('graded')} select n_pos, n_neg, round(auroc, 6) auroc, round(ap, 6) ap, round(auc01, 6) auc01 from m")
def _(spark, d):
    return metrics.pooled_metrics(graded(spark, d), "y", "s").select("n_pos", "n_neg", *r6("auroc", "ap", "auc01"))


@query("E10_score_diagnostics", f"""with {GRADED}, k as (select s, count(*) k from graded group by s), c as (select g, count(distinct s) k from graded group by g)
  select cast(sum(k) as bigint) n_rows, count(s) n_distinct, cast(0 as bigint) n_nonfinite, round(cast(max(k) as double) / sum(k), 6) modal_fraction, (select count(*) from c where k <= 1) n_constant_groups from k""")
def _(spark, d):
    return metrics.diagnostics(graded(spark, d), "g", "s").select("n_rows", "n_distinct", "n_nonfinite", *r6("modal_fraction"), "n_constant_groups")


BOOT_SQL = f"""draws as (select replicate, slot, cast(floor({rng.unit_sql("'7'", "'group'", "replicate", "slot")} * n) as bigint) pos
    from (select replicate, n, unnest(range(n)) slot from (select range replicate from range({REPLICATES})), (select count(*) n from ok))),
  numbered as (select *, row_number() over (order by g) - 1 pos from ok)"""


@query("E07_bootstrap_groups_macro", f"{GROUP_SQL}, ok as (select * from m), {BOOT_SQL} select replicate, round(avg(auc01), 6) as value from draws join numbered using (pos) group by replicate")
def _(spark, d):
    by = metrics.group_metrics(graded(spark, d), "g", "y", "s")
    return bootstrap.macro_over_groups(by, "g", "auc01", REPLICATES, seed=7).select("replicate", *r6("value"))


@query("E08_percentile_interval", f"""{GROUP_SQL}, ok as (select * from m), {BOOT_SQL}, v as (select replicate, avg(auc01) as value from draws join numbered using (pos) group by replicate)
  select round(quantile_cont(value, 0.025), 6) low, round(quantile_cont(value, 0.975), 6) high, count(*) n_replicates from v""")
def _(spark, d):
    by = metrics.group_metrics(graded(spark, d), "g", "y", "s")
    return stats.interval(bootstrap.macro_over_groups(by, "g", "auc01", REPLICATES, seed=7), "value").select(*r6("low", "high"), "n_replicates")


TWO = f"""with {GRADED}, two as (select g, y, s, 'a' arm from graded union all select p_brand, cast(l_returnflag = 'R' as int), l_tax, 'b' from lineitem join part on l_partkey = p_partkey),
  {metrics_sql('two', 'g, arm')}, ok as (select x.g, x.auc01 - z.auc01 d from m x join m z on x.g = z.g and x.arm = 'a' and z.arm = 'b'), {BOOT_SQL},
  v as (select replicate, avg(d) as value from draws join numbered using (pos) group by replicate)"""


def _two_arms(spark: SparkSession, d: str) -> DataFrame:
    rows = graded(spark, d)
    both = rows.select("g", "y", "s", F.lit("a").alias("arm")).unionByName(rows.select("g", "y", F.col("l_tax").alias("s"), F.lit("b").alias("arm")))
    return metrics.group_metrics(both, ["g", "arm"], "y", "s")


@query("E12_paired_bootstrap_groups", f"{TWO} select replicate, round(value, 6) as value from v")
def _(spark, d):
    return bootstrap.paired_over_groups(_two_arms(spark, d), "g", "arm", "auc01", "a", "b", REPLICATES, seed=7).select("replicate", *r6("value"))


@query("E13_two_sided_p", f"{TWO} select round(least(1.0e0, 2.0e0 * least(count(*) filter (value <= 0), count(*) filter (value >= 0)) / count(*)), 6) p from v")
def _(spark, d):
    return stats.two_sided_p(bootstrap.paired_over_groups(_two_arms(spark, d), "g", "arm", "auc01", "a", "b", REPLICATES, seed=7), "value").select(*r6("p"))


@query("E33_wide_by_arm", f"{TWO} select x.g, round(x.auc01, 6) a_auc01, round(z.auc01, 6) b_auc01 from m x join m z on x.g = z.g and x.arm = 'a' and z.arm = 'b'")
def _(spark, d):
    return metrics.wide_by_arm(_two_arms(spark, d), "g", "arm", ["a", "b"]).select("g", *r6("a_auc01", "b_auc01"))


@query("E33_wide_flags", f"""{TWO}, k as (select g, arm, cast(sum(y) as bigint) n_pos, count(*) - cast(sum(y) as bigint) n_neg from two group by g, arm), x as (select * from k left join (select g, arm, round(auc01, 9) auc01 from m) using (g, arm))
  select a.g, a.n_pos, a.n_neg, a.auc01 is not null and b.auc01 is not null scorable, a.n_pos = b.n_pos and a.n_neg = b.n_neg same_rows,
    case when a.auc01 >= b.auc01 or b.auc01 is null and a.auc01 is not null then 'a' when b.auc01 is not null then 'b' end best from x a join x b on a.g = b.g and a.arm = 'a' and b.arm = 'b'""")
def _(spark, d):
    rounded = _two_arms(spark, d).withColumn("auc01", F.round("auc01", 9))
    return metrics.wide_by_arm(rounded, "g", "arm", ["a", "b"]).select("g", "n_pos", "n_neg", "scorable", "same_rows", "best")


@query("E12_paired_bootstrap_both")
def _(spark, d):
    rows = graded(spark, d)
    return bootstrap.replicates(rows, "g", "y", ["s", "l_tax"], "i", REPLICATES).select("replicate", (F.col("s") - F.col("l_tax")).alias("value"))


@query("E09_evaluate")
def _(spark, d):
    return experiment.evaluate(graded(spark, d), "g", "y", {"discount": "s", "tax": "l_tax"}, "i", REPLICATES)


@query("E12_compare_independent_rows")
def _(spark, d):
    """One score over all rows against over those of larger quantity: the arms draw their own rows."""
    rows = graded(spark, d).withColumns({"s2": F.col("s"), "heavy": F.col("l_quantity") > 10})
    return experiment.compare(rows, "g", "y", "s", "s2", "i", REPLICATES, second_mask="heavy").select(*r6("difference", "low", "high"), "n_replicates", *r6("p"), "n_groups")


@query("E14_attenuation_bootstrap")
def _(spark, d):
    rows = graded(spark, d).withColumns({"far": F.col("l_quantity") > 10, "s2": F.col("s")})
    drawn = bootstrap.replicates(rows, "g", "y", ["s", "s2"], "i", REPLICATES, masks={"s2": "far"})
    return bootstrap.attenuation(drawn, "s", ["s2"])


@query("N14_matched_subsets")
def _(spark, d):
    rows = graded(spark, d)
    wanted = rows.select("g").distinct().withColumns({"n_pos": F.lit(5), "n_neg": F.lit(20)})
    return bootstrap.matched_subsets(rows, wanted, "g", "y", "s", "i", REPLICATES)


# ---- statistics -----------------------------------------------------------------------------------------------------

PART_G = "select p_brand g, p_partkey i, cast(p_size as double) x, p_retailprice y from part"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query("E16_corr_by_group", f"select g, count(*) n, round(corr(x, y), 6) r from ({PART_G}) group by g")
def _(spark, d):
    return stats.pearson(points(spark, d), "x", "y", ["g"]).select("g", "n", *r6("r"))


@query("W06_leave_one_out_corr", f"""with p as ({PART_G}), t as (select count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy from p)
  select i, round(((sxy - x * y) - (sx - x) * (sy - y) / (n - 1)) / sqrt(((sxx - x * x) - (sx - x) ** 2 / (n - 1)) * ((syy - y * y) - (sy - y) ** 2 / (n - 1))), 6) + 0e0 r from p, t""")
def _(spark, d):
    return stats.leave_one_out_pearson(points(spark, d), "i", "x", "y").select("i", *r6("r"))


@query("D12_weighted_corr", f"""with p as (select *, cast(i % 7 + 1 as double) w from ({PART_G})), q as (select *, sum(w * x) over () / sum(w) over () mx, sum(w * y) over () / sum(w) over () my from p)
  select round(max(mx), 6) mean_x, round(max(my), 6) mean_y, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 6) r from q""")
def _(spark, d):
    return stats.weighted_pearson(points(spark, d).withColumn("w", (F.col("i") % 7 + 1).cast("double")), "x", "y", "w").select(*r6("mean_x", "mean_y", "r"))


@query("E21_ols_slope", f"""with p as ({PART_G}), t as (select regr_count(y, x) n, regr_slope(y, x) slope, regr_intercept(y, x) intercept, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy from p),
  u as (select *, sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) se from t)
  select cast(n as bigint) n, round(slope, 6) slope, round(intercept, 6) intercept, round(se, 6) stderr, round(slope - 1.96e0 * se, 6) low, round(slope + 1.96e0 * se, 6) high, round(1 - (syy - slope * sxy) / syy, 6) r2 from u""")
def _(spark, d):
    return stats.ols(points(spark, d), "x", "y").select("n", *r6("slope", "intercept", "stderr", "low", "high", "r2"))


@query("E22_decision_rule", """select n_nationkey, case when lo <= 0 and hi >= 0 and -1.03e0 < lo then 'novelty_effect' when -1.03e0 between lo and hi then 'intrinsic_difficulty' else 'mixed' end verdict
  from (select n_nationkey, -n_nationkey / 10e0 lo, 1 - n_nationkey / 10e0 hi from nation)""")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (-F.col("n_nationkey") / F.lit(10.0)).alias("lo"), (1 - F.col("n_nationkey") / F.lit(10.0)).alias("hi"))
    return n.select("n_nationkey", stats.slope_rule(F.col("lo"), F.col("hi"), F.lit(-1.03)).alias("verdict"))


@query("W03_group_zscore", f"select i, round(case when stddev_samp(y) over (partition by g) > 0 then (y - avg(y) over (partition by g)) / stddev_samp(y) over (partition by g) else 0 end, 6) z from ({PART_G})")
def _(spark, d):
    return stats.zscore(points(spark, d), "g", "y").select("i", *r6("z"))


@query("W04_group_rank_norm", f"select i, round((rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2e0) / count(*) over (partition by g), 6) rank_norm from ({PART_G})")
def _(spark, d):
    return stats.rank_normalise(points(spark, d), "g", "x").select("i", *r6("rank_norm"))


@query("E24_probe_verdict", f"{GROUP_SQL} select round(abs(avg(auc01) - 0.5e0), 6) worst, abs(avg(auc01) - 0.5e0) <= 0.05e0 passes from m")
def _(spark, d):
    by = metrics.macro(metrics.group_metrics(graded(spark, d), "g", "y", "s"), "g")
    return stats.probe_verdict(by, "macro_auc01").select(*r6("worst"), "passes")


@query("E26_seed_spread", """with r as (select p_brand arm, p_size seed, avg(p_retailprice) v from part group by all), m as (select arm, avg(v) mean, min(v) low, max(v) high from r group by arm)
  select arm, round(mean, 6) mean, round(low, 6) low, round(high, 6) high, arg_min(seed, row(abs(v - mean), seed)) representative from r join m using (arm) group by all""")
def _(spark, d):
    runs = table(spark, d, "part").groupBy(F.col("p_brand").alias("arm"), F.col("p_size").alias("seed")).agg(F.avg("p_retailprice").alias("v"))
    return stats.seed_spread(runs, "arm", "seed", "v").select("arm", *r6("mean", "low", "high"), "representative")


@query("E28_rescaling_invariance", f"with {GRADED}, {metrics_sql('graded')} select 'raw' arm, round(avg(auc01), 6) macro_auc01 from m union all select 'z', round(avg(auc01), 6) from m union all select 'rank', round(avg(auc01), 6) from m")
def _(spark, d):
    return experiment.rescaling(graded(spark, d), "g", "y", "s").select("arm", *r6("macro_auc01"))


# ---- retrieval ------------------------------------------------------------------------------------------------------

SIM = "1e0 - cast(levenshtein(q.seq, e.seq) as double) / greatest(length(q.seq), length(e.seq))"
NEAR = f"""with {PAIRED}, e as (select distinct g, seq from paired where y = 1 and i % 5 <> 0), q as (select distinct g, seq from paired where i % 5 = 0),
  s as (select q.g, q.seq, e.seq entry, {SIM} sim from q join e using (g))"""


def _near(spark: SparkSession, d: str, **options) -> DataFrame:
    rows = paired(spark, d)
    entries = retrieval.database(rows.filter("i % 5 <> 0"), "g", "seq", "y")
    return retrieval.nearest_positive(rows.filter("i % 5 = 0").select("g", "seq").distinct(), entries, "g", "seq", **options)


@query("R01_database", f"with {PAIRED} select distinct g, seq entry from paired where y = 1")
def _(spark, d):
    return retrieval.database(paired(spark, d), "g", "seq", "y")


def _near_sql(where: str, k: int = 1) -> str:
    pick = "max(sim)" if k == 1 else "case when count(*) > 0 then 1 end"
    score = f"max(sim) filter ({where})" if k == 1 else f"case when count(*) filter ({where}) >= least({k}, count(*)) then list_avg((list(sim order by sim desc) filter ({where}))[1:{k}]) else max(sim) filter ({where}) end"
    return f"""{NEAR}, t as (select g, seq, {score} score, arg_min(entry, row(-sim, entry)) filter ({where}) nearest, count(*) n, {pick} p from s group by g, seq)
      select q.g, q.seq, round(coalesce(score, 0), 6) score, coalesce(nearest, '') nearest, n is not null has_database, coalesce(n, 0) database_size from q left join t using (g, seq)"""


@query("R02_nearest_positive_edit", _near_sql("true"))
def _(spark, d):
    return _near(spark, d).withColumn("score", F.round("score", 6))


@query("R04_nearest_leave_out", _near_sql("sim < 1"))
def _(spark, d):
    return _near(spark, d, leave_out_exact=True).withColumn("score", F.round("score", 6))


@query("R05_nearest_topk", _near_sql("true", 3))
def _(spark, d):
    return _near(spark, d, top_k=3).withColumn("score", F.round("score", 6))


COS = "list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v))"


@query("R03_nearest_cosine", f"""with t as (select vec_id, label, cast(embedding as double[]) v from embeddings), q as (select * from t where vec_id % 5 = 0), e as (select * from t where vec_id % 5 <> 0)
  select q.vec_id, round(max({COS}), 6) score, arg_max(e.vec_id, {COS}) nearest, count(*) database_size from q join e using (label) group by q.vec_id""")
def _(spark, d):
    return _nearest_vectors(table(spark, d, "embeddings"))


def _nearest_vectors(v: DataFrame, **options) -> DataFrame:
    """Nearest of the other vectors of a label to every fifth one."""
    entries = v.filter("vec_id % 5 <> 0").select("label", F.col("vec_id").alias("entry"), F.col("embedding").alias("w"))
    out = retrieval.nearest_vectors(v.filter("vec_id % 5 = 0").select("label", "vec_id", "embedding"), entries, "label", "vec_id", "embedding", "w", **options)
    return out.select("vec_id", F.round("score", 6).alias("score"), F.col("nearest").cast("long").alias("nearest"), "database_size")


PROJECTED = "[list_sum([cast(embedding[i] as double) * (((i - 1) * 7 + (k - 1) * 5) % 11 - 5) / 11e0 for i in range(1, 65)]) for k in range(1, 17)]"


@query("R07_projected_nearest", f"""with t as (select vec_id, label, {PROJECTED} v from embeddings), q as (select * from t where vec_id % 5 = 0), e as (select * from t where vec_id % 5 <> 0)
  select q.vec_id, round(max({COS}), 6) score, arg_max(e.vec_id, {COS}) nearest, count(*) database_size from q join e using (label) group by q.vec_id""")
def _(spark, d):
    matrix = [[((i * 7 + k * 5) % 11 - 5) / 11.0 for k in range(16)] for i in range(64)]
    return _nearest_vectors(table(spark, d, "embeddings").withColumn("embedding", projection.linear("embedding", matrix)))


def _metric_fit(spark: SparkSession, d: str) -> tuple[DataFrame, list, list]:
    """Vectors, and a projection in which vectors of a label lie together, learned from those that R07's queries aren't of."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    mean, scale = projection.scaling(v.filter("vec_id % 5 <> 0"), "embedding")
    packed = []
    for rows, n, seed in ((v.filter("vec_id % 5 not in (0, 1)"), 24, 0), (v.filter("vec_id % 5 = 1"), 8, 1)):
        drawn = sampling.label_batches(rows, "label", "vec_id", n, 6, 8, seed)
        packed.append(projection.packed_batches(drawn, rows, "label", "vec_id", "embedding"))
    return v, *projection.fit(*packed, 64, mean, scale, epochs=15)


@query("M20_metric_projection")
def _(spark, d):
    _, _, history = _metric_fit(spark, d)
    return spark.createDataFrame([(e, round(float(a), 6), round(float(b), 6)) for e, a, b in history], "epoch int, training_loss double, validation_loss double")


@query("R07_learned_retrieval")
def _(spark, d):
    v, heads, _ = _metric_fit(spark, d)
    return _nearest_vectors(projection.project(v, "embedding", heads[0]).drop("embedding").withColumnRenamed("projected", "embedding"))


@query("M20_two_towers")
def _(spark, d):
    """Pairs of neighbouring vectors as left and right; the score is the inner product of their projections."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    mean, scale = projection.scaling(pairs, "embedding", "other")
    packed = []
    for rows, n, seed in ((pairs.filter("vec_id % 5 > 1"), 24, 0), (pairs.filter("vec_id % 5 = 1"), 8, 1)):
        packed.append(projection.packed_batches(sampling.label_batches(rows, "label", "vec_id", n, 6, 8, seed), rows, "label", "vec_id", "embedding", "other"))
    heads, _ = projection.fit(*packed, 64, mean, scale, epochs=10)
    both = projection.project(projection.project(pairs, "embedding", heads[0], "a"), "other", heads[1], "b")
    return both.select("vec_id", F.round(vector.dot("a", "b"), 4).alias("score"))


@query("R06_retrieval_by_fold", f"""with {AFFIN}, q as (select distinct g, seq, fold from affin), e as (select distinct g, seq, fold from affin where y = 1), s as (select distinct q.g, q.seq, q.fold, e.seq entry, {SIM} sim from q join e on q.g = e.g and q.fold <> e.fold)
  select g, seq, fold, round(max(sim), 6) score, arg_min(entry, row(-sim, entry)) nearest, count(*) database_size from s group by all""")
def _(spark, d):
    rows = affin(spark, d)
    entries = retrieval.database(rows, "g", "seq", "y", ["fold"])
    out = retrieval.nearest_positive(rows.select("g", "seq", "fold").distinct(), entries, "g", "seq", other_fold="fold")
    return out.select("g", "seq", "fold", F.round("score", 6).alias("score"), "nearest", "database_size")


@query("B07_exact_match_mask", f"with {PAIRED} select i, exists (select 1 from paired t where t.i % 5 <> 0 and t.y = 1 and t.g = p.g and t.seq = p.seq) exact from paired p where i % 5 = 0")
def _(spark, d):
    rows = paired(spark, d)
    return retrieval.exact_match_mask(rows.filter("i % 5 = 0"), rows.filter("i % 5 <> 0"), "g", "seq", "y").select("i", "exact")


@query("B06_seen_mask", "select o_orderkey, o_custkey in (select c_custkey from customer where c_acctbal > 0) seen from orders")
def _(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return retrieval.seen_mask(table(spark, d, "orders"), known, "o_custkey").select("o_orderkey", "seen")


NAMES_SQL = "q as (select distinct p_name seq from part where p_partkey % 7 = 0), e as (select distinct p_name || substr(p_type, 1, 2) entry from part where p_partkey % 7 <> 0)"


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    return p.filter("p_partkey % 7 = 0").select(F.col("p_name").alias("seq")), p.filter("p_partkey % 7 <> 0").select(F.concat("p_name", F.substring("p_type", 1, 2)).alias("seq"))


@query("C07_nearest_levenshtein", f"with {NAMES_SQL} select seq, cast(least(min(levenshtein(seq, entry)), 4) as int) distance from q, e group by seq")
def _(spark, d):
    return retrieval.nearest_levenshtein(*_names(spark, d), "seq", 3)


@query("C08_nearest_hamming", f"with {NAMES_SQL} select seq, cast(coalesce(min(hamming(seq, entry)), 1000000) as int) distance from q left join e on length(seq) = length(entry) group by seq")
def _(spark, d):
    return retrieval.nearest_hamming(*_names(spark, d), "seq")


@query("R09_nearest_training_distance", f"with {NAMES_SQL} select seq, round(1 - max(1e0 - cast(levenshtein(seq, entry) as double) / greatest(length(seq), length(entry))), 6) distance from q, e group by seq")
def _(spark, d):
    return retrieval.nearest_training_distance(*_names(spark, d), "seq").select("seq", *r6("distance"))


@query("P14_radius_masks", f"with {NAMES_SQL}, n as (select seq, cast(least(min(levenshtein(seq, entry)), 4) as int) distance from q, e group by seq) select seq, distance, distance > 0 keep_0, distance > 1 keep_1, distance > 2 keep_2, distance > 3 keep_3 from n")
def _(spark, d):
    return retrieval.radius_masks(retrieval.nearest_levenshtein(*_names(spark, d), "seq", 3), "seq", "distance", [0, 1, 2, 3])


@query("D16_removal_summary", f"""with {NAMES_SQL}, n as (select seq, least(min(levenshtein(seq, entry)), 4) dist from q, e group by seq), p as (select p_name seq, count(*) n from part where p_partkey % 7 = 0 group by 1), r as (select * from (values (1), (2)) t(r))
  select 'keep_' || r regime, cast(coalesce(sum(n) filter (dist > r), 0) as bigint) rows_kept, cast(coalesce(sum(n) filter (dist <= r), 0) as bigint) rows_removed, count(*) filter (dist <= r) seqs_removed,
    round(100e0 * coalesce(sum(n) filter (dist <= r), 0) / sum(n), 6) pct_rows_removed, round(100e0 * (count(*) filter (dist <= r)) / count(*), 6) pct_seqs_removed from p join n using (seq), r group by r""")
def _(spark, d):
    q, e = _names(spark, d)
    masks = retrieval.radius_masks(retrieval.nearest_levenshtein(q, e, "seq", 3), "seq", "distance", [1, 2])
    return retrieval.removal_summary(q.join(masks, "seq"), "seq", ["keep_1", "keep_2"]).select("regime", "rows_kept", "rows_removed", "seqs_removed", *r6("pct_rows_removed", "pct_seqs_removed"))


@query("D16_surviving_support", f"""with {NAMES_SQL}, n as (select seq, least(min(levenshtein(seq, entry)), 4) dist from q, e group by seq), p as (select p_brand g, p_name seq, cast(p_size > 25 as int) y from part where p_partkey % 7 = 0), r as (select * from (values (1), (2)) t(r)),
  s as (select 'keep_' || r regime, g, count(*) n_before, count(*) filter (dist > r) n_after, count(distinct seq) seqs_before, count(distinct seq) filter (dist > r) seqs_after, count(*) filter (dist > r and y = 1) pos_after, count(*) filter (dist > r and y = 0) neg_after from p join n using (seq), r group by r, g)
  select *, least(pos_after, neg_after) > 0 scorable, least(pos_after, neg_after) < 3 below from s""")
def _(spark, d):
    masks = retrieval.radius_masks(retrieval.nearest_levenshtein(*_names(spark, d), "seq", 3), "seq", "distance", [1, 2])
    rows = paired(spark, d).filter("i % 7 = 0").join(masks, "seq")
    return retrieval.surviving_support(rows, "g", "seq", "y", ["keep_1", "keep_2"], 3)


@query("R10_nearest_source", """with s as (select n_name source, n_nationkey k from nation where n_nationkey < 20), t as (select n_name target, n_nationkey k from nation where n_nationkey >= 20), h as (select target, source, hamming(lpad(cast(t.k * 7919 as varchar), 6, '0'), lpad(cast(s.k * 7919 as varchar), 6, '0')) / 6e0 d from s, t)
  select target, arg_min(source, row(d, source)) source, round(min(d), 6) distance from h group by target""")
def _(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.lpad((F.col("n_nationkey") * 7919).cast("string"), 6, "0").alias("code"))
    return retrieval.nearest_source(n.filter("n_nationkey >= 20"), n.filter("n_nationkey < 20"), "n_name", "code", 6).select("target", "source", *r6("distance"))


@query("R08_row_dot", """with e as (select vec_id, cast(embedding as double[]) v from embeddings) select l.vec_id, r.vec_id other_id, round(list_dot_product(l.v, r.v), 6) score from e l join e r on r.vec_id = l.vec_id + 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    rows = e.select("vec_id", (F.col("vec_id") + 1).alias("other_id")).join(e.select(F.col("vec_id").alias("other_id")), "other_id")
    return retrieval.row_dot(rows, e, e.withColumnRenamed("vec_id", "other_id"), "vec_id", "other_id").select("vec_id", "other_id", *r6("score"))


# ---- sampling -------------------------------------------------------------------------------------------------------



OWNERS = "pos as (select n_name g, c_name seq, c_custkey i from customer join nation on c_nationkey = n_nationkey), pool as (select g, count(*) w from pos group by g)"


FREE = "not exists (select 1 from pos k where k.seq = {0}.seq and k.g = {1}.g)"


def _nearest_sql() -> str:
    return f"""with {OWNERS}, c as (select pos.i, pool.g, row_number() over (partition by pos.i order by levenshtein(pos.g, pool.g), pool.g) n from pos, pool where {FREE.format("pos", "pool")})
      select i source_row_id, g from c where n <= 3"""


def _drawn_sql(stream: str) -> str:
    """Three groups a row from 14 draws of a position each; rows that get fewer take the rest by sort keys."""
    places, key = {"shuffle": ("select g, row_number() over (order by g) - 1 p from pool", "-{0}"), "matched": ("select g, row_number() over (order by i) - 1 p from pos", "ln(cast(pool.w as double)) - ln(-ln({0}))")}[stream]
    place = rng.position_sql("select count(*) from places", "'0'", f"'{stream}'", "pos.i", "t.t")
    rest = key.format(rng.unit_sql("'0'", f"'{stream} rest'", "short.i", "pool.g"))
    return f"""with {OWNERS}, places as ({places}), d as (select i, seq, t.t, {place} p from pos, range(14) t(t)),
      hit as (select d.i, places.g, min(t) t from d join places using (p) where {FREE.format("d", "places")} group by d.i, places.g),
      got as (select i, g from (select i, g, row_number() over (partition by i order by t) r from hit) where r <= 3),
      short as (select pos.i, pos.seq, 3 - count(got.g) need from pos left join got using (i) group by pos.i, pos.seq having count(got.g) < 3),
      rest as (select short.i, pool.g, need, row_number() over (partition by short.i order by {rest} desc, pool.g) r from short, pool
        where {FREE.format("short", "pool")} and not exists (select 1 from got where got.i = short.i and got.g = pool.g))
      select i source_row_id, g from got union all select i, g from rest where r <= need"""


@query("W07_cap_per_group", f"with {PAIRED}, n as (select i, g, row_number() over (partition by g order by {rng.unit_sql(chr(39) + '0' + chr(39), chr(39) + 'cap' + chr(39), 'i')}, i) n from paired) select g, i from n where n <= 20")
def _(spark, d):
    return sampling.cap_per_group(paired(spark, d), "g", "i", 20).select("g", "i")


@query("N12_background", f"""with {PAIRED}, p as (select distinct g, seq from paired where y = 1), c as (select t.g, s.seq, row_number() over (partition by t.g order by {rng.unit_sql("'0'", "'background'", "t.g", "s.seq")}, s.seq) n
  from (select distinct g from p) t, (select distinct seq from paired) s where not exists (select 1 from p where p.g = t.g and p.seq = s.seq)) select g, seq from c where n <= 10""")
def _(spark, d):
    rows = paired(spark, d)
    return sampling.background(rows, rows.filter("y = 1"), "g", "seq", 10)


@query("N13_label_batches")
def _(spark, d):
    return sampling.label_batches(paired(spark, d), "g", "i", 10, 4, 3)


# Customers and their nations are the pairs to draw from: at sf0.1 parts have 1,599 of their 1,600 (name, brand) pairs as
# positives and leave nothing to draw.



def owners(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("g"))
    return table(spark, d, "customer").join(nation, "c_nationkey").select("g", F.col("c_name").alias("seq"), F.col("c_custkey").alias("i"), F.lit(1).alias("label"))


@query("N03_negatives_shuffle", _drawn_sql("shuffle"))
def _(spark, d):
    return sampling.sample(owners(spark, d), "g", "seq", "i", "shuffle", 3.0).select("source_row_id", "g")


@query("N04_negatives_matched", _drawn_sql("matched"))
def _(spark, d):
    return sampling.sample(owners(spark, d), "g", "seq", "i", "matched", 3.0).select("source_row_id", "g")


@query("N05_negatives_hard", _nearest_sql())
def _(spark, d):
    return sampling.sample(owners(spark, d), "g", "seq", "i", "hard", 3.0).select("source_row_id", "g")


@query("N06_negatives_uniform", f"with {OWNERS} select pos.i source_row_id, pool.g from pos, pool where pos.g <> pool.g")
def _(spark, d):
    return sampling.sample(owners(spark, d), "g", "seq", "i", "uniform", guard=None).select("source_row_id", "g")


@query("N10_negative_summary", f"with n as ({_drawn_sql('shuffle')}) select count(*) n_negatives, count(distinct n.g) n_groups, count(distinct c_name) n_sequences, cast(0 as bigint) n_collisions from n join customer on c_custkey = source_row_id")
def _(spark, d):
    pos = owners(spark, d)
    return sampling.summary(sampling.sample(pos, "g", "seq", "i", "shuffle", 3.0), pos, "g", "seq")


@query("C09_distance_eligible", f"with {OWNERS} select pool.g, pos.seq from pos, pool where levenshtein(pos.g, pool.g) > 3")
def _(spark, d):
    rows = owners(spark, d)
    return sampling.distance_eligible(rows, rows, rows, "g", "seq", 3)


@query("N11_evaluation_set", f"""with {OWNERS}, n as (select *, row_number() over (partition by g order by {rng.unit_sql("'0'", "'cap'", "i")}, i) n from pos), c as (select g, seq from n where n <= 5), w as (select g, 3 * count(*) want from c group by g),
  r as (select w.g, pos.seq, want, row_number() over (partition by w.g order by {rng.unit_sql("'0'", "'negative'", "w.g", "pos.seq")}, pos.seq) n from w, pos where pos.g <> w.g)
  select g, seq, 1 as label from c union all select g, seq, 0 from r where n <= want""")
def _(spark, d):
    pos = owners(spark, d)
    return sampling.evaluation_set(pos, sampling.distance_eligible(pos, pos, pos, "g", "seq", 0), "g", "seq", "i", 5, 3)


@query("E17_corr_bootstrap", f"""with ok as (select i g, x, y from ({PART_G})), {BOOT_SQL}, v as (select replicate, corr(x, y) r from draws join numbered using (pos) group by replicate) select replicate, round(r, 6) r_y from v""")
def _(spark, d):
    return bootstrap.correlation_over_points(points(spark, d).withColumnRenamed("i", "k"), "k", "x", "y", REPLICATES, seed=7).select("replicate", *r6("r_y"))


@query("E18_correlation_difference", f"""with ok as (select i g, x, y, cast(i % 17 as double) z from ({PART_G})), {BOOT_SQL}, v as (select replicate, corr(x, y) - corr(x, z) d from draws join numbered using (pos) group by replicate)
  select round(quantile_cont(d, 0.025), 6) low, round(quantile_cont(d, 0.975), 6) high, count(d) n_replicates, round(least(1e0, 2e0 * least(count(*) filter (d <= 0), count(*) filter (d >= 0)) / count(d)), 6) p from v""")
def _(spark, d):
    rows = points(spark, d).withColumn("z", (F.col("i") % 17).cast("double")).withColumnRenamed("i", "k")
    drawn = bootstrap.correlation_over_points(rows, "k", "x", ["y", "z"], REPLICATES, seed=7)
    return stats.correlation_difference(drawn, "r_y", "r_z").select(*r6("low", "high"), "n_replicates", *r6("p"))


# ---- splits ---------------------------------------------------------------------------------------------------------

@query("P01_component_labels")
def _(spark, d):
    return splits.component_labels(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query("P02_component_split")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    labelled = splits.row_components(rows, "l_suppkey", "l_orderkey")
    return splits.component_split(labelled, 0.3).select("l_suppkey", "l_orderkey", "component", "side")


@query("P03_stratified_split", f"with {AFFIN} select i, case when row_number() over (partition by g, y order by {rng.unit_sql(chr(39) + '0' + chr(39), chr(39) + 'strata' + chr(39), 'i')}, i) <= round(count(*) over (partition by g, y) * 0.1e0) then 'validation' else 'fit' end side from affin")
def _(spark, d):
    return splits.stratified_split(affin(spark, d), ["g", "y"], "i").select("i", "side")


@query("P04_target_stratified_split", f"with {AFFIN} select i, case when row_number() over (partition by y order by {rng.unit_sql(chr(39) + '0' + chr(39), chr(39) + 'strata' + chr(39), 'i')}, i) <= round(count(*) over (partition by y) * 0.1e0) then 'validation' else 'fit' end side from affin")
def _(spark, d):
    return splits.stratified_split(affin(spark, d), ["y"], "i").select("i", "side")


@query("P05_fold_sides", f"with {AFFIN}, f as (select distinct fold partition_id from affin) select partition_id, case when fold = partition_id then 'test' else 'train' end side, count(*) n from affin, f group by all")
def _(spark, d):
    return splits.fold_sides(affin(spark, d), "fold").groupBy("partition_id", "side").agg(F.count(F.lit(1)).alias("n"))


@query("P06_cross_fold_keys", "select l_partkey, count(distinct l_orderkey % 5) n_folds from lineitem group by 1 having count(distinct l_orderkey % 5) > 1")
def _(spark, d):
    return checks.keys_in_several_folds(table(spark, d, "lineitem").withColumn("fold", F.col("l_orderkey") % 5), "l_partkey", "fold")


@query("D13_class_presence", f"""with {AFFIN}, o as (select fold, g, cast(sum(y) as bigint) p, cast(sum(1 - y) as bigint) n from affin group by all)
  select fold, g, p test_pos, n test_neg, cast(sum(p) over (partition by g) - p as bigint) train_pos, cast(sum(n) over (partition by g) - n as bigint) train_neg from o""")
def _(spark, d):
    return checks.class_presence(affin(spark, d), "fold", "g", "y")


HOLD = f"{PAIRED}, t as (select distinct g partition_id from paired where g in ('Brand#1', 'Brand#2'))"


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = paired(spark, d)
    return rows, rows.filter("g in ('Brand#1', 'Brand#2')").select("g").distinct()


@query("P07_holdout_partition", f"with {HOLD} select partition_id, i, case when g = partition_id then 'test' else 'train' end side from paired, t")
def _(spark, d):
    return splits.holdout(*_held(spark, d), "g").select("partition_id", "i", "side")


@query("P07_joint_novelty", f"with {HOLD} select partition_id, i, case when g = partition_id then 'test' else 'train' end side from paired p, t where g = partition_id or not exists (select 1 from paired k where k.g = partition_id and k.seq = p.seq)")
def _(spark, d):
    return splits.holdout(*_held(spark, d), "g", "seq").select("partition_id", "i", "side")


@query("P10_overlap", f"with {HOLD}, k as (select distinct partition_id, seq from paired, t where g = partition_id) select partition_id, count(*) n_test, count(*) filter (exists (select 1 from paired p where p.seq = k.seq and p.g <> k.partition_id)) n_shared, round(cast(count(*) filter (exists (select 1 from paired p where p.seq = k.seq and p.g <> k.partition_id)) as double) / count(*), 6) fraction from k group by 1")
def _(spark, d):
    return splits.overlap(splits.holdout(*_held(spark, d), "g"), "seq").select("partition_id", "n_test", "n_shared", *r6("fraction"))


@query("P11_deletion_accounting", f"""with {HOLD}, r as (select partition_id, exists (select 1 from paired k where k.g = partition_id and k.seq = p.seq) gone from paired p, t where g <> partition_id)
  select partition_id, count(*) rows_before, count(*) filter (not gone) rows_after, count(*) filter (gone) rows_deleted from r group by 1""")
def _(spark, d):
    return splits.holdout_accounting(*_held(spark, d), "g", "seq")


@query("P09_schedule_violations", f"with {HOLD}, k as (select distinct partition_id, seq from paired, t where g = partition_id) select 'seq in both sides' as rule, partition_id from k where exists (select 1 from paired p where p.seq = k.seq and p.g <> k.partition_id) group by 2")
def _(spark, d):
    return splits.schedule_violations(splits.holdout(*_held(spark, d), "g"), "g", "seq", "y")


@query("P12_complete_linkage")
def _(spark, d):
    n = table(spark, d, "nation").select("n_name", F.lpad((F.col("n_nationkey") * 7919).cast("string"), 6, "0").alias("code"))
    return splits.complete_linkage(n, "n_name", "code")


@query("P13_cluster_diagnostics")
def _(spark, d):
    n = table(spark, d, "nation").select("n_name", F.lpad((F.col("n_nationkey") * 7919).cast("string"), 6, "0").alias("code"))
    return splits.cluster_diagnostics(splits.complete_linkage(n, "n_name", "code"), n, "n_name", "code")


# ---- counts, duplicates, features -----------------------------------------------------------------------------------

@query("D01_support", "select p_brand, count(*) support from part group by 1")
def _(spark, d):
    return summary.support(table(spark, d, "part"), "p_brand")


@query("D02_distinct_per_group", "select l_suppkey, count(distinct l_partkey) n_distinct from lineitem group by 1")
def _(spark, d):
    return summary.distinct_per_group(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("D03_class_support", f"with {PAIRED} select g, count(*) filter (y = 1) n_pos, count(*) filter (y = 0) n_neg from paired group by g having n_pos >= 40 and n_neg >= 40")
def _(spark, d):
    return summary.class_support(paired(spark, d), "g", "y", 40)


@query("D04_having_support", "select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)")
def _(spark, d):
    return summary.with_support(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("D05_group_profile", "select p_brand, cast(sum(cast(p_size > 25 as int)) as bigint) n_positive, count(*) n_rows, arg_min(p_name, p_partkey) first_value, (select x.p_type from part x where x.p_brand = p.p_brand group by 1 order by count(*) desc, 1 limit 1) mode_value, count(*) filter (p_retailprice >= 1500) n_high from part p group by 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("y", F.col("p_size") > 25)
    return summary.group_profile(p, "p_brand", "y", "p_name", "p_type", "p_retailprice", 1500, "p_partkey")


@query("D06_mode_by_group", "with k as (select p_brand, p_type, count(*) n from part group by all) select p_brand, arg_min(p_type, row(-n, p_type)) mode from k group by 1")
def _(spark, d):
    return summary.mode_by_group(table(spark, d, "part"), "p_brand", "p_type")


@query("D07_sets_by_key", "select p_brand, array_to_string(list_sort(list(distinct p_type)), ',') as types from part group by 1")
def _(spark, d):
    return summary.sets_by_key(table(spark, d, "part"), "p_brand", "p_type").select("p_brand", F.array_join("values", ",").alias("types"))


@query("D08_share_removed", "select round(100 * avg(cast(r as int)), 6) pct_removed from (select l_partkey, bool_or(l_discount > 0.09e0) r from lineitem group by 1)")
def _(spark, d):
    return summary.share_removed(table(spark, d, "lineitem"), "l_partkey", F.col("l_discount") > 0.09).select(*r6("pct_removed"))


@query("D09_count_spread", "select min(n) least, median(n) median, max(n) most from (select count(*) n from orders group by o_custkey)")
def _(spark, d):
    return summary.count_spread(table(spark, d, "orders"), "o_custkey")


@query("D11_best_row", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) n from part) where n = 1")
def _(spark, d):
    return summary.best_row(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "p_retailprice")


@query("D14_distance_by_source", "select p_brand, round(avg(levenshtein(p_name, p_type)), 6) mean_distance, median(levenshtein(p_name, p_type)) median_distance, count(*) filter (levenshtein(p_name, p_type) = 0) n_exact from part group by 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("d", text.edit_distance("p_name", "p_type"))
    return summary.distance_by_source(p, "p_brand", "d").select("p_brand", *r6("mean_distance"), "median_distance", "n_exact")


@query("B04_keep_best", "select p_brand, p_name, p_partkey from (select *, row_number() over (partition by p_brand, p_name order by p_size desc, p_partkey desc) n from part) where n = 1")
def _(spark, d):
    return summary.keep_best(table(spark, d, "part"), ["p_brand", "p_name"], "p_size", "p_partkey").select("p_brand", "p_name", "p_partkey")


@query("S08_first_per_key", "select p_brand, p_name, min(p_partkey) p_partkey from part group by all")
def _(spark, d):
    return summary.first_per_key(table(spark, d, "part"), ["p_brand", "p_name"], "p_partkey").select("p_brand", "p_name", "p_partkey")


@query("B09_frequency_score", "select p_partkey, count(*) over (partition by p_name) frequency, cast(length(p_name) as int) seq_length from part")
def _(spark, d):
    return summary.frequency_score(table(spark, d, "part"), "p_name").select("p_partkey", "frequency", "seq_length")


@query("S11_union_distinct", "select p_name as value from part union select n_name from nation union select r_name from region")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    return summary.multi_union_distinct([(t("part"), "p_name"), (t("nation"), "n_name"), (t("region"), "r_name")])


@query("S09_length_batches")
def _(spark, d):
    return summary.length_batches(table(spark, d, "part"), "p_name", 100)


@query("B10_random_scores", f"select p_partkey, round({rng.unit_sql(chr(39) + '0' + chr(39), chr(39) + 'random' + chr(39), 'p_partkey')}, 6) score from part")
def _(spark, d):
    return models.random_scores(table(spark, d, "part"), "p_partkey").select("p_partkey", *r6("score"))


@query("B01_strip_anchors", r"select c_custkey, regexp_replace(regexp_replace(upper(trim(c_name)), '^C', ''), '[FW]$', '') as seq from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.strip_anchors("c_name").alias("seq"))


@query("B03_full_match", "select p_partkey, regexp_full_match(upper(p_name), '[ACDEFGHIKLMNPQRSTVWY ]{8,10}') ok from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.full_match(F.upper("p_name"), 8, 10, text.RESIDUES + " ").alias("ok"))


@query("A05_row_types", "select c_custkey, c_acctbal / 10000 > 0.426e0 as \"Target\", case when c_acctbal / 10000 > 0.426e0 then 'positive' when c_acctbal / 10000 = 0.01e0 then 'artificial_negative' else 'measured_nonbinder' end as \"RowType\" from customer")
def _(spark, d):
    return io.with_labels(table(spark, d, "customer").withColumn("Affinity", F.col("c_acctbal") / 10000)).select("c_custkey", "Target", "RowType")


@query("A14_submission", "select o_orderkey, greatest(0e0, least(1e0, o_totalprice / 300000)) \"Prediction\" from orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 300000).alias("score"))
    return io.submission(o.select("o_orderkey"), o, ["o_orderkey"], "o_orderkey")


@query("F08_composition", "select n_nationkey, cast(length(n_name) as double) len, cast(length(n_name) - length(replace(n_name, 'A', '')) as double) a, cast(length(n_name) - length(replace(n_name, 'T', '')) as double) t from nation")
def _(spark, d):
    v = table(spark, d, "nation").select("n_nationkey", text.composition("n_name").alias("v"))
    return v.select("n_nationkey", F.col("v")[0].alias("len"), F.col("v")[1].alias("a"), F.col("v")[17].alias("t"))


@query("F10_one_hot", "select p_partkey, cast(p_brand = 'Brand#1' as double) b1, cast(p_brand = 'Brand#2' as double) b2 from part")
def _(spark, d):
    v = table(spark, d, "part").select("p_partkey", text.one_hot("p_brand", ["Brand#1", "Brand#2"]).alias("v"))
    return v.select("p_partkey", F.col("v")[0].alias("b1"), F.col("v")[1].alias("b2"))


@query("F06_pair_features", "select l.vec_id, 256 as width, round(cast(abs(l.embedding[1] - r.embedding[1]) as double), 5) diff, round(cast(l.embedding[1] * r.embedding[1] as double), 5) prod from embeddings l join embeddings r on r.vec_id = l.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w")), "vec_id").withColumn("f", vector.pair_features("embedding", "w", "interactions"))
    return j.select("vec_id", F.size("f").alias("width"), F.round(F.col("f")[128].cast("double"), 5).alias("diff"), F.round(F.col("f")[192].cast("double"), 5).alias("prod"))


@query("F11_derangement", "select n_nationkey, n_name, coalesce(lead(n_name) over (order by n_name), min(n_name) over ()) shifted from nation")
def _(spark, d):
    return text.derangement(table(spark, d, "nation"), "n_nationkey", "n_name")


@query("F12_label_encode", "select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as int) code from part")
def _(spark, d):
    return text.label_encode(table(spark, d, "part"), "p_brand").select("p_partkey", "code")


@query("F13_standardise", "select vec_id, round((x - avg(x) over ()) / stddev_pop(x) over (), 5) x1 from (select vec_id, cast(embedding[1] as double) x from embeddings)")
def _(spark, d):
    return vector.standardise(table(spark, d, "embeddings"), "embedding").select("vec_id", F.round(F.col("scaled")[0], 5).alias("x1"))


@query("F05_norms", "select vec_id, round(sqrt(list_dot_product(v, v)), 5) norm from (select vec_id, cast(embedding as double[]) v from embeddings)")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm("embedding"), 5).alias("norm"))


# ---- models ---------------------------------------------------------------------------------------------------------

@query("M01_pwm_scores", f"""with {AFFIN}, p as (select range pos from range(9)), tot as (select g, cast(sum(y) as double) np, cast(sum(1 - y) as double) nn from affin where fold <> 0 group by g), l as (select i, g, y, fold, pos, substr(seq, cast(pos as int) + 1, 1) r from affin, p),
  c as (select g, pos, r, sum(y) p, sum(1 - y) n from l where fold <> 0 group by all)
  select l.i, round(sum(ln(((coalesce(c.p, 0) + 1e0) / (np + 10e0)) / ((coalesce(c.n, 0) + 1e0) / (nn + 10e0)))), 6) score from l join tot using (g) left join c on c.g = l.g and c.pos = l.pos and c.r = l.r where fold = 0 group by l.i""")
def _(spark, d):
    rows = affin(spark, d)
    matrix = models.pwm(rows.filter("fold <> 0"), "g", "seq", "y", 9, DIGITS)
    return models.pwm_score(rows.filter("fold = 0"), matrix, "g", "seq", "i").select("i", *r6("score"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(affin(spark, d), ["y"], "i", 0.3).withColumn("side", F.when(F.col("side") == "fit", "train").otherwise("test")).withColumn("x", text.composition("seq", DIGITS))


@query("M04_composition_logistic")
def _(spark, d):
    return models.fit_and_score(_features(spark, d), ["g"], "x", "y", "i")


@query("M09_svc_by_group")
def _(spark, d):
    return models.fit_and_score(_features(spark, d), ["g"], "x", "y", "i", model="svc")


@query("M07_mlp_ensemble")
def _(spark, d):
    rows = _features(spark, d).withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 10000)))
    return models.ensemble(rows, "x", "t", "i", "g").select("g", "i", *r6("score"))


@query("M08_peptide_only_ensemble")
def _(spark, d):
    """The sequence alone, all groups together, each fold by networks of the others."""
    rows = affin(spark, d).withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 10000)))
    parts = splits.fold_sides(rows, "fold")
    cut = splits.stratified_split(parts.filter("side = 'train'"), ["partition_id", "y"], "i").unionByName(parts.filter("side = 'test'"))
    cut = cut.withColumn("x", models.hot("seq", 9, DIGITS))
    return models.ensemble(cut, "x", "t", "i", "partition_id", width=90).select("partition_id", "i", *r6("score"))


@query("M03_pooled_logistic")
def _(spark, d):
    rows = _features(spark, d)
    own = linear.fit(rows.filter("side = 'train'"), "x", "y")
    return rows.filter("side = 'test'").select("i", F.round(own.score("x"), 6).alias("score"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = linear.composition_pairs(paired(spark, d), "seq", "a", "aeiorstn")
    return rows.filter("i % 4 <> 0"), rows.filter("i % 4 = 0")


@query("M10_global_svc")
def _(spark, d):
    return linear.pair_classifier(*_sides(spark, d), "_left", "_right", "y", "i").select("i", *r6("score"))


@query("E30_shortcut_probes")
def _(spark, d):
    return linear.shortcut_probes(*_sides(spark, d), "_left", "_right", "y", "g").select("probe", *r6("pooled_auroc", "macro_auc01"), "n_scored", "n_distinct", *r6("gap"))


@query("M22_layer_sweep")
def _(spark, d):
    """Four slices of a vector stand in for layers, plain and squared values for models."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), (F.col("label") % 5).alias("g"), F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train").alias("side"), "embedding")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("layer"), F.transform(F.slice("embedding", 16 * k + 1, 16), f).alias("x")) for k in range(4) for m, f in (("plain", lambda v: v.cast("double")), ("squared", lambda v: v.cast("double") * v)))))
    long = e.select("vec_id", "y", "g", "side", each.alias("_l")).select("vec_id", "y", "g", "side", "_l.*")
    return models.layer_sweep(long, "model", "layer", "g", "x", "y", "vec_id").select("model", "layer", "n_scored", *r6("macro_auroc"), "chosen")


@query("M13_fold_arms")
def _(spark, d):
    rows = affin(spark, d).withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 10000)))
    return experiment.fold_arms(rows, "fold", "g", "seq", "y", "i", 9, DIGITS, target="t").select("i", "arm", *r6("score"))


@query("M22_best_setting", "with v as (select p_brand, p_size, avg(p_retailprice) v from part group by all) select p_brand, arg_min(p_size, row(-v, p_size)) p_size, round(max(v), 6) v from v group by 1")
def _(spark, d):
    grid = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return models.best_setting(grid, "p_brand", "p_size", "v").select("p_brand", "p_size", *r6("v"))


@query("M19_info_nce", """with e as (select vec_id, label, vec_id // 25 batch, cast(embedding as double[]) v from embeddings), s as (select a.batch, a.vec_id i, b.vec_id j, a.label = b.label same, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) / 0.1e0 s from e a join e b using (batch) where a.vec_id <> b.vec_id),
  t as (select *, ln(sum(exp(s)) over (partition by batch, i)) den from s), l as (select batch, i, -avg(s - den) l from t where same group by all) select batch, round(avg(l), 5) loss from l group by 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("batch", F.expr("vec_id div 25"))
    return models.info_nce(e, "batch", "vec_id", "label", "embedding").select("batch", F.round("loss", 5).alias("loss"))


@query("M15_hashed_embedding")
def _(spark, d):
    return models.hashed_embedding(table(spark, d, "part"), "p_name")


@query("M17_mean_pool", "select p_brand, round(avg(p_size), 6) m0, round(avg(p_retailprice), 6) m1 from part group by 1")
def _(spark, d):
    ragged = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.array(F.col("p_size").cast("double"), "p_retailprice")).alias("rows"))
    v = ragged.select("p_brand", vector.mean_pool("rows").alias("m"))
    return v.select("p_brand", F.round(F.col("m")[0], 6).alias("m0"), F.round(F.col("m")[1], 6).alias("m1"))


def _transfer_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = affin(spark, d).withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 10000)))
    return experiment.transfer_scores(rows, rows.select("g").distinct(), "g", "seq", "y", "i", 9, DIGITS, target="t")


@query("M11_transfer_arms")
def _(spark, d):
    return _transfer_scores(spark, d).select("partition_id", "i", *r6(*experiment.TRANSFER_ARMS))


@query("M12_schedule_evaluation")
def _(spark, d):
    return experiment.transfer(_transfer_scores(spark, d), "y", "i", REPLICATES)


@query("M12_schedule_comparisons")
def _(spark, d):
    return experiment.transfer_comparisons(_transfer_scores(spark, d), "y", "i", REPLICATES)


@query("E31_regime_sweep")
def _(spark, d):
    rows = graded(spark, d).withColumns({"all_rows": F.lit(True), "heavy": F.col("l_quantity") > 10})
    return experiment.regime_sweep(rows, "g", "y", ["s", "l_tax"], "i", ["all_rows", "heavy"], REPLICATES)


@query("A11_json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers by nation, each region's nations held out together, and a code of each nation."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("g"), F.col("n_regionkey").cast("string").alias("partition_id"), F.lpad((F.col("n_nationkey") * 7919).cast("string"), 6, "0").alias("code"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("i"), "g", F.concat("c_mktsegment", F.expr("c_nationkey div 2").cast("string")).alias("seq"))
    return c, n.join(c, "g", "left_semi")


@query("P08_cluster_schedule")
def _(spark, d):
    """Nations clustered by their codes, each cluster's customers held out together."""
    c, n = regions(spark, d)
    held = splits.cluster_schedule(splits.complete_linkage(n, "g", "code"), "g")
    sides = splits.schedule(c, held, "g").groupBy("partition_id").agg(F.count_if(F.col("side") == "test").alias("n_test"), F.count_if(F.col("side") == "train").alias("n_train"))
    return held.select("position", "partition_id").distinct().join(sides, "partition_id").select("position", "partition_id", "n_test", "n_train")


@query("E29_lookup_interval")
def _(spark, d):
    """What rows of a first line, taken as known, add to the macro metric, with an interval."""
    rows_ = graded(spark, d).withColumn("ex", F.col("i") % 10 == 1)
    out = experiment.lookup_decomposition(rows_, "g", "y", "s", "ex", "i")
    return out.select(*r6("difference", "low", "high"), "n_replicates", *r6("p"), "n_groups", *r6("share_exact"))
