"""Evaluation: metrics, intervals, paired tests, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cwe
from ..functions.stats import safe_ratio, wilson
from ..operators import metrics, sampling, stats
from .base import Registry, table

R = Registry()
query = R.query

#: Documents as evaluation records: quality stands for passing tests, toxic for the target weakness, no label for no tests.
RECORDS = """SELECT d.doc_id, d.source, d.lang AS language, d.n_chars, d.text,
  d.n_chars >= 200 AS compiles, d.n_chars < 40 AS refusal, d.doc_id % 97 = 0 AS crashed,
  coalesce(l.toxic, 0) = 1 AS target_cwe_present, CAST(coalesce(l.quality, 0) AS BIGINT) AS tests_passed,
  CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS tests_total, CAST(CASE WHEN l.doc_id IS NULL AND d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_test_cases,
  d.n_chars < 120 AS stub,
  CASE d.source WHEN 'src0' THEN 7.8 WHEN 'src1' THEN 8.2 WHEN 'src2' THEN 6.8 WHEN 'src3' THEN 5.5 WHEN 'src4' THEN 3.65 END AS severity
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def records(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    severity = cwe.mapping({"src0": 7.8, "src1": 8.2, "src2": 6.8, "src3": 5.5, "src4": 3.65})[F.col("source")]
    return docs.drop("text").join(labels, "doc_id", "left").select(
        "doc_id", "source", F.col("lang").alias("language"), "n_chars", (F.col("n_chars") >= 200).alias("compiles"), (F.col("n_chars") < 40).alias("refusal"), (F.col("doc_id") % 97 == 0).alias("crashed"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("target_cwe_present"), F.coalesce("quality", F.lit(0)).cast("long").alias("tests_passed"), F.when(F.col("quality").isNull(), 0).otherwise(1).cast("long").alias("tests_total"),
        F.when(F.col("quality").isNull() & (F.col("doc_id") % 3 == 0), 1).otherwise(0).cast("long").alias("n_test_cases"), (F.col("n_chars") < 120).alias("stub"), severity.alias("severity"),
    )


_C = "(compiles AND NOT refusal AND NOT crashed)"
_S = "(NOT refusal AND NOT crashed AND NOT target_cwe_present)"
_T = "(tests_total > 0)"
_TS = "(n_test_cases > 0 OR tests_total > 0)"
_FN = "(tests_total > 0 AND tests_passed = tests_total)"
METRIC_SQL = {
    "compile_at_1": (_C, "true"),
    "attempt_at_1": ("(NOT refusal AND NOT crashed)", "true"),
    "secure_at_1__compiles": (_S, _C),
    "func_at_1__has_tests": (_FN, _T),
    "func_sec_at_1__compiles_and_has_tests": (f"{_FN} AND {_S}", f"{_C} AND {_T}"),
    "func_sec_at_1__compiles_and_has_tests_and_nonstub": (f"{_FN} AND {_S} AND NOT stub", f"{_C} AND {_T}"),
    "func_sec_at_1__has_tests": (f"{_FN} AND {_S}", _TS),
    "func_sec_at_1__has_tests_and_nonstub": (f"{_FN} AND {_S} AND NOT stub", _TS),
    "stub_rate__compiles": ("stub", _C),
    "func_at_1": (_FN, "true"),
    "secure_at_1": (_S, "true"),
    "func_sec_at_1": (f"{_FN} AND {_S}", "true"),
    "secure_at_1__high_severity_compiles": (_S, f"{_C} AND coalesce(severity >= 7, false)"),
    "secure_at_1__medium_severity_compiles": (_S, f"{_C} AND coalesce(severity >= 4 AND severity < 7, false)"),
}
_WILSON = """round(CASE WHEN n_den > 0 THEN greatest(0.0, ((n_num/n_den) + 3.8416/(2*n_den))/(1+3.8416/n_den) - 1.96*sqrt((n_num/n_den)*(1-(n_num/n_den))/n_den + 3.8416/(4.0*n_den*n_den))/(1+3.8416/n_den)) ELSE 0.0 END, 6) AS wilson_lo,
 round(CASE WHEN n_den > 0 THEN least(1.0, ((n_num/n_den) + 3.8416/(2*n_den))/(1+3.8416/n_den) + 1.96*sqrt((n_num/n_den)*(1-(n_num/n_den))/n_den + 3.8416/(4.0*n_den*n_den))/(1+3.8416/n_den)) ELSE 0.0 END, 6) AS wilson_hi"""
_LONG = " UNION ALL ".join(f"SELECT source, language, '{m}' AS metric, CAST(count(*) FILTER (({b}) AND ({c})) AS BIGINT) AS n_num, CAST(count(*) FILTER ({c}) AS BIGINT) AS n_den FROM r GROUP BY GROUPING SETS ((), (source), (source, language))" for m, (b, c) in METRIC_SQL.items())


@query(f"WITH r AS ({RECORDS}), m AS ({_LONG}) SELECT source, language, metric, round(CASE WHEN n_den > 0 THEN n_num / n_den ELSE 0.0 END, 6) AS value, n_num, n_den, {_WILSON} FROM m")
def metric_registry_grain(spark, sf_dir):
    """AGG1-3, MTH1, EVL1, EVL4."""
    found = metrics.conditional_rates(records(spark, sf_dir), metrics.record_predicates(F.col("stub"), F.col("severity")), [[], ["source"], ["source", "language"]])
    return found.select("source", "language", "metric", F.round("value", 6).alias("value"), "n_num", "n_den", F.round("wilson_lo", 6).alias("wilson_lo"), F.round("wilson_hi", 6).alias("wilson_hi"))


@query(f"""WITH r AS ({RECORDS}), b AS (SELECT CASE WHEN severity >= 7 THEN 'high' WHEN severity >= 4 THEN 'medium' WHEN severity IS NOT NULL THEN 'low' END AS bin, {_S} AS secure, {_C} AS compiled FROM r)
SELECT bin, CAST(count(*) FILTER (compiled) AS BIGINT) AS n_den, CAST(count(*) FILTER (secure AND compiled) AS BIGINT) AS n_num, round(coalesce(count(*) FILTER (secure AND compiled) / nullif(count(*) FILTER (compiled), 0), 0.0), 6) AS value FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def metric_severity_binned(spark, sf_dir):
    """EVL2."""
    secure, compiled = metrics.record_predicates(F.col("stub"), F.col("severity"))["secure_at_1__compiles"]
    binned = records(spark, sf_dir).withColumn("bin", cwe.severity_bin("severity")).where("bin IS NOT NULL")
    return binned.groupBy("bin").agg(F.count_if(compiled).alias("n_den"), F.count_if(secure & compiled).alias("n_num")).withColumn("value", F.round(safe_ratio("n_num", "n_den"), 6))


_TOOLS = "['codeql', 'semgrep', 'bandit', 'cppcheck']"


@query(f"""WITH r AS ({RECORDS}), a AS (SELECT count(*) AS n, sum(CAST(refusal AS INT)) AS refusals, sum(CAST(crashed AS INT)) AS crashes, avg(n_chars) AS mean_chars, avg(CASE WHEN {_C} THEN tests_passed END) AS mean_passed FROM r),
t AS (SELECT {_TOOLS}[CAST(doc_id % 4 AS INT) + 1] AS tool, count(*) AS hits FROM r WHERE doc_id % 5 = 0 GROUP BY 1)
SELECT tool, CAST(hits AS BIGINT) AS timeouts, round(hits / n, 6) AS timeout_rate, round(refusals / n, 6) AS refusal_rate, round(crashes / n, 6) AS crash_rate, round(mean_chars, 4) AS mean_chars, round(coalesce(mean_passed, 0.0), 6) AS mean_passed FROM t, a""")
def record_diagnostics(spark, sf_dir):
    """AGG4, AGG6, ARR1: rates over all records, and per tool over an exploded list."""
    r = records(spark, sf_dir)
    compiled = metrics.record_predicates(F.col("stub"), F.col("severity"))["compile_at_1"][0]
    tools = F.when(F.col("doc_id") % 5 == 0, F.array(F.element_at(F.array(*map(F.lit, ("codeql", "semgrep", "bandit", "cppcheck"))), (F.col("doc_id") % 4 + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    every = r.agg(F.count("*").alias("n"), F.avg(F.col("refusal").cast("int")).alias("refusal_rate"), F.avg(F.col("crashed").cast("int")).alias("crash_rate"), F.avg("n_chars").alias("mean_chars"), F.coalesce(F.avg(F.when(compiled, F.col("tests_passed"))), F.lit(0.0)).alias("mean_passed"))
    per = r.select(F.explode(tools).alias("tool")).groupBy("tool").agg(F.count("*").alias("timeouts"))
    return per.join(F.broadcast(every)).select("tool", "timeouts", F.round(F.col("timeouts") / F.col("n"), 6).alias("timeout_rate"), F.round("refusal_rate", 6).alias("refusal_rate"), F.round("crash_rate", 6).alias("crash_rate"), F.round("mean_chars", 4).alias("mean_chars"), F.round("mean_passed", 6).alias("mean_passed"))


@query("""WITH s AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, CAST(max(n) AS BIGINT) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, CAST(max(CASE WHEN rn = greatest(1, CAST(floor(0.95 * n) AS BIGINT)) THEN n_chars END) AS BIGINT) AS p95 FROM s GROUP BY source""")
def length_distribution(spark, sf_dir):
    """AGG5: p95 is an element, not an interpolation."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    per = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.percentile("n_chars", 0.5), 4).alias("median"))
    return per.join(metrics.index_percentile(d, ["source"], "n_chars", 0.95, "p95"), "source")


@query("""WITH s AS (SELECT d.lang, d.source, avg(l.quality) AS value FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2)
SELECT lang, CAST(count(*) AS BIGINT) AS seeds, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM s GROUP BY lang""")
def multiseed_summary(spark, sf_dir):
    """AGG15, EVL8: source stands for the seed."""
    per = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source").agg(F.avg("quality").alias("value"))
    return per.groupBy("lang").agg(F.count("*").alias("seeds"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


_ARMS = "SELECT d.source, coalesce(l.quality = 1, false) AS off_ok, (d.n_chars % 3 <> 0) AS on_ok FROM documents d LEFT JOIN labels l USING (doc_id)"


def arms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("off_ok"), (F.col("n_chars") % 3 != 0).alias("on_ok"))


@query(f"""WITH a AS ({_ARMS}), c AS (SELECT source, CAST(count(*) FILTER (off_ok AND on_ok) AS BIGINT) AS both, CAST(count(*) FILTER (off_ok AND NOT on_ok) AS BIGINT) AS only_off, CAST(count(*) FILTER (NOT off_ok AND on_ok) AS BIGINT) AS only_on, CAST(count(*) FILTER (NOT off_ok AND NOT on_ok) AS BIGINT) AS neither FROM a GROUP BY source)
SELECT *, round(CASE WHEN only_off + only_on > 0 THEN pow(abs(only_off - only_on) - 1, 2) / (only_off + only_on) ELSE 0.0 END, 6) AS chi2, coalesce(pow(abs(only_off - only_on) - 1, 2) / nullif(only_off + only_on, 0) >= 3.841459, false) AS significant FROM c""")
def mcnemar_counts(spark, sf_dir):
    """JN7, AGG16, MTH2 without the p value."""
    return stats.mcnemar(arms(spark, sf_dir), "source", "off_ok", "on_ok").withColumn("significant", F.col("chi2") >= 3.841459).withColumn("chi2", F.round("chi2", 6))


@query()
def mcnemar_pvalue(spark, sf_dir):
    """MTH2, EVL7: with p and its correction."""
    return stats.benjamini_hochberg(stats.with_p(stats.mcnemar(arms(spark, sf_dir), "source", "off_ok", "on_ok")), "p", ["source"]).withColumn("p", F.round("p", 6)).withColumn("q", F.round("q", 6))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE n_chars >= 500), b AS (SELECT doc_id FROM labels)
SELECT CAST(count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS BIGINT) AS paired, CAST(count(*) FILTER (b.doc_id IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (a.doc_id IS NULL) AS BIGINT) AS only_right FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def paired_arms(spark, sf_dir):
    """JN7: one-sided rows counted."""
    a = table(spark, sf_dir, "documents").where("n_chars >= 500").select(F.col("doc_id").alias("x"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("y"))
    both = a.join(b, F.col("x") == F.col("y"), "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("paired"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) / (count(*) OVER () + 1.0) AS p0 FROM part), q AS (SELECT p_partkey, p0 * p0 AS p FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS rank, count(*) OVER () AS n FROM q)
SELECT p_partkey, round(p, 8) AS p, CAST(rank AS BIGINT) AS rank, round(least(1.0, min(p * n / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_fdr(spark, sf_dir):
    """WIN7."""
    share = F.col("_rank") / (F.col("_n") + F.lit(1.0))
    part = sampling.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [], ["p_retailprice", "p_partkey"])
    found = stats.benjamini_hochberg(part.select("p_partkey", (share * share).alias("p")), "p", ["p_partkey"])
    return found.select("p_partkey", F.round("p", 8).alias("p"), F.col("rank").cast("long").alias("rank"), F.round("q", 6).alias("q"))


@query("""WITH w AS (SELECT p_brand, p_partkey, p_retailprice AS v, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nx, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (v - nx) DESC NULLS LAST, rn) AS best, count(*) OVER (PARTITION BY p_brand) AS n FROM w)
SELECT p_brand, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 THEN round((v + nx) / 2, 3) END AS elbow FROM g WHERE best = 1""")
def elbow_gap(spark, sf_dir):
    """WIN8."""
    return stats.elbow(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey")


@query("""WITH r AS (SELECT d.lang, d.n_chars AS score, l.quality = 1 AS pos FROM documents d JOIN labels l USING (doc_id)),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM r),
s AS (SELECT lang, sum(CASE WHEN pos THEN rk ELSE 0 END) AS r, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM k GROUP BY lang)
SELECT lang, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round((r - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auc FROM s""")
def auc_rank_sum(spark, sf_dir):
    """AGG21."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("pos", F.col("quality") == 1)
    return stats.auc(rows, ["lang"], "n_chars", "pos").withColumn("auc", F.round("auc", 6))


@query()
def bootstrap_ci(spark, sf_dir):
    """EVL3: intervals of groups with 20 rows or more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("source").agg(F.sum("quality").cast("long").alias("n_num"), F.count("*").alias("n_den")).where("n_den >= 20")
    return stats.bootstrap(counts, ["source"], "n_num", "n_den")


@query(f"""WITH r AS ({RECORDS}), x AS (SELECT source, language, compiles AS old_ok, compiles AND n_chars % 7 <> 0 AS new_ok, {_S} AS secure FROM r)
SELECT source, language, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(old_ok AS INT)), 6) AS old_rate, round(avg(CAST(new_ok AS INT)), 6) AS new_rate, CAST(count(*) FILTER (old_ok AND NOT new_ok) AS BIGINT) AS lost, round(coalesce(count(*) FILTER (new_ok AND secure) / nullif(count(*) FILTER (new_ok), 0), 0.0), 6) AS secure_rate FROM x GROUP BY GROUPING SETS ((), (source), (language))""")
def rescore_old_new(spark, sf_dir):
    """JN8, AGG22, EVL9: a new compile flag against the stored one."""
    secure = metrics.record_predicates(F.col("stub"), F.col("severity"))["secure_at_1"][0]
    x = records(spark, sf_dir).select("source", "language", F.col("compiles").alias("old_ok"), (F.col("compiles") & (F.col("n_chars") % 7 != 0)).alias("new_ok"), secure.alias("secure"))
    out = x.groupingSets([[], [F.col("source")], [F.col("language")]], "source", "language").agg(F.count("*").alias("n"), F.round(F.avg(F.col("old_ok").cast("int")), 6).alias("old_rate"), F.round(F.avg(F.col("new_ok").cast("int")), 6).alias("new_rate"), F.count_if(F.col("old_ok") & ~F.col("new_ok")).alias("lost"), F.count_if(F.col("new_ok") & F.col("secure")).alias("k"), F.count_if("new_ok").alias("d"))
    return out.withColumn("secure_rate", F.round(safe_ratio("k", "d"), 6)).drop("k", "d")


@query(f"""WITH r AS ({RECORDS}), m AS (SELECT language AS model, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({_C}) AS BIGINT) AS compiled, CAST(count(*) FILTER ({_S}) AS BIGINT) AS secure, CAST(count(*) FILTER (crashed) AS BIGINT) AS errors FROM r GROUP BY language)
SELECT model, n, compiled, round(compiled / n, 6) AS compile_rate, round(secure / n, 6) AS secure_rate, errors FROM m""")
def report_views(spark, sf_dir):
    """EVL5-6, EVL10: scalar rates by model, with errors counted and empty groups as 0."""
    p = metrics.record_predicates(F.col("stub"), F.col("severity"))
    out = records(spark, sf_dir).groupBy(F.col("language").alias("model")).agg(F.count("*").alias("n"), F.count_if(p["compile_at_1"][0]).alias("compiled"), F.count_if(p["secure_at_1"][0]).alias("secure"), F.count_if("crashed").alias("errors"))
    return out.select("model", "n", "compiled", F.round(safe_ratio("compiled", "n"), 6).alias("compile_rate"), F.round(safe_ratio("secure", "n"), 6).alias("secure_rate"), "errors")


_BINS = "CASE WHEN s >= 1 THEN 'exact' WHEN s >= .95 THEN '[.95,1)' WHEN s >= .9 THEN '[.9,.95)' WHEN s >= .85 THEN '[.85,.9)' WHEN s >= .8 THEN '[.8,.85)' WHEN s >= .7 THEN '[.7,.8)' WHEN s >= .5 THEN '[.5,.7)' WHEN s >= .3 THEN '[.3,.5)' ELSE '[0,.3)' END"


@query(f"""WITH s AS (SELECT round(abs(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT {_BINS} AS bin, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def similarity_histogram(spark, sf_dir):
    """AGG19: unequal bins and an exact bucket, over neighbouring vectors."""
    from ..functions.stats import cosine

    e = table(spark, sf_dir, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select(F.round(F.abs(cosine("a", "b")), 6).alias("s")).select(F.expr(_BINS).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) % 5 > 0 AS secure_pass, length(text) % 3 > 0 AS vulnerable_pass FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS cases, bool_and(secure_pass) AS secure_ok, bool_or(NOT vulnerable_pass) AS vulnerable_fails, bool_and(secure_pass) AND bool_or(NOT vulnerable_pass) AS admitted, round(avg(CAST(secure_pass AS INT)) - avg(CAST(vulnerable_pass AS INT)), 6) AS gap FROM c GROUP BY conv_id""")
def pair_admission(spark, sf_dir):
    """EVL11-12: a pair is admitted if the secure side passes all cases and the vulnerable side fails one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") % 5 > 0).alias("s"), (F.length("text") % 3 > 0).alias("v"))
    out = c.groupBy("conv_id").agg(F.count("*").alias("cases"), F.bool_and("s").alias("secure_ok"), F.bool_or(~F.col("v")).alias("vulnerable_fails"), F.round(F.avg(F.col("s").cast("int")) - F.avg(F.col("v").cast("int")), 6).alias("gap"))
    return out.withColumn("admitted", F.col("secure_ok") & F.col("vulnerable_fails"))
