"""Registered queries: top-k, arg-min and set operations."""

from pyspark.sql import functions as F

from essenta.operators import topk as K
from essenta.operators.aggregates import group_mean
from essenta.operators.joins import merge_drug_targets
from essenta.operators.order import median, top_rows
from essenta.operators.statistics import spearman
from essenta.plans.catalog import R, query, r, with_

RHO = """
xr AS (SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rx FROM expr),
yr AS (SELECT sample, response, rank() OVER (PARTITION BY response ORDER BY value) + (count(*) OVER (PARTITION BY response, value) - 1) / 2.0 AS ry FROM resp),
rho AS (SELECT response, gene, corr(rx, ry) AS rho FROM xr JOIN yr USING (sample) GROUP BY 1, 2)"""


@query("f1_top_features", with_("expr resp", RHO) + f"""
SELECT response, gene, {R('rho')} AS rho, rank FROM (SELECT *, row_number() OVER (PARTITION BY response ORDER BY abs(rho) DESC NULLS LAST, gene) AS rank FROM rho)
WHERE rank <= 10""")
def _(t):
    corr = spearman(t.expression(), t.responses(), aligned=True)
    return K.top_features(corr, ["response"], 10).select("response", "gene", r("rho").alias("rho"), "rank")


@query("f2_feature_set", with_("expr resp", RHO) + """
SELECT DISTINCT gene FROM (SELECT *, row_number() OVER (PARTITION BY response ORDER BY abs(rho) DESC NULLS LAST, gene) AS rank FROM rho)
WHERE rank <= 10 UNION SELECT 'f0'""")
def _(t):
    top = K.top_features(spearman(t.expression(), t.responses(), aligned=True), ["response"], 10)
    return K.feature_set(top, [], t.spark.sql("SELECT 'f0' AS gene"))


@query("f3_extremes", """
SELECT p_brand, p_partkey, CASE WHEN a <= 5 THEN 'top' WHEN b <= 5 THEN 'bottom' ELSE 'normal' END AS label FROM (SELECT *,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)""")
def _(t):
    return K.extremes(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", 5, "p_partkey").select(
        "p_brand", "p_partkey", "label")


@query("f4_multi_key_top", """
SELECT p_type, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, abs(p_retailprice - 1500) DESC, p_partkey) AS rank FROM part) WHERE rank <= 5""")
def _(t):
    order = [F.col("p_size"), F.abs(F.col("p_retailprice") - 1500).desc(), F.col("p_partkey")]
    return top_rows(t.part, ["p_type"], order, 5).select("p_type", "p_partkey", "rank")


@query("f5_top_with_ties", """
SELECT p_brand, p_partkey, rank FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part) WHERE rank <= 3""")
def _(t):
    return K.top_with_ties(t.part, ["p_brand"], "p_size", 3).select("p_brand", "p_partkey", "rank")


@query("f6_pathway_table", f"""
SELECT term, z, {R('-log10(q)')} AS log_q FROM (SELECT p_name AS term, max(p_retailprice) AS z, min(p_size) / 100.0 AS q FROM part GROUP BY 1)
ORDER BY z DESC, term LIMIT 10""")
def _(t):
    terms = t.part.groupBy(F.col("p_name").alias("term")).agg(
        F.max("p_retailprice").alias("z"), (F.min("p_size") / F.lit(100.0)).alias("q"))
    top = terms.orderBy(F.desc("z"), "term").limit(10)
    return top.select("term", "z", r(-F.log10("q")).alias("log_q")).orderBy("z", "term")


@query("f7_arg_min", """
SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def _(t):
    return K.arg_min(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", "c_custkey")


@query("f8_top_lineages", with_("lin", """
m AS (SELECT c_mktsegment AS model, lineage, avg(c_acctbal) AS mean FROM lin GROUP BY 1, 2)""") + f"""
SELECT model, lineage, {R('mean')} AS mean, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, lineage) AS rank FROM m) WHERE rank <= 3""")
def _(t):
    means = group_mean(t.lineage().withColumnRenamed("c_mktsegment", "model"), ["model", "lineage"], "c_acctbal")
    return top_rows(means, ["model"], [F.desc("mean"), F.col("lineage")], 3).select("model", "lineage", r("mean").alias("mean"), "rank")


@query("f8_lineage_enrichment", with_("lin", """
i AS (SELECT c_mktsegment AS model, lineage, sum(c_acctbal) AS s, count(*) AS n FROM lin GROUP BY 1, 2)""", """
a AS (SELECT c_mktsegment AS model, sum(c_acctbal) AS s, count(*) AS n FROM lin GROUP BY 1)""", """
e AS (SELECT lineage, model, i.s / i.n - (a.s - i.s) / (a.n - i.n) AS e FROM i JOIN a USING (model))""") + f"""
SELECT lineage, model, {R('e')} AS enrichment, rank FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY e DESC, model) AS rank FROM e) WHERE rank <= 3""")
def _(t):
    rows = t.lineage().withColumnRenamed("c_mktsegment", "model")
    return K.enrichment(rows, "model", "lineage", "c_acctbal").withColumn("enrichment", r("enrichment"))


@query("f9_groups_by_median", f"""
SELECT o_orderpriority AS drug, {R('quantile_cont(o_totalprice, 0.5)')} AS median FROM orders GROUP BY 1 ORDER BY 2 DESC""")
def _(t):
    return median(t.orders.select(F.col("o_orderpriority").alias("drug"), "o_totalprice"), ["drug"], "o_totalprice").select(
        "drug", r("median").alias("median")).orderBy(F.desc("median"))


@query("f10_absolute_sort", """
SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS v FROM customer) ORDER BY abs(v) NULLS FIRST, c_custkey""")
def _(t):
    v = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("v")
    return t.customer.select("c_custkey", v).orderBy(F.abs("v").asc_nulls_first(), "c_custkey")


@query("f11_tagged_union", """
SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def _(t):
    a = t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = t.supplier.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return a.unionByName(b)


_MERGE = """
WITH a AS (SELECT upper(p_brand) AS drug, p_type AS target, 0 AS place FROM part WHERE p_size < 5),
b AS (SELECT upper(p_brand), p_name, 1 FROM part WHERE p_size > 45), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
"""


def _drug_tables(t):
    for where, name in (("p_size < 5", "p_type"), ("p_size > 45", "p_name")):
        rows = t.part.where(where).groupBy(F.col("p_brand").alias("drug")).agg(F.array_join(F.collect_set(name), ", ").alias("targets"))
        yield rows


@query("f11_merge_drug_targets", _MERGE + "SELECT DISTINCT drug, target FROM u")
def _(t):
    return merge_drug_targets(list(_drug_tables(t)))


@query("f11_first_drug_targets", _MERGE + "SELECT DISTINCT drug, target FROM u WHERE (drug, place) IN (SELECT (drug, min(place)) FROM u GROUP BY drug)")
def _(t):
    return merge_drug_targets(list(_drug_tables(t)), first_only=True)


@query("f12_in_all", """
SELECT o_custkey AS sample FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("model"))
    return K.in_all(rows, "sample", "model")


@query("f13_overlap_regions", """
SELECT concat_ws('&', CASE WHEN a THEN 'F' END, CASE WHEN b THEN 'O' END, CASE WHEN c THEN 'P' END) AS region, count(*) AS n FROM (
 SELECT o_custkey, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'O') AS b, bool_or(o_orderstatus = 'P') AS c FROM orders GROUP BY 1) GROUP BY 1""")
def _(t):
    return K.overlap_regions(t.orders, "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("f14_set_operations", """
WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40)
SELECT 'union' AS op, name FROM (SELECT name FROM a UNION SELECT name FROM b) UNION ALL
SELECT 'difference', name FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL
SELECT 'intersection', name FROM (SELECT name FROM a INTERSECT SELECT name FROM b)""")
def _(t):
    a = t.part.where("p_size < 10").select(F.col("p_name").alias("name"))
    b = t.part.where("p_size > 40").select(F.col("p_name").alias("name"))
    named = {"union": a.union(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b)}
    parts = [df.select(F.lit(op).alias("op"), "name") for op, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
