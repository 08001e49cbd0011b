"""Registered queries: aggregations and reshaping."""

from pyspark.sql import functions as F

from essenta.operators import aggregates as D
from essenta.plans.catalog import R, query, r, with_


@query("d1_group_mean", with_("lin") + f"SELECT lineage, {R('avg(c_acctbal)')} AS mean FROM lin GROUP BY 1")
def _(t):
    return D.group_mean(t.lineage(), ["lineage"], "c_acctbal").select("lineage", r("mean").alias("mean"))


@query("d2_duplicate_features", f"""
SELECT l_suppkey AS sample, p_brand AS gene, {R('avg(l_quantity)')} AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("gene"), "l_quantity")
    return D.group_mean(rows, ["sample", "gene"], "l_quantity", "value").withColumn("value", r("value"))


@query("d3_mean_sd_sem", f"""
SELECT o_orderpriority AS drug, {R('avg(o_totalprice)', 2)} AS mean, {R('stddev_samp(o_totalprice)', 2)} AS sd,
  {R('stddev_samp(o_totalprice) / sqrt(count(*))', 2)} AS sem, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    out = D.mean_sd_sem(t.orders.withColumnRenamed("o_orderpriority", "drug"), ["drug"], "o_totalprice")
    return out.select("drug", r("mean", 2).alias("mean"), r("sd", 2).alias("sd"), r("sem", 2).alias("sem"), "n")


@query("d4_group_median", f"""
SELECT l_returnflag AS plate, {R('quantile_cont(l_extendedprice, 0.5)')} AS median FROM lineitem GROUP BY 1""")
def _(t):
    from essenta.operators.order import median

    rows = t.lineitem.select(F.col("l_returnflag").alias("plate"), "l_extendedprice")
    return median(rows, ["plate"], "l_extendedprice").select("plate", r("median").alias("median"))


@query("d5_cross_table", """
SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(t):
    rows = t.orders.withColumnRenamed("o_orderpriority", "priority")
    return D.cross_table(rows, "priority", "o_orderstatus", D.levels_by_total(t.orders, "o_orderstatus"))


@query("d6_value_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("d7_name_lists", """
SELECT p_brand, CAST(0 AS BIGINT) AS part, string_agg(p_name, ',' ORDER BY p_name) AS names, count(*) AS n
FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1""")
def _(t):
    return D.name_lists(t.part, "p_brand", "p_name")


@query("d8_coverage", with_("ic50") + """
SELECT drug, CAST(floor((rn - 1) / 500) AS BIGINT) AS part, string_agg(sample, ',' ORDER BY sample) AS names, count(*) AS n FROM (
  SELECT drug, sample, row_number() OVER (PARTITION BY drug ORDER BY sample) AS rn FROM ic50
  WHERE sample IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)) GROUP BY 1, 2""")
def _(t):
    cohort = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("sample"))
    return D.coverage(t.ic50(), cohort, part_size=500)


@query("d9_group_profile", f"""
SELECT o_orderstatus AS cluster, {R('avg(l_quantity)')} AS response_a, {R('avg(l_discount)')} AS response_b,
  {R('avg(l_tax)')} AS score, count(*) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    from essenta.operators.scores import group_profile

    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("cluster"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"),
        F.col("l_tax").alias("s"))
    out = group_profile(rows, ["cluster"], "a", "b", "s")
    return out.select("cluster", *[r(c).alias(c) for c in ("response_a", "response_b", "score")], "size")


@query("d10_describe", f"""
SELECT event_type, count(value) AS count, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, min(value) AS min,
  {R('quantile_cont(value, 0.25)')} AS q25, {R('quantile_cont(value, 0.5)')} AS q50, {R('quantile_cont(value, 0.75)')} AS q75,
  max(value) AS max FROM events GROUP BY 1""")
def _(t):
    out = D.describe(t.events.select("event_type", "value"), ["event_type"], "value")
    return out.select("event_type", "count", "min", "max", *[r(c).alias(c) for c in ("mean", "sd", "q25", "q50", "q75")])


@query("d11_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("d12_wide", with_("lin", "x AS (SELECT c_mktsegment, lineage, max(c_acctbal) AS v FROM lin GROUP BY 1, 2)") + """
SELECT c_mktsegment AS drug, max(v) FILTER (lineage = 'AFRICA') AS "AFRICA", max(v) FILTER (lineage = 'AMERICA') AS "AMERICA",
  max(v) FILTER (lineage = 'ASIA') AS "ASIA", max(v) FILTER (lineage = 'EUROPE') AS "EUROPE",
  max(v) FILTER (lineage = 'MIDDLE EAST') AS "MIDDLE EAST" FROM x GROUP BY 1""")
def _(t):
    rows = t.lineage().groupBy(F.col("c_mktsegment").alias("drug"), "lineage").agg(F.max("c_acctbal").alias("v"))
    return D.wide(rows, "drug", "lineage", "v", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("d13_melt", """
SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS timepoint, l_quantity AS value FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""")
def _(t):
    return D.melt(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], "timepoint", "value")


@query("d14_fold_mean", f"""
SELECT l_orderkey AS sample, {R('(sum(l_quantity) + sum(l_discount) + sum(l_tax)) / (3 * count(*))')} AS prediction FROM lineitem GROUP BY 1""")
def _(t):
    long = D.melt(t.lineitem, ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "fold", "prediction")
    return D.group_mean(long, ["l_orderkey"], "prediction", "prediction").select(
        F.col("l_orderkey").alias("sample"), r("prediction").alias("prediction"))
