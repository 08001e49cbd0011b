"""Registered queries: joins."""

from pyspark.sql import functions as F

from essenta.operators import joins as J
from essenta.operators.aggregates import name_lists
from essenta.plans.catalog import SEEDS, R, query, r, with_


@query("c1_align", with_("ic50", """
dep AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, c_acctbal AS value FROM customer WHERE c_acctbal > 0)""", """
i AS (SELECT sample, value FROM ic50 WHERE drug = '5-LOW')""") + """
SELECT d.sample, d.value AS dep, i.value AS ic50 FROM dep d JOIN i USING (sample)
WHERE d.sample IN (SELECT sample FROM ic50 WHERE drug = '1-URGENT')""")
def _(t):
    ic50 = t.ic50()
    expr = ic50.where("drug = '1-URGENT'").select("sample", "value")
    dep = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_acctbal").alias("dep"))
    low = ic50.where("drug = '5-LOW'").select("sample", F.col("value").alias("ic50"))
    _, dep, low = J.align(expr, dep, low)
    return dep.join(low, "sample")


@query("c2_lookup", """
SELECT c_custkey, n_name AS nation, coalesce(r_name, 'Unknown') AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey""")
def _(t):
    regions = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("lineage"))
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    rows = t.customer.select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
    return J.lookup(rows, regions, "n_regionkey", {"lineage": "Unknown"}).select("c_custkey", "nation", "lineage")


@query("c3_inner_merge", """
SELECT c_custkey, c_acctbal, n, top FROM customer JOIN (
  SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return t.customer.select("c_custkey", "c_acctbal").join(per, "c_custkey")


@query("c4_outer_merge", """
SELECT coalesce(a.k, b.k) AS nation, s, c FROM
 (SELECT s_nationkey AS k, count(*) AS s FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) a FULL JOIN
 (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k""")
def _(t):
    s = t.supplier.where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    return s.join(c, "nation", "full")


@query("c5_shared", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(t):
    wanted = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_brand").join(wanted, "p_partkey", "left_semi")


@query("c6_missing", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(t):
    wanted = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_brand").join(wanted, "p_partkey", "left_anti")


@query("c7_drugs_of_target", with_("dt") + """
SELECT target, drug FROM dt WHERE drug IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_tax = 0.08 AND l_quantity = 50)""")
def _(t):
    lists = name_lists(t.drug_targets(), "drug", "target").select("drug", F.col("names").alias("targets"))
    tested = t.lineitem.where("l_tax = 0.08 AND l_quantity = 50").join(
        t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("drug"))
    return J.drugs_of_target(J.explode_targets(lists), tested).select("target", "drug")


@query("c8_pair_grid", with_("dt") + f"""
SELECT drug, target, CAST(seed AS INTEGER) AS seed FROM dt, (SELECT unnest({SEEDS}) AS seed)
WHERE target IN (SELECT p_type FROM part WHERE p_size < 10) AND target IN (SELECT p_type FROM part WHERE p_retailprice > 990)""")
def _(t):
    dep = t.part.where("p_size < 10").select(F.col("p_type").alias("gene"))
    expr = t.part.where("p_retailprice > 990").select(F.col("p_type").alias("gene"))
    return J.pair_grid(t.drug_targets(), dep, expr, SEEDS)


@query("c9_match_models", with_("dt") + f"""
SELECT drug, target, seed, coalesce(single_id, 'default_' || target) AS single_id FROM
 (SELECT drug, target, CAST(seed AS INTEGER) AS seed FROM dt, (SELECT unnest({SEEDS}) AS seed)) LEFT JOIN
 (SELECT p_brand AS drug, p_type AS target, 42 AS seed, 'm' || max(p_partkey) AS single_id FROM part WHERE p_size > 25 GROUP BY 1, 2)
 USING (drug, target, seed)""")
def _(t):
    joint = t.drug_targets().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    single = t.part.where("p_size > 25").groupBy(F.col("p_brand").alias("drug"), F.col("p_type").alias("target")).agg(
        F.concat(F.lit("m"), F.max("p_partkey")).alias("single_id")).withColumn("seed", F.lit(42))
    return J.match_models(joint, single, ["drug", "target", "seed"], F.concat(F.lit("default_"), "target"))


@query("c10_product", with_("sparse", """
w AS (SELECT p_brand || '-' || p_type AS gene, CAST(sum(p_size) AS DOUBLE) / count(*) AS weight FROM part GROUP BY 1)""") + f"""
SELECT sample, {R('sum(value * weight)')} AS score FROM sparse JOIN w USING (gene) GROUP BY 1""")
def _(t):
    w = t.part.groupBy(F.concat_ws("-", "p_brand", "p_type").alias("gene")).agg(
        (F.sum("p_size").cast("double") / F.count(F.lit(1))).alias("weight"))
    return J.product(t.sparse_expression(), w, ["sample"]).select("sample", r("score").alias("score"))
