"""Registered queries: ranks, de-duplication, scaling."""

from pyspark.sql import functions as F

from essenta.operators import order as O
from essenta.operators import ranking as E
from essenta.plans.catalog import R, query, r, with_


@query("e1_average_rank", with_("sparse") + """
SELECT sample, gene, CAST(rank() OVER (PARTITION BY gene ORDER BY value) AS DOUBLE)
  + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rank FROM sparse""")
def _(t):
    return O.average_rank(t.sparse_expression(), ["gene"], "value").select("sample", "gene", "rank")


@query("e2_rank_first", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS up,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS down,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) + row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS total FROM part""")
def _(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size", (-F.col("p_size")).alias("neg"))
    up = O.position(rows, ["p_brand"], ["p_size", "p_partkey"], "up")
    both = O.position(up, ["p_brand"], ["neg", "p_partkey"], "down")
    return both.select("p_partkey", "up", "down", (F.col("up") + F.col("down")).alias("total"))


@query("e3_first_per_key", """
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def _(t):
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    return E.first_row(rows, ["p_brand"], -F.col("p_retailprice"), F.col("p_partkey"))


@query("e4_longest", """
SELECT p_brand AS symbol, p_partkey AS id, len FROM (SELECT p_brand, p_partkey, abs(p_size * 100 - p_retailprice) AS len,
  row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size * 100 - p_retailprice) DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("id"),
                         F.abs(F.col("p_size") * 100 - F.col("p_retailprice")).alias("len"))
    return E.first_row(rows, ["symbol"], -F.col("len"), F.col("id"))


@query("e5_once_only", "SELECT p_brand, p_name FROM part GROUP BY 1, 2 HAVING count(*) = 1")
def _(t):
    return E.once_only(t.part, ["p_brand", "p_name"])


@query("e6_distinct_values", """
SELECT l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_extendedprice
  ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    rows = t.lineitem.select("l_extendedprice", "l_orderkey", "l_linenumber")
    return E.first_row(rows, ["l_extendedprice"], F.col("l_orderkey"), F.col("l_linenumber"))


@query("e7_quartiles", """
SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 'Q1' WHEN o_totalprice <= q[2] THEN 'Q2' WHEN o_totalprice <= q[3] THEN 'Q3' ELSE 'Q4' END AS quartile,
  CASE WHEN o_totalprice <= s[1] THEN 'Q1' WHEN o_totalprice <= s[2] THEN 'Q2' WHEN o_totalprice <= s[3] THEN 'Q3' ELSE 'Q4' END AS in_status
FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
JOIN (SELECT o_orderstatus AS st, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS s FROM orders GROUP BY 1) ON st = o_orderstatus""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = E.quartiles(E.quartiles(rows, "o_totalprice"), "o_totalprice", ["o_orderstatus"], "in_status")
    return out.select("o_orderkey", "quartile", "in_status")


@query("e8_z_score", with_("expr") + f"""
SELECT sample, gene, {R('(value - avg(value) OVER g) / stddev_samp(value) OVER g')} AS z_sample,
  {R('(value - avg(value) OVER g) / stddev_pop(value) OVER g')} AS z_population FROM expr WINDOW g AS (PARTITION BY gene)""")
def _(t):
    out = E.z_score(E.z_score(t.expression(), ["gene"], out="a"), ["gene"], ddof=0, out="b")
    return out.select("sample", "gene", r("a").alias("z_sample"), r("b").alias("z_population"))


@query("e9_min_max", f"""
SELECT c_custkey, {R('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS scaled,
  {R('(c_acctbal - min(c_acctbal) OVER g) / (max(c_acctbal) OVER g - min(c_acctbal) OVER g)')} AS in_segment
FROM customer WINDOW g AS (PARTITION BY c_mktsegment)""")
def _(t):
    out = E.min_max(E.min_max(t.customer, "c_acctbal"), "c_acctbal", ["c_mktsegment"], "in_segment")
    return out.select("c_custkey", r("scaled").alias("scaled"), r("in_segment").alias("in_segment"))


@query("e10_robust_scale", f"""
SELECT event_id, {R('sign(z) * log10(1 + abs(z))')} AS scaled FROM (SELECT event_id, (value - m) / greatest(q3 - q1, 1e-8) AS z FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events))""")
def _(t):
    return E.robust_scale(t.events.select("event_id", "value"), "value").select("event_id", r("scaled").alias("scaled"))
