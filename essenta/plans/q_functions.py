"""Registered queries: scalar functions."""

from pyspark.sql import functions as F

from essenta.functions import columns as C
from essenta.plans.catalog import R, query, r


@query("g1_text", """
SELECT c_custkey, upper(c_name) AS up, trim('  ' || c_mktsegment || ' ') AS tr, split_part(c_name, '#', 1) AS sp,
  starts_with(c_mktsegment, 'B') AS pre, regexp_matches(c_name, '[13579]$') AS odd, replace(c_name, '#', '_') AS rep,
  concat_ws('|', c_mktsegment, c_nationkey) AS cat FROM customer""")
def _(t):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.upper(name).alias("up"), F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("tr"),
        F.get(F.split(name, "#"), F.lit(0)).alias("sp"), seg.startswith("B").alias("pre"), name.rlike("[13579]$").alias("odd"),
        F.replace(name, F.lit("#"), F.lit("_")).alias("rep"), F.concat_ws("|", seg, "c_nationkey").alias("cat"))


@query("g2_numeric", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {R('log10(l_extendedprice)')} AS l10, {R('ln(1 + l_quantity)')} AS l1p,
  {R('log2(l_quantity)')} AS l2, CAST(sign(l_discount - 0.05) AS INTEGER) AS sg, {R('abs(l_discount - 0.05)')} AS ab, {R('sqrt(l_quantity)')} AS sq,
  {R('power(l_tax + 1, 3)')} AS pw, round(l_extendedprice / 7, 3) AS rd, CAST(floor(l_extendedprice) AS BIGINT) AS fl,
  CAST(ceil(l_extendedprice) AS BIGINT) AS ce FROM lineitem""")
def _(t):
    q, e, d, x = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", r(F.log10(e)).alias("l10"), r(F.log1p(q)).alias("l1p"), r(F.log2(q)).alias("l2"),
        F.signum(d - 0.05).cast("int").alias("sg"), r(F.abs(d - 0.05)).alias("ab"), r(F.sqrt(q)).alias("sq"), r(F.pow(x + 1, 3)).alias("pw"),
        F.round(e / 7, 3).alias("rd"), F.floor(e).alias("fl"), F.ceil(e).alias("ce"))


@query("g3_arrays", """
SELECT p_partkey, w AS word, len(ws) AS n, array_to_string(ws, '+') AS joined FROM (
  SELECT p_partkey, string_split(p_name, ' ') AS ws, unnest(string_split(p_name, ' ')) AS w FROM part)""")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.explode(words).alias("word"), F.size(words).cast("long").alias("n"),
                         F.array_join(words, "+").alias("joined"))


@query("g4_stars", """
SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars
FROM (SELECT event_id, value / 1000 AS p FROM events)""")
def _(t):
    return t.events.select("event_id", C.stars(F.col("value") / 1000).alias("stars"))


@query("g5_pseudo_counts", """
SELECT p_partkey, reads, round(p_retailprice * (p_size + 1) / reads) AS counts FROM part, (SELECT unnest([20, 30, 40, 50]) AS reads)""")
def _(t):
    # Depth divisors.
    reads = F.explode(F.array(*[F.lit(x) for x in (20, 30, 40, 50)])).alias("reads")
    return t.part.select("p_partkey", "p_retailprice", "p_size", reads).select(
        "p_partkey", "reads", C.pseudo_counts(F.col("p_retailprice"), F.col("p_size") + 1, F.col("reads")).alias("counts"))


@query("g6_residual", f"""
SELECT o_orderkey, {R('o_totalprice - m', 2)} AS residual FROM orders JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON p = o_orderpriority""")
def _(t):
    fit = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    return t.orders.join(fit, "o_orderpriority").select(
        "o_orderkey", r(F.col("o_totalprice") - F.col("prediction"), 2).alias("residual"))
