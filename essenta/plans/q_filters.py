"""Registered queries: projections, filters, predicates."""

from pyspark.sql import functions as F

from essenta.functions import columns as C
from essenta.operators import filters as B
from essenta.plans.catalog import R, query, r, with_

# Built sample ids, control for half of the flags, treated otherwise.
_ID = """CASE WHEN l_returnflag = 'N' THEN concat('DMSO_Plate_', l_linenumber, '_CVCL_', l_suppkey)
  WHEN l_returnflag = 'A' THEN concat('Erlotinib_', CASE WHEN l_linenumber <= 2 THEN '0.05' WHEN l_linenumber <= 4 THEN '0.5'
       WHEN l_linenumber <= 6 THEN '5' ELSE '50' END, '_CVCL_', l_suppkey) ELSE 'other' END"""


def sample_ids(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_ID).alias("id"))


@query("b1_response", with_("ic50") + "SELECT sample, value FROM ic50 WHERE drug = '2-HIGH'")
def _(t):
    return B.response(t.ic50(), "drug", "2-HIGH").select("sample", "value")


@query("b1_complete_cases", with_("ic50") + """
SELECT drug, sample, value FROM ic50 WHERE drug IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND sample IN (
  SELECT sample FROM ic50 WHERE drug IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY sample HAVING count(DISTINCT drug) = 3)""")
def _(t):
    return B.complete_cases(t.ic50(), "drug", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("drug", "sample", "value")


@query("b2_validate", with_("ic50", """
dep AS (SELECT c_mktsegment AS gene, CAST(c_custkey AS VARCHAR) AS sample FROM customer WHERE c_acctbal > 0)""", """
pairs AS (SELECT DISTINCT o_orderpriority AS drug, c_mktsegment AS target FROM orders, (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT 'none', 'BUILDING' UNION ALL SELECT '2-HIGH', 'none')""", """
common AS (SELECT i.drug, d.gene AS target, count(*) AS c FROM ic50 i JOIN dep d USING (sample) GROUP BY 1, 2)""") + """
SELECT p.drug, p.target, CAST(coalesce(c, 0) AS BIGINT) AS n_samples,
  CASE WHEN p.drug NOT IN (SELECT drug FROM ic50) THEN 'unknown drug'
       WHEN p.target NOT IN (SELECT gene FROM dep) THEN 'unknown target'
       WHEN coalesce(c, 0) = 0 THEN 'no common sample' WHEN c < 200 THEN 'few samples' ELSE 'ok' END AS status
FROM pairs p LEFT JOIN common USING (drug, target)""")
def _(t):
    dep = t.customer.where("c_acctbal > 0").select(
        F.col("c_mktsegment").alias("gene"), F.col("c_custkey").cast("string").alias("sample"))
    segments = F.explode(F.array(*[F.lit(s) for s in (
        "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])).alias("target")
    pairs = t.orders.select(F.col("o_orderpriority").alias("drug")).distinct().select("drug", segments)
    extra = t.spark.sql("SELECT 'none' AS drug, 'BUILDING' AS target UNION ALL SELECT '2-HIGH', 'none'")
    return B.validate_pairs(pairs.unionByName(extra), dep, t.ic50(), dep)


@query("b3_clean_names", """
SELECT c_custkey, regexp_replace(c_name || ' (' || c_custkey || ')', ' \\(.*\\)$', '') AS name,
       replace(p, '-', '') AS key FROM (SELECT c_custkey, c_name, c_mktsegment || '-' || c_nationkey AS p FROM customer)""")
def _(t):
    return t.customer.select(
        "c_custkey", C.strip_suffix(F.expr("concat(c_name, ' (', c_custkey, ')')")).alias("name"),
        C.strip_hyphens(F.concat_ws("-", "c_mktsegment", "c_nationkey")).alias("key"))


@query("b4_rename_map", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ECON' WHEN 'SMALL' THEN 'SM' ELSE p_type END AS type FROM part""")
def _(t):
    return t.part.select("p_partkey", C.rename_by(F.col("p_type"), {"ECONOMY": "ECON", "SMALL": "SM"}).alias("type"))


@query("b5_resolve_alias", """
WITH feat AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_size <= 30),
al AS (SELECT p_brand AS target, p_name AS alias FROM part UNION ALL
       SELECT p_name, p_name || '_old' FROM part WHERE p_size > 40),
wanted AS (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT p_name FROM part),
missing AS (SELECT gene FROM wanted WHERE gene NOT IN (SELECT gene FROM feat))
SELECT alias AS gene, min(target) AS target FROM al
WHERE target IN (SELECT gene FROM missing) AND alias IN (SELECT gene FROM feat) GROUP BY 1""")
def _(t):
    feat = t.part.where("p_size <= 30").select(F.col("p_name").alias("gene"))
    al = t.part.select(F.col("p_brand").alias("target"), F.col("p_name").alias("alias")).unionByName(
        t.part.where("p_size > 40").select(F.col("p_name").alias("target"), F.concat("p_name", F.lit("_old")).alias("alias")))
    wanted = t.part.select(F.col("p_brand").alias("gene")).union(t.part.select("p_name"))
    return B.resolve_alias(feat, al, wanted)


@query("b6_parse_ids", f"""
WITH ids AS (SELECT l_orderkey, l_linenumber, {_ID} AS id FROM lineitem),
p AS (SELECT *, regexp_extract(id, 'DMSO_Plate_(\\d+)_(CVCL_[A-Za-z0-9]+)', 1) AS cp,
  regexp_extract(id, 'DMSO_Plate_(\\d+)_(CVCL_[A-Za-z0-9]+)', 2) AS cl,
  regexp_extract(id, 'Erlotinib_([0-9.]+)_(CVCL_[A-Za-z0-9]+)', 1) AS tc,
  regexp_extract(id, 'Erlotinib_([0-9.]+)_(CVCL_[A-Za-z0-9]+)', 2) AS tl FROM ids)
SELECT l_orderkey, l_linenumber, CASE WHEN cp <> '' THEN 'DMSO' WHEN tc <> '' THEN 'Erlotinib' ELSE 'Unknown' END AS treatment,
  CASE WHEN cp <> '' THEN 'Plate_' || cp WHEN tc = '0.05' THEN 'Plate_7' WHEN tc = '0.5' THEN 'Plate_8'
       WHEN tc = '5' THEN 'Plate_9' ELSE 'Unknown' END AS plate,
  CASE WHEN cp <> '' THEN 0.0::DOUBLE WHEN tc <> '' THEN CAST(tc AS DOUBLE) END AS conc,
  CASE WHEN cp <> '' THEN cl WHEN tc <> '' THEN tl ELSE 'Unknown' END AS cell_line FROM p""")
def _(t):
    parsed = C.parse_sample_id(F.col("id"))
    return sample_ids(t).select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in parsed.items()])


@query("b7_plate_of_concentration", """
SELECT p_partkey, CASE s WHEN '0.05' THEN 'Plate_7' WHEN '0.5' THEN 'Plate_8' WHEN '5' THEN 'Plate_9' ELSE 'Unknown' END AS plate
FROM (SELECT p_partkey, CASE WHEN p_size <= 10 THEN '0.05' WHEN p_size <= 20 THEN '0.5' ELSE CAST(p_size AS VARCHAR) END AS s FROM part)""")
def _(t):
    conc = F.when(F.col("p_size") <= 10, "0.05").when(F.col("p_size") <= 20, "0.5").otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", C.plate_of(conc).alias("plate"))


@query("b8_regulation_class", """
SELECT event_id, CASE WHEN p < 0.05 AND fc > 1 THEN 'upregulated' WHEN p < 0.05 AND fc < -1 THEN 'downregulated'
  ELSE 'nonsignificant' END AS three_way,
  CASE WHEN p < 0.05 AND fc > 1 THEN 'upregulated' WHEN p < 0.05 THEN 'downregulated' ELSE 'nonsignificant' END AS two_way
FROM (SELECT event_id, value / 10 - 2 AS fc, value / 1000 AS p FROM events)""")
def _(t):
    fc, p = F.col("value") / 10 - 2, F.col("value") / 1000
    return t.events.select(
        "event_id", C.regulation_class(fc, p).alias("three_way"),
        C.regulation_class(fc, p, two_way=True).alias("two_way"))


@query("b9_response_class", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN b < -95 AND a < -40 THEN 'mCR' WHEN b < -50 AND a < -20 THEN 'mPR'
  WHEN b < 35 AND a < 30 THEN 'mSD' ELSE 'mPD' END AS response
FROM (SELECT *, l_quantity * 4 - 120 AS b, l_quantity * 2 - 50 + l_tax * 100 AS a FROM lineitem)""")
def _(t):
    best = F.col("l_quantity") * 4 - 120
    average = F.col("l_quantity") * 2 - 50 + F.col("l_tax") * 100
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        C.response_class(best, average).alias("response"))


@query("b10_membership", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'feature_list' WHEN p_type = 'SMALL' THEN 'pathway'
  WHEN p_retailprice > 1500 THEN 'DEG_up' WHEN p_retailprice < 1000 THEN 'DEG_down'
  WHEN p_name <> 'red widget' THEN 'non_significant' ELSE 'no_member' END AS membership FROM part""")
def _(t):
    reg = (F.when(F.col("p_retailprice") > 1500, "upregulated").when(F.col("p_retailprice") < 1000, "downregulated")
           .when(F.col("p_name") != "red widget", "nonsignificant"))
    return t.part.select("p_partkey", C.membership(
        C.yes_no(F.col("p_size") > 40), C.yes_no(F.col("p_type") == "SMALL"), reg).alias("membership"))


@query("b11_threshold", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, CASE WHEN l_discount >= 0.06 THEN 'high' ELSE 'low' END AS grp FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount",
                             C.high_low(F.col("l_discount"), 0.06).alias("grp"))


@query("b12_median_split", """
SELECT o_orderkey, CASE WHEN o_totalprice > m THEN 'high' ELSE 'low' END AS strict_group,
       CASE WHEN o_totalprice >= m2 THEN 'high' ELSE 'low' END AS status_group
FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders)
JOIN (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.5) AS m2 FROM orders GROUP BY 1) ON s = o_orderstatus""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = B.median_split(rows, "o_totalprice", strict=True, out="strict_group")
    return B.median_split(out, "o_totalprice", ["o_orderstatus"], out="status_group").select(
        "o_orderkey", "strict_group", "status_group")


@query("b13_flags", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'yes' ELSE 'no' END AS urgent,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'keyCluster' ELSE 'others' END AS cluster FROM customer""")
def _(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("u")).distinct()
    return t.customer.join(urgent, "c_custkey", "left").select(
        "c_custkey", C.yes_no(F.coalesce("u", F.lit(False))).alias("urgent"),
        F.when(F.col("c_mktsegment") == "BUILDING", "keyCluster").otherwise("others").alias("cluster"))


@query("b14_coerce", """
SELECT event_id, v FROM (SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)
WHERE v IS NOT NULL""")
def _(t):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", text.try_cast("double").alias("v")).where(F.col("v").isNotNull())


@query("b15_clip", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {R('least(greatest(l_extendedprice, lo), hi)', 4)} AS clipped FROM lineitem,
  (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return B.clip_quantiles(rows, "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", r("clipped", 4).alias("clipped"))


@query("b16_minimum_filter", with_("sparse", """
c AS (SELECT sample FROM sparse WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT gene) >= 90)""", """
kept AS (SELECT * FROM sparse WHERE sample IN (SELECT sample FROM c))""") + """
SELECT sample, gene, value AS count FROM kept WHERE gene IN (
  SELECT gene FROM kept WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT sample) >= 50)""")
def _(t):
    rows = t.sparse_expression().withColumnRenamed("value", "count")
    return B.keep_filled(B.keep_filled(rows, "sample", 90, "gene"), "gene", 50, "sample")


@query("b17_metadata_filter", """
SELECT DISTINCT l_suppkey AS barcode, l_returnflag AS plate FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 45""")
def _(t):
    return t.lineitem.where((F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 45)).select(
        F.col("l_suppkey").alias("barcode"), F.col("l_returnflag").alias("plate")).distinct()
