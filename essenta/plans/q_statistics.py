"""Registered queries: statistics, normalisation and linear models."""

from pyspark.sql import functions as F

from essenta.operators import linear_models as L
from essenta.operators import normalise as N
from essenta.operators import statistics as H
from essenta.operators.aggregates import mean_sd_sem
from essenta.operators.ranking import quartiles
from essenta.operators.topk import top_features
from essenta.plans import sqltext as S
from essenta.plans.catalog import R, query, r, with_
from essenta.plans.q_topk import RHO

# Ranks within each drug's own samples, for responses with gaps.
GAPS = """
b AS (SELECT i.drug, e.gene, e.value AS x, i.value AS y FROM expr e JOIN ic50 i USING (sample)),
rk AS (SELECT drug, gene, rank() OVER gx + (count(*) OVER (PARTITION BY drug, gene, x) - 1) / 2.0 AS rx,
       rank() OVER gy + (count(*) OVER (PARTITION BY drug, gene, y) - 1) / 2.0 AS ry FROM b
       WINDOW gx AS (PARTITION BY drug, gene ORDER BY x), gy AS (PARTITION BY drug, gene ORDER BY y)),
rho AS (SELECT drug, gene, corr(rx, ry) AS rho, count(*) AS n FROM rk GROUP BY 1, 2)"""


def order_status(t):
    return t.orders.select(F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("drug"), "o_totalprice")


@query("h1_spearman", with_("expr resp", RHO) + f"SELECT response, gene, {R('rho')} AS rho FROM rho")
def _(t):
    return H.spearman(t.expression(), t.responses(), aligned=True).select("response", "gene", r("rho").alias("rho"))


@query("h2_spearman_gaps", with_("expr ic50", GAPS) + f"SELECT drug, gene, {R('rho')} AS rho, n FROM rho")
def _(t):
    constant = t.expression().select("sample").distinct().select("sample", F.lit("flat").alias("gene"), F.lit(1.0).alias("value"))
    out = H.spearman(t.expression().unionByName(constant), t.ic50(), ["drug"], ["drug"], drop_constant=True)
    return out.select("drug", "gene", r("rho").alias("rho"), "n")


@query("h3_feature_lists", with_("expr ic50", GAPS, """
dt3 AS (SELECT DISTINCT o_orderpriority AS drug, unnest(['f' || left(o_orderpriority, 1), 'f' || length(o_orderpriority)]) AS target FROM orders)""", """
d AS (SELECT sample, gene AS target, value AS y FROM expr WHERE gene IN (SELECT target FROM dt3))""", """
dr AS (SELECT target, gene, corr(rx, ry) AS rho FROM (SELECT target, gene, rank() OVER (PARTITION BY target, gene ORDER BY value) AS rx,
   rank() OVER (PARTITION BY target, gene ORDER BY y) AS ry FROM expr JOIN d USING (sample)) GROUP BY 1, 2)""", """
top AS (SELECT drug, gene FROM (SELECT drug, gene, row_number() OVER (PARTITION BY drug ORDER BY abs(rho) DESC, gene) AS k FROM rho) WHERE k <= 5
  UNION SELECT drug, gene FROM dt3 JOIN (SELECT target, gene, row_number() OVER (PARTITION BY target ORDER BY abs(rho) DESC, gene) AS k FROM dr) USING (target) WHERE k <= 5
  UNION SELECT drug, target FROM dt3)""") + """
SELECT drug, CAST(0 AS BIGINT) AS part, string_agg(gene, ',' ORDER BY gene) AS names, count(*) AS n FROM top
WHERE drug IN (SELECT drug FROM ic50 GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1""")
def _(t):
    from essenta.plans.features import feature_lists

    expr = t.expression()
    targets = t.orders.select(F.col("o_orderpriority").alias("drug")).distinct().select(
        "drug", F.concat(F.lit("f"), F.left("drug", F.lit(1)), F.lit(",f"), F.length("drug")).alias("targets"))
    return feature_lists(expr, expr, targets, t.ic50(), k=5)


def _h4(x, y, table, key):
    return f"""
WITH rk AS (SELECT {key} AS k, {x} AS x, {y} AS y, rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {key} ORDER BY {y}) + (count(*) OVER (PARTITION BY {key}, {y}) - 1) / 2.0 AS ry FROM {table}),
c AS (SELECT k, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM rk GROUP BY 1),
tt AS (SELECT *, pearson * sqrt((n - 2) / (1 - pearson * pearson)) AS tp, spearman * sqrt((n - 2) / (1 - spearman * spearman)) AS ts FROM c)
SELECT k AS {key}, n, {R('pearson')} AS pearson, {R('spearman')} AS spearman, {R(S.t_two_sided('tp', 'n - 2'))} AS pearson_p,
  {R(S.t_two_sided('ts', 'n - 2'))} AS spearman_p FROM tt"""


@query("h4_correlation_test", _h4("value", "user_id", "events", "event_type"))
def _(t):
    out = H.correlation_test(t.events.select("event_type", "value", "user_id"), ["event_type"], "value", "user_id")
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("pearson", "spearman", "pearson_p", "spearman_p")])


_PAIRS = """
WITH c AS (SELECT event_type, value, user_id, count(*) AS c FROM events GROUP BY 1, 2, 3),
s AS (SELECT a.event_type, sum(CASE WHEN (a.value - b.value) * (a.user_id - b.user_id) > 0 THEN a.c * b.c ELSE 0 END) / 2.0 AS con,
   sum(CASE WHEN (a.value - b.value) * (a.user_id - b.user_id) < 0 THEN a.c * b.c ELSE 0 END) / 2.0 AS dis,
   sum(CASE WHEN a.value = b.value AND a.user_id <> b.user_id THEN a.c * b.c ELSE 0 END) / 2.0 AS half,
   sum(CASE WHEN a.user_id <> b.user_id THEN a.c * b.c ELSE 0 END) / 2.0 AS comp,
   sum(CASE WHEN a.value <> b.value THEN a.c * b.c ELSE 0 END) / 2.0 AS xdiff
   FROM c a JOIN c b ON a.event_type = b.event_type GROUP BY 1),
n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""


@query("h5_kendall", _PAIRS + f"SELECT event_type, n, {R('(con - dis) / sqrt(xdiff * comp)')} AS tau FROM s JOIN n USING (event_type)")
def _(t):
    return H.kendall(t.events, ["event_type"], "value", "user_id").select("event_type", "n", r("tau").alias("tau"))


@query("h6_concordance", _PAIRS + f"""
SELECT event_type, n, {R('(con + half / 2) / comp')} AS c_index, {R('((con - dis) / sqrt(xdiff * comp) + 1) / 2')} AS from_tau FROM s JOIN n USING (event_type)""")
def _(t):
    out = H.concordance_index(t.events, ["event_type"], "user_id", "value")
    return out.select("event_type", "n", r("c_index").alias("c_index"), r("from_tau").alias("from_tau"))


@query("h7_regression_metrics", f"""
SELECT l_returnflag AS plate, count(*) AS n, {R('avg((p - y) * (p - y))')} AS mse, {R('avg(abs(p - y))')} AS mae, {R('sqrt(avg((p - y) * (p - y)))')} AS rmse,
  {R('1 - avg((p - y) * (p - y)) / var_pop(y)')} AS r2, {R('regr_slope(y, p)')} AS slope, {R('regr_intercept(y, p)')} AS intercept, {R('regr_r2(y, p)')} AS line_r2
FROM (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem) GROUP BY 1""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("plate"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1500).alias("p"))
    out = H.regression_metrics(rows, ["plate"], "y", "p")
    return out.select("plate", "n", *[r(c).alias(c) for c in ("mse", "mae", "rmse", "r2", "slope", "intercept", "line_r2")])


def _u(rows, z="greatest(u, n1 * n2 - u)", sides=2):
    """U test in SQL from rows ``(k, a, v)``; ``a`` marks the first group."""
    return f"""
WITH src AS ({rows}), rk AS (SELECT k, a, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rk FROM src),
ti AS (SELECT k, sum(c * c * c - c) AS t FROM (SELECT k, CAST(count(*) AS DOUBLE) AS c FROM src GROUP BY k, v) GROUP BY 1),
s AS (SELECT k, CAST(count(*) FILTER (a) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS n2, sum(rk) FILTER (a) AS r1 FROM rk GROUP BY 1),
us AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s JOIN ti USING (k)),
zs AS (SELECT *, ({z} - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM us)
SELECT k, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {R('u', 1)} AS u, {R('z')} AS z,
  {R(f'least(1.0, {sides} * {S.normal_sf("z")})')} AS p, {R('1 - 2 * u / (n1 * n2)')} AS effect FROM zs"""


def _u_out(df, *names):
    return df.select(*names, "n1", "n2", r("u", 1).alias("u"), *[r(c).alias(c) for c in ("z", "p", "effect")])


@query("h8_mann_whitney", _u("SELECT o_orderpriority AS k, o_orderstatus = 'F' AS a, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'"))
def _(t):
    return _u_out(H.mann_whitney(order_status(t), ["drug"], "grp", "o_totalprice", "F", "O").withColumnRenamed("drug", "k"), "k")


@query("h8_one_sided", _u("SELECT c_mktsegment AS k, c_nationkey < 12 AS a, round(c_acctbal / 100) AS v FROM customer", "(n1 * n2 - u)", 1))
def _(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("k"), F.when(F.col("c_nationkey") < 12, "a").otherwise("b").alias("g"),
                             F.round(F.col("c_acctbal") / 100).alias("v"))
    return _u_out(H.mann_whitney(rows, ["k"], "g", "v", "a", "b", "less"), "k")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("h9_group_matrix", _u("""
SELECT a.p || '|' || b.p AS k, o_orderpriority = a.p AS a, o_totalprice AS v FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) a
JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) b ON a.p <> b.p JOIN orders ON o_orderpriority IN (a.p, b.p)"""))
def _(t):
    pairs = [(a, b) for a in _PRIORITIES for b in _PRIORITIES if a != b]
    out = H.group_test_matrix(order_status(t), "drug", "o_totalprice", pairs)
    return _u_out(out.withColumn("k", F.concat_ws("|", "ref", "test")), "k")


@query("h10_adjacent_quartiles", _u("""
WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders),
l AS (SELECT CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2 WHEN o_totalprice <= q[3] THEN 3 ELSE 4 END AS g, o_custkey AS v FROM orders, e)
SELECT 'Q' || p || '|Q' || (p + 1) AS k, g = p AS a, v FROM (SELECT unnest([1, 2, 3]) AS p) JOIN l ON g IN (p, p + 1)"""))
def _(t):
    rows = quartiles(t.orders.select("o_totalprice", "o_custkey"), "o_totalprice")
    out = H.adjacent_quartiles(rows, "quartile", "o_custkey")
    return _u_out(out.withColumn("k", F.concat_ws("|", "ref", "test")), "k")


@query("h11_bh", f"""
WITH p AS (SELECT event_type, event_id, value / (value + 1000) AS p FROM events),
k AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / (rank() OVER (PARTITION BY event_type ORDER BY p) + count(*) OVER (PARTITION BY event_type, p) - 1) AS raw FROM p)
SELECT event_id, {R('least(1.0, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS p_adj FROM k""")
def _(t):
    rows = t.events.select("event_type", "event_id", (F.col("value") / (F.col("value") + 1000)).alias("p"))
    return H.adjust_bh(rows, ["event_type"]).select("event_id", r("p_adj").alias("p_adj"))


_LEVENE = """
m AS (SELECT k, g, quantile_cont(v, 0.5) AS med FROM src GROUP BY 1, 2),
d AS (SELECT k, g, abs(v - med) AS d FROM src JOIN m USING (k, g)),
pg AS (SELECT k, g, CAST(count(*) AS DOUBLE) AS n, avg(d) AS m, var_pop(d) * count(*) AS w FROM d GROUP BY 1, 2),
gm AS (SELECT k, avg(d) AS gm FROM d GROUP BY 1),
lf AS (SELECT k, count(*) - 1 AS d1, sum(n) - count(*) AS d2, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f
  FROM pg JOIN gm USING (k) GROUP BY 1)"""


@query("h12_levene", f"""
WITH src AS (SELECT l_returnflag AS k, l_linestatus AS g, l_extendedprice AS v FROM lineitem), {_LEVENE}
SELECT k, {R('f')} AS f, {R(S.f_sf('f', 'd1', 'd2'))} AS p FROM lf""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("v"))
    return H.levene(rows, ["k"], "g", "v").select("k", r("f").alias("f"), r("p").alias("p"))


@query("h13_t_test", f"""
WITH src AS (SELECT event_type AS k, CASE WHEN user_id < 40 THEN 'high' ELSE 'low' END AS g, value AS v FROM events), {_LEVENE},
s AS (SELECT k, CAST(count(*) FILTER (g = 'high') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'low') AS DOUBLE) AS n2, avg(v) FILTER (g = 'high') AS m1,
  avg(v) FILTER (g = 'low') AS m2, var_samp(v) FILTER (g = 'high') AS v1, var_samp(v) FILTER (g = 'low') AS v2 FROM src GROUP BY 1),
q AS (SELECT *, {S.f_sf('f', 'd1', 'd2')} AS lp FROM s JOIN lf USING (k)),
tt AS (SELECT k, n1, n2, lp, CASE WHEN lp > 0.05 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) ELSE (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t,
  CASE WHEN lp > 0.05 THEN n1 + n2 - 2 ELSE (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) END AS dof FROM q)
SELECT k, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {R('t')} AS t, {R('dof', 3)} AS dof, {R('1 - ' + S.t_sf('t', 'dof'))} AS p, {R('lp')} AS levene_p FROM tt""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("k"), F.when(F.col("user_id") < 40, "high").otherwise("low").alias("g"), F.col("value").alias("v"))
    out = H.t_test(rows, ["k"], "g", "v", "high", "low", "less")
    return out.select("k", "n1", "n2", r("t").alias("t"), r("dof", 3).alias("dof"), r("p").alias("p"), r("levene_p").alias("levene_p"))


@query("h14_paired_t", f"""
WITH s AS (SELECT l_returnflag AS k, count(*) AS n, avg(0.8 * l_discount - l_tax) AS m, stddev_samp(0.8 * l_discount - l_tax) AS s FROM lineitem GROUP BY 1),
t AS (SELECT k, n, m / (s / sqrt(n)) AS t FROM s)
SELECT k, n, {R('t', 5)} AS t, {R(S.t_two_sided('t', 'n - 1'))} AS p FROM t""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("k"), (F.col("l_discount") * 0.8).alias("x"), "l_tax")
    return H.paired_t(rows, ["k"], "x", "l_tax").select("k", "n", r("t", 5).alias("t"), r("p").alias("p"))


def _chi(rows, cols):
    return f"""
WITH c AS (SELECT {rows} AS a, {cols} AS b, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c),
x AS (SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k, sum((o - e) * (o - e) / e) AS plain, sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) AS yates FROM e),
y AS (SELECT *, (r - 1) * (k - 1) AS dof, CASE WHEN (r - 1) * (k - 1) = 1 THEN yates ELSE plain END AS chi2 FROM x),
z AS (SELECT *, greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS ph, r - (r - 1) ** 2 / (n - 1) AS r2, k - (k - 1) ** 2 / (n - 1) AS k2 FROM y)
SELECT CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, {R('chi2')} AS chi2, {R(S.chi2_sf('chi2', 'dof'))} AS p,
  {R('sqrt(chi2 / n / (least(r, k) - 1))')} AS v, {R('sqrt(ph / least(k2 - 1, r2 - 1))')} AS v_corrected FROM z"""


def _chi_out(df):
    return df.select("n", "dof", *[r(c).alias(c) for c in ("chi2", "p", "v", "v_corrected")])


@query("h15_chi_square", _chi("o_orderpriority", "o_orderstatus"))
def _(t):
    return _chi_out(H.chi_square(t.orders, "o_orderpriority", "o_orderstatus"))


@query("h15_expected_counts", f"""
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS observed FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, observed, {R('sum(observed) OVER (PARTITION BY o_orderpriority) * sum(observed) OVER (PARTITION BY o_orderstatus) / CAST(sum(observed) OVER () AS DOUBLE)')} AS expected FROM c""")
def _(t):
    return H.expected_counts(t.orders, "o_orderpriority", "o_orderstatus").select(
        "o_orderpriority", "o_orderstatus", "observed", r("expected").alias("expected"))


@query("h16_cramers_v", _chi("o_orderstatus = 'F'", "o_orderpriority < '3'"))
def _(t):
    rows = t.orders.select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderpriority") < "3").alias("b"))
    return _chi_out(H.chi_square(rows, "a", "b"))


# Linear models: genes = sparse matrix features, design = intercept + high/low + line status region


_LM = """
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS sample, s_acctbal >= 5000 AS high FROM supplier),
d AS (SELECT gene, sample, CAST(sum(count) AS DOUBLE) AS v FROM (SELECT cell AS sample, gene, count FROM cnt) GROUP BY 1, 2),
g AS (SELECT gene, avg(v) FILTER (high) - avg(v) FILTER (NOT high) AS fc, avg(v) AS ave, count(*) AS n,
  (var_pop(v) FILTER (high) * count(*) FILTER (high) + var_pop(v) FILTER (NOT high) * count(*) FILTER (NOT high)) / (count(*) - 2) AS s2,
  1.0 / count(*) FILTER (high) + 1.0 / count(*) FILTER (NOT high) AS u2 FROM d JOIN s USING (sample) GROUP BY 1),
nn AS (SELECT count(*) AS nn FROM s)"""


def _lm_rows(t):
    rows = t.counts().groupBy(F.col("cell").alias("sample"), "gene").agg(F.sum("count").cast("double").alias("value"))
    samples = t.supplier.select(F.col("s_suppkey").cast("string").alias("sample"),
                                F.when(F.col("s_acctbal") >= 5000, "high").otherwise("low").alias("grp"))
    return rows, samples


@query("h17_linear_model", with_("cnt", _LM) + f"""
SELECT gene, {R('fc')} AS log_fc, {R('ave')} AS ave_expr, {R('s2', 4)} AS s2, CAST(n - 2 AS BIGINT) AS df, {R('sqrt(u2)')} AS stdev FROM g, nn WHERE n = nn""")
def _(t):
    rows, samples = _lm_rows(t)
    design = L.design(samples, {"grp": ["low", "high"]})
    fit = L.fit(rows, design)
    return L.coefficient(fit, design, "grphigh").where("complete").select(
        "gene", r("log_fc").alias("log_fc"), r("ave_expr").alias("ave_expr"), r("s2", 4).alias("s2"), "df", r("stdev").alias("stdev"))


@query("h18_contrasts", with_("cnt", """
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS sample, CASE WHEN s_acctbal >= 6000 THEN 'c' WHEN s_acctbal >= 3000 THEN 'b' ELSE 'a' END AS grp FROM supplier)""", """
d AS (SELECT cell AS sample, gene, CAST(sum(count) AS DOUBLE) AS v FROM cnt GROUP BY 1, 2)""", """
g AS (SELECT gene, grp, avg(v) AS m, CAST(count(*) AS DOUBLE) AS n FROM d JOIN s USING (sample) GROUP BY 1, 2)""", """
w AS (SELECT gene, max(m) FILTER (grp = 'a') AS a, max(m) FILTER (grp = 'b') AS b, max(m) FILTER (grp = 'c') AS c,
  max(n) FILTER (grp = 'a') AS na, max(n) FILTER (grp = 'b') AS nb, max(n) FILTER (grp = 'c') AS nc, sum(n) AS n FROM g GROUP BY 1)""") + f"""
SELECT gene, {R('c - (a + b) / 2')} AS estimate, {R('sqrt(1 / nc + 0.25 / na + 0.25 / nb)')} AS stdev FROM w WHERE n = (SELECT count(*) FROM s)""")
def _(t):
    rows, _ = _lm_rows(t)
    bal = F.col("s_acctbal")
    samples = t.supplier.select(F.col("s_suppkey").cast("string").alias("sample"), F.when(
        bal >= 6000, "c").when(bal >= 3000, "b").otherwise("a").alias("grp"))
    design = L.design(samples, {"grp": ["a", "b", "c"]}, intercept=False)
    out = L.contrast(L.fit(rows, design), design, {"grpc": 1.0, "grpa": -0.5, "grpb": -0.5})
    return out.where("complete").select("gene", r("log_fc").alias("estimate"), r("stdev").alias("stdev"))


@query("h19_moderated_t")
def _(t):
    rows, samples = _lm_rows(t)
    logged = rows.withColumn("value", F.log2(F.col("value") + 0.5))
    design = L.design(samples, {"grp": ["low", "high"]})
    out = L.moderated(L.coefficient(L.fit(logged, design), design, "grphigh"))
    return L.top_table(out).select("gene", *[r(c).alias(c) for c in ("log_fc", "ave_expr", "t", "p", "p_adj", "b")])


@query("h20_log_cpm", with_("cnt") + f"""
SELECT plate, cell, gene, {R('log2((count + 0.5) / (sum(count) OVER (PARTITION BY plate, cell) + 1) * 1e6)')} AS e FROM cnt""")
def _(t):
    return N.log_cpm(t.counts(), ["plate", "cell"]).select("plate", "cell", "gene", r("e").alias("e"))


_TMM = """
x AS (SELECT cell AS sample, gene, CAST(sum(count) AS DOUBLE) AS c FROM cnt GROUP BY 1, 2),
full_x AS (SELECT s.sample, g.gene, coalesce(x.c, 0) AS c FROM (SELECT DISTINCT sample FROM x) s JOIN (SELECT DISTINCT gene FROM x) g ON TRUE LEFT JOIN x ON x.sample = s.sample AND x.gene = g.gene),
lib AS (SELECT sample, sum(c) AS n, quantile_cont(c, 0.75) / sum(c) AS f75 FROM full_x GROUP BY 1),
ref AS (SELECT sample AS rs, n AS rn FROM lib ORDER BY abs(f75 - (SELECT avg(f75) FROM lib)), sample LIMIT 1),
ma AS (SELECT x.sample, x.gene, log2((x.c / n) / (y.c / rn)) AS m, (log2(x.c / n) + log2(y.c / rn)) / 2 AS a, (n - x.c) / n / x.c + (rn - y.c) / rn / y.c AS v
  FROM x JOIN lib USING (sample) CROSS JOIN ref JOIN x y ON y.sample = rs AND y.gene = x.gene),
rk AS (SELECT *, count(*) OVER (PARTITION BY sample) AS k, rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS rm,
  rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ra, max(abs(m)) OVER (PARTITION BY sample) AS mm FROM ma),
f AS (SELECT sample, CASE WHEN max(mm) < 1e-6 THEN 1.0 ELSE 2 ** (sum(m / v) FILTER (rm >= floor(k * 0.3) + 1 AND rm <= k - floor(k * 0.3) AND ra >= floor(k * 0.05) + 1 AND ra <= k - floor(k * 0.05))
  / sum(1 / v) FILTER (rm >= floor(k * 0.3) + 1 AND rm <= k - floor(k * 0.3) AND ra >= floor(k * 0.05) + 1 AND ra <= k - floor(k * 0.05))) END AS f FROM rk GROUP BY 1)"""


@query("h21_norm_factors", with_("cnt", _TMM) + f"SELECT sample, {R('f / exp((SELECT avg(ln(f)) FROM f))')} AS factor FROM f")
def _(t):
    rows = t.counts().groupBy(F.col("cell").alias("sample"), "gene").agg(F.sum("count").alias("count"))
    return N.trimmed_mean_factors(rows).select("sample", r("factor").alias("factor"))


@query("h22_model_agreement", f"""
SELECT l_returnflag AS pair, l_linestatus AS architecture, {R('corr(l_quantity, l_extendedprice)')} AS r, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    from essenta.operators.scores import agreement

    rows = t.lineitem.select(F.col("l_returnflag").alias("pair"), F.col("l_linestatus").alias("architecture"),
                             F.col("l_quantity").alias("first"), F.col("l_extendedprice").alias("second"))
    return agreement(rows, ["pair", "architecture"], "first", "second").select("pair", "architecture", r("r").alias("r"), "n")


@query("h23_score_correlations", f"""
WITH c AS (SELECT l_returnflag AS architecture, l_linenumber AS seed, abs(corr(l_discount, l_extendedprice)) AS r FROM lineitem GROUP BY 1, 2)
SELECT architecture, {R('avg(r)')} AS mean, {R('stddev_samp(r)')} AS sd, {R('stddev_samp(r) / sqrt(count(*))')} AS sem, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    per = t.lineitem.groupBy(F.col("l_returnflag").alias("architecture"), "l_linenumber").agg(
        F.abs(F.corr("l_discount", "l_extendedprice")).alias("r"))
    out = mean_sd_sem(per, ["architecture"], "r")
    return out.select("architecture", r("mean").alias("mean"), r("sd").alias("sd"), r("sem").alias("sem"), "n")


@query("k32_feature_report", with_("expr resp", RHO) + f"""
SELECT response, CAST(10 AS BIGINT) AS n_features, {R('rho')} AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY response ORDER BY abs(rho) DESC, gene) AS k FROM rho) WHERE k = 10""")
def _(t):
    top = top_features(H.spearman(t.expression(), t.responses(), aligned=True), ["response"], 10)
    return top.groupBy("response").agg(F.count(F.lit(1)).alias("n_features"), F.max_by("rho", "rank").alias("c")).select(
        "response", "n_features", r("c").alias("cutoff"))
