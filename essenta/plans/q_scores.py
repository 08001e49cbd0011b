"""Registered queries: influence, benefit scores and cross-model analysis.

The weights ``W`` and heads ``h`` of these queries are means of the embedding vectors per
label, so both engines derive the same model from the tables.
"""

from pyspark.sql import functions as F

from essenta.operators import scores as S
from essenta.plans import training
from essenta.plans.catalog import SEEDS, R, query, r, with_
from essenta.plans.q_models import one_model, per_seed

WT = """
wt AS (SELECT e.gene, label AS k, avg(e.value) AS w FROM expr e JOIN embeddings ON CAST(vec_id AS VARCHAR) = sample GROUP BY 1, 2),
hd AS (SELECT response, label AS k, avg(value) AS h FROM resp JOIN embeddings ON CAST(vec_id AS VARCHAR) = sample GROUP BY 1, 2),
st AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS s FROM expr GROUP BY 1),
sc AS (SELECT sample, gene, (value - m) / s AS value FROM expr JOIN st USING (gene))"""
INF = """
inf AS (SELECT response, gene, sum(w * h) AS b FROM wt JOIN hd USING (k) GROUP BY 1, 2),
tab AS (SELECT gene, max(b) FILTER (response = 'dep') AS d, max(b) FILTER (response = 'ic50') AS i FROM inf GROUP BY 1),
sca AS (SELECT gene, d, i, d - i AS c, (d - i - avg(d - i) OVER ()) / stddev_pop(d - i) OVER () AS z FROM tab)"""


def model(t):
    """Model tables ``(weights, heads)`` and the scaled rows."""
    labels = t.embeddings.select(F.col("vec_id").cast("string").alias("sample"), "label")
    expr = t.expression()

    def as_array(df, keys, value, name):
        means = df.join(labels, "sample").groupBy(*keys, "label").agg(F.avg(value).alias("_v"))
        return means.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("label", "_v"))), lambda e: e["_v"]).alias(name))

    stats = expr.groupBy("gene").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    weights = as_array(expr, ["gene"], "value", "w").join(stats, "gene").withColumn("model_id", F.lit("m"))
    heads = as_array(t.responses(), ["response"], "value", "h").withColumn("model_id", F.lit("m")).withColumn("mean", F.lit(0.5))
    rows = expr.join(F.broadcast(stats), "gene").select(
        F.lit("m").alias("model_id"), "sample", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))
    return weights, heads, rows


def rounded(df, *names, digits=6):
    return df.select(*[c for c in df.columns if c not in names], *[r(c, digits).alias(c) for c in names])


@query("k17_latent", with_("expr resp", WT) + f"SELECT sample, k AS dim, {R('sum(value * w)')} AS z FROM sc JOIN wt USING (gene) GROUP BY 1, 2")
def _(t):
    weights, _, rows = model(t)
    return S.latent(rows, weights).select("sample", F.posexplode("z").alias("dim", "z")).withColumn("z", r("z"))


@query("k18_predict", with_("expr resp", WT, INF) + f"SELECT response, sample, {R('sum(value * b) + 0.5')} AS prediction FROM sc JOIN inf USING (gene) GROUP BY 1, 2")
def _(t):
    weights, heads, rows = model(t)
    out = S.predict(rows, {"model_weight": weights, "model_head": heads}, raw_scale=True)
    return out.select("response", "sample", r("prediction").alias("prediction"))


@query("k19_influence", with_("expr resp", WT, INF) + f"SELECT response, gene, {R('b')} AS influence FROM inf")
def _(t):
    weights, heads, _ = model(t)
    return S.gene_influence(weights, heads).select("response", "gene", r("influence").alias("influence"))


@query("k20_influence_table", with_("expr resp", WT, INF) + f"""
SELECT gene, {R('d')} AS dep_inf, {R('i')} AS ic50_inf, {R('c')} AS combined_inf, {R('z')} AS scaled_combined FROM sca""")
def _(t):
    weights, heads, _ = model(t)
    names = ["dep_inf", "ic50_inf", "combined_inf", "scaled_combined"]
    return rounded(S.influence_table(weights, heads).drop("model_id"), *names)


@query("k21_benefit", with_("expr resp", WT, INF, "raw AS (SELECT sample, sum(value * z) AS s FROM sc JOIN sca USING (gene) GROUP BY 1)") + f"""
SELECT sample, {R('s')} AS raw_score, {R('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS scaled_score FROM raw""")
def _(t):
    weights, heads, rows = model(t)
    out = S.benefit_score(rows, S.influence_table(weights, heads)).drop("model_id")
    return rounded(out, "raw_score", "scaled_score")


@query("k22_difference_score", with_("expr resp", WT, INF, "raw AS (SELECT sample, sum(value * c) AS s FROM sc JOIN sca USING (gene) GROUP BY 1)") + f"""
SELECT sample, {R('s')} AS raw_score, {R('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS scaled_score FROM raw""")
def _(t):
    weights, heads, rows = model(t)
    out = S.difference_score(S.predict(rows, {"model_weight": weights, "model_head": heads})).drop("model_id")
    return rounded(out, "raw_score", "scaled_score")


@query("k22_raw_expression", with_("expr resp", WT, INF, "raw AS (SELECT sample, sum(value * c) AS s FROM expr JOIN sca USING (gene) GROUP BY 1)") + f"""
SELECT sample, {R('s')} AS raw_score, {R('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS scaled_score FROM raw""")
def _(t):
    weights, heads, _ = model(t)
    out = S.difference_score(S.predict(t.expression(), {"model_weight": weights, "model_head": heads})).drop("model_id")
    return rounded(out, "raw_score", "scaled_score")


@query("k23_unit_influence", with_("expr resp", WT, """
nm AS (SELECT response, sqrt(sum(h * h)) AS n FROM hd GROUP BY 1)""", """
u AS (SELECT response, gene, sum(w * h / n) AS b FROM wt JOIN hd USING (k) JOIN nm USING (response) GROUP BY 1, 2)""", """
x AS (SELECT gene, max(b) FILTER (response = 'dep') AS d, max(-b) FILTER (response = 'ic50') AS i FROM u GROUP BY 1)""") + f"""
SELECT gene, {R('d')} AS dependency_effect, {R('i')} AS ic50_effect, {R('d + i')} AS total_influence FROM x""")
def _(t):
    weights, heads, _ = model(t)
    return rounded(S.unit_influence(weights, heads).drop("model_id"), "dependency_effect", "ic50_effect", "total_influence")


@query("k24_influence_by_drug", with_("expr resp", WT, INF) + f"""
SELECT response, gene, {R('b')} AS influence, {R('(b - avg(b) OVER g) / stddev_pop(b) OVER g')} AS scaled FROM inf WINDOW g AS (PARTITION BY response)""")
def _(t):
    weights, heads, _ = model(t)
    return rounded(S.influence_by_drug(weights, heads).drop("model_id"), "influence", "scaled")


# An outside cohort: suppliers by brand and type, influence per gene from part sizes. Some
# influence names are only reachable through aliases.
@query("k25_score_cohort", with_("sparse", """
iw AS (SELECT CASE WHEN p_type = 'SMALL' THEN 'new-' || p_brand || '-' || p_type ELSE p_brand || '-' || p_type END AS gene,
   (avg(p_size) - 25) / 5 AS z FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1)""", """
coh AS (SELECT sample, CASE WHEN gene LIKE '%-SMALL' THEN 'new-' || gene ELSE gene END AS gene, value FROM sparse)""", """
sh AS (SELECT sample, gene, avg(value) AS value FROM coh WHERE gene IN (SELECT gene FROM iw) GROUP BY 1, 2)""", """
zz AS (SELECT sample, gene, coalesce((value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0), 0) AS v FROM sh WINDOW g AS (PARTITION BY gene))""", """
raw AS (SELECT sample, sum(v * z) AS s FROM zz JOIN iw USING (gene) GROUP BY 1)""") + f"""
SELECT sample, {R('s')} AS raw_score, {R('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS scaled_score FROM raw""")
def _(t):
    name = F.concat_ws("-", "p_brand", "p_type")
    part = t.part.where("p_type <> 'ECONOMY'").withColumn("gene", F.when(
        F.col("p_type") == "SMALL", F.concat(F.lit("new-"), name)).otherwise(name))
    influence = part.groupBy("gene").agg(((F.avg("p_size") - 25) / 5).alias("scaled_combined"))
    aliases = t.part.select(F.concat(F.lit("new-"), name).alias("target"), name.alias("alias")).distinct()
    return rounded(S.score_cohort(t.sparse_expression(), influence, aliases), "raw_score", "scaled_score")


@query("k26_refit_heads")
def _(t):
    weights, _, _ = model(t)
    models = per_seed(one_model(t).drop("seed", "model_id"), SEEDS).withColumn("seed", F.substring("model_id", 2, 20).cast("int"))
    expr = t.expression()
    features = per_seed(expr.select("gene").distinct(), SEEDS)
    ready = training.prepare(expr, per_seed(t.responses(), SEEDS), models, features=features, ddof=0)
    frozen = per_seed(weights.select("gene", "w"), SEEDS)
    out = S.refit_heads(ready["moments"], frozen)
    return out.groupBy("response", "split").agg(
        r(F.avg("r")).alias("mean"), r(F.stddev_samp("r")).alias("sd"), F.count(F.lit(1)).alias("n"))


MATRIX = """
s AS (SELECT o_orderpriority AS model_id, CAST(o_custkey AS VARCHAR) AS sample, max(o_totalprice) AS s FROM orders GROUP BY 1, 2),
shared AS (SELECT sample FROM s GROUP BY 1 HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM s)),
z AS (SELECT model_id, sample, (s - avg(s) OVER g) / stddev_samp(s) OVER g AS z FROM s WHERE sample IN (SELECT sample FROM shared) WINDOW g AS (PARTITION BY model_id))"""


@query("k27_score_matrix", with_("lin", MATRIX) + f"SELECT coalesce(lineage, 'Unknown') AS lineage, sample, model_id, {R('z')} AS z FROM z LEFT JOIN lin USING (sample)")
def _(t):
    scores = t.ic50().select(F.col("drug").alias("model_id"), "sample", F.col("value").alias("raw_score"))
    return rounded(S.score_matrix(scores, t.lineage()), "z")


@query("k28_compare_predictions", """
WITH o AS (SELECT l_returnflag AS k, l_orderkey AS sample, avg(l_quantity) AS value, avg(l_quantity + l_linenumber) AS ours, avg(l_extendedprice / 1500) AS theirs FROM lineitem GROUP BY 1, 2),
l AS (SELECT k, 'ours' AS source, value, ours AS p FROM o UNION ALL SELECT k, 'theirs', value, theirs FROM o)""" + f"""
SELECT k, source, count(*) AS n, {R('corr(value, p)')} AS pearson, {R('sqrt(avg((p - value) ** 2))')} AS rmse, {R('avg(abs(p - value))')} AS mae FROM l GROUP BY 1, 2""")
def _(t):
    base = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("fold"),
                             "l_quantity", "l_extendedprice")
    truth = base.groupBy("k", "sample").agg(F.avg("l_quantity").alias("value"))
    ours = base.select("k", "sample", "fold", (F.col("l_quantity") + F.col("fold")).alias("prediction"))
    theirs = base.select("k", "sample", "fold", (F.col("l_extendedprice") / 1500).alias("prediction"))
    return S.compare_predictions(ours, theirs, truth, ["k"]).select("k", "source", "n", r("pearson").alias("pearson"), r("rmse").alias("rmse"), r("mae").alias("mae"))


def raw_z(t):
    return t.embeddings.select(
        F.lit("m").alias("model_id"), F.col("vec_id").cast("string").alias("sample"),
        F.transform("embedding", lambda x: x.cast("double")).alias("z"))


@query("k29_components")
def _(t):
    return S.component_scores(raw_z(t)).select("model_id", "sample", F.posexplode("components").alias("component", "v")).withColumn("v", r("v", 5))


@query("k30_group_samples")
def _(t):
    return S.group_samples(raw_z(t))


BEST = """
g AS (SELECT label AS cluster, avg(label) AS a, avg(embedding[1]::DOUBLE - embedding[2]::DOUBLE) AS b, avg(embedding[3]::DOUBLE) AS s, count(*) AS size FROM embeddings GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY a, cluster) AS ra, row_number() OVER (ORDER BY -b, cluster) AS rb, row_number() OVER (ORDER BY -s, cluster) AS rs FROM g WHERE cluster <> 0)"""


def _profile(t):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    rows = t.embeddings.select(F.col("label").alias("cluster"), F.col("label").cast("double").alias("a"), (e[0] - e[1]).alias("b"), e[2].alias("s"))
    return S.group_profile(rows, ["cluster"], "a", "b", "s")


@query("k31_best_group", "WITH " + BEST + f"""
SELECT cluster, size, ra AS rank_ic50, rb AS rank_dep, rs AS rank_score, ra + rb + rs AS total_rank,
  row_number() OVER (ORDER BY ra + rb + rs, cluster) = 1 AS best, {R('b')} AS response_b FROM rk""")
def _(t):
    out = S.best_group(_profile(t))
    return out.select("cluster", "size", "rank_ic50", "rank_dep", "rank_score", "total_rank", "best", r("response_b").alias("response_b"))


@query("k31_members", "WITH " + BEST + """
SELECT CAST(vec_id AS VARCHAR) AS sample, CASE WHEN embedding[4] > 0 THEN 'train' ELSE 'test' END AS split FROM embeddings
WHERE label = (SELECT cluster FROM rk ORDER BY ra + rb + rs, cluster LIMIT 1)""")
def _(t):
    labels = t.embeddings.select(F.col("vec_id").cast("string").alias("sample"), F.col("label").alias("cluster"))
    split = t.embeddings.select(F.col("vec_id").cast("string").alias("sample"), F.when(
        F.get("embedding", F.lit(3)) > 0, "train").otherwise("test").alias("split"))
    return S.members(labels, S.best_group(_profile(t)), split).select("sample", "split")
