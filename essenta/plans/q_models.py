"""Registered queries: the factor model."""

from pyspark.sql import functions as F

from essenta.operators import factor_model as M
from essenta.operators import scores as S
from essenta.operators.order import attach
from essenta.plans import training
from essenta.plans.catalog import SEEDS, R, query, r, with_

SEED = 42


def one_model(t, seed=SEED, model_id="m"):
    return t.spark.range(1).select(
        F.lit(model_id).alias("model_id"), F.lit("label").alias("drug"), F.lit("f0").alias("target"), F.lit(seed).alias("seed"))


def joint_responses(t, model_id="m"):
    return t.responses().withColumn("model_id", F.lit(model_id))


def per_seed(df, seeds):
    """One copy per seed, as model ``m<seed>``."""
    return df.withColumn("model_id", F.explode(F.array(*[F.lit(f"m{s}") for s in seeds])))


# Split, folds and moments in SQL: order by md5(sample|seed).
SPLIT = f"""
ord AS (SELECT sample, row_number() OVER (ORDER BY md5(sample || '|{SEED}'), sample) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM resp)),
cutp AS (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS held FROM ord),
fl AS (SELECT *, pos - held AS pl, (n - held) // 5 AS small, (n - held) % 5 AS larger FROM cutp),
split AS (SELECT sample, CASE WHEN pos < held THEN 'test' ELSE 'train' END AS split, CAST(CASE WHEN pos < held THEN -1
   WHEN pl < larger * (small + 1) THEN pl // (small + 1) ELSE larger + (pl - larger * (small + 1)) // small END AS INTEGER) AS fold FROM fl)"""
CENTRED = """
mean AS (SELECT response, avg(value) AS m FROM resp JOIN split USING (sample) WHERE split = 'train' GROUP BY 1),
cen AS (SELECT response, sample, value - m AS value FROM resp JOIN mean USING (response))"""
SCALED = """
st AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS s FROM expr JOIN split USING (sample) WHERE split = 'train' GROUP BY 1),
sc AS (SELECT sample, gene, (value - m) / s AS value FROM expr JOIN st USING (gene))"""
V = "v AS (SELECT sample, gene AS name, value FROM sc UNION ALL SELECT sample, response, value FROM cen UNION ALL SELECT sample, '1', 1.0 FROM split)"


def _split(t):
    return M.split_samples(t.responses().select(F.lit("m").alias("model_id"), "sample", F.lit(SEED).alias("seed")))


@query("k1_split", with_("resp", SPLIT) + "SELECT sample, split FROM split")
def _(t):
    return _split(t).select("sample", "split")


@query("k2_folds", with_("resp", SPLIT) + "SELECT sample, fold FROM split WHERE fold >= 0")
def _(t):
    return _split(t).where("fold >= 0").select("sample", "fold")


@query("k3_centre", with_("resp", SPLIT, CENTRED) + f"SELECT response, sample, {R('value')} AS value FROM cen")
def _(t):
    return M.centre(joint_responses(t), _split(t)).select("response", "sample", r("value").alias("value"))


@query("k4_scale", with_("expr resp", SPLIT, SCALED, """
sa AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS s FROM expr GROUP BY 1)""") + f"""
SELECT sc.sample, sc.gene, {R('sc.value')} AS by_train, {R('(e.value - sa.m) / sa.s')} AS by_all FROM sc
JOIN expr e ON e.sample = sc.sample AND e.gene = sc.gene JOIN sa ON sa.gene = sc.gene""")
def _(t):
    split, expr = _split(t), t.expression()
    features = expr.select(F.lit("m").alias("model_id"), "gene").distinct()
    parts = {}
    for name, scope, ddof in (("by_train", "train", 1), ("by_all", "all", 0)):
        stats = M.scale_stats(expr, features, split, scope=scope, ddof=ddof)
        parts[name] = M.scaled(expr, stats, split.select("model_id", "sample")).select("sample", "gene", r("value").alias(name))
    return parts["by_train"].join(parts["by_all"], ["sample", "gene"])


def _ready(t):
    expr = t.expression()
    features = expr.select(F.lit("m").alias("model_id"), "gene").distinct()
    return training.prepare(expr, joint_responses(t), one_model(t), features=features)


@query("k5_moments", with_("expr resp", SPLIT, CENTRED, SCALED, V) + f"""
SELECT fold, a.name AS row, b.name AS col, {R('sum(a.value * b.value)', 5)} AS s FROM v a JOIN v b USING (sample) JOIN split USING (sample) GROUP BY 1, 2, 3""")
def _(t):
    return M.long_moments(_ready(t)["moments"]).select("fold", "row", "col", r("s", 5).alias("s"))


@query("k9_validation_loss", with_("expr resp", SPLIT, CENTRED, SCALED, """
pr AS (SELECT sample, response, sum(sc.value * CASE response WHEN 'dep' THEN 0.01 ELSE -0.02 END * CAST(substr(gene, 2) AS INTEGER)) AS p
  FROM sc, (SELECT unnest(['dep', 'ic50']) AS response) GROUP BY 1, 2)""") + f"""
SELECT fold, {R('sum(loss) / 2', 5)} AS loss FROM (SELECT fold, response, avg((p - value) * (p - value)) AS loss FROM pr JOIN cen USING (sample, response)
JOIN split USING (sample) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    ready = _ready(t)
    place = F.substring("gene", 2, 9).cast("int")
    beta = ready["features"].select("model_id", "gene", F.explode(F.array(
        F.struct(F.lit("dep").alias("response"), (place * 0.01).alias("beta")),
        F.struct(F.lit("ic50").alias("response"), (place * -0.02).alias("beta")))).alias("e")).select(
        "model_id", "gene", "e.response", "e.beta")
    out = M.quadratic_loss(M.long_moments(ready["moments"]), beta, M.response_weights(ready["centred"]))
    return out.select("fold", r("loss", 5).alias("loss"))


@query("k14_aligned", with_("ic50") + """
SELECT drug AS model_id, sample FROM ic50 JOIN customer ON sample = CAST(c_custkey AS VARCHAR) WHERE c_acctbal >= 0""")
def _(t):
    ic50 = t.ic50().select(F.col("drug").alias("model_id"), F.lit("ic50").alias("response"), "sample", "value")
    # a dependency that is not measured where the balance is negative
    dep = t.customer.select(F.col("c_custkey").cast("string").alias("sample"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"))
    drugs = ic50.select("model_id").distinct().agg(F.collect_list("model_id").alias("d"))  # five order priorities
    dep = attach(dep, drugs).select(F.explode("d").alias("model_id"), F.lit("dep").alias("response"), "sample", "value")
    return training.complete_cases(ic50.unionByName(dep)).select("model_id", "sample").distinct()


@query("k10_trial_table", """
WITH t AS (SELECT CAST(i AS INTEGER) AS trial, list_transform(['latent_dim', 'learning_rate', 'lambda'],
  lambda n: CAST('0x' || substr(md5(i || '|' || n || '|20357'), 1, 8) AS BIGINT) / 4294967296.0) AS u FROM (SELECT unnest(range(100)) AS i)),
n AS (SELECT p_brand AS drug, p_type AS target, count(*) AS samples FROM part GROUP BY 1, 2)
SELECT drug, target, samples, trial, CAST(10 + 5 * floor(u[1] * 13) AS INTEGER) AS latent_dim, round(10 ** (-5 + 3 * u[2]), 9) AS learning_rate, round(10 ** (-5 + 4 * u[3]), 8) AS lambda FROM t, n""")
def _(t):
    pairs = t.part.groupBy(F.col("p_brand").alias("drug"), F.col("p_type").alias("target")).agg(F.count(F.lit(1)).alias("samples"))
    grid = pairs.select("*", F.explode(M.random_trials(100, 20357)).alias("t"))
    return grid.select("drug", "target", "samples", "t.trial", "t.latent_dim", F.round("t.learning_rate", 9).alias("learning_rate"), F.round("t.lambda", 8).alias("lambda"))


def _fit_out(fits):
    return fits.select("model_id", "fold", "trial", "latent_dim", "status", r("train_loss").alias("train_loss"), r("val_loss").alias("val_loss"))


# One moderate setting for the queries that show a fit.
SETTING = ([10], [1e-5], [1e-3])


@query("k6_joint_fit")
def _(t):
    ready = _ready(t)
    weights = M.response_weights(ready["centred"])
    return _fit_out(M.search(ready["moments"], weights, ready["models"], M.grid_trials(*SETTING), epochs=50))


@query("k7_multi_drug_fit")
def _(t):
    # responses: dependency and one complete-case column per label class
    flags = t.embeddings.select(
        F.lit("m").alias("model_id"), F.col("vec_id").cast("string").alias("sample"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
            F.concat(F.lit("drug"), i).alias("response"), F.abs(F.col("label") - 3 * i).cast("double").alias("value")))).alias("e"),
    ).select("model_id", "e.response", "sample", "e.value")
    dep = joint_responses(t).where("response = 'dep'").select("model_id", "response", "sample", "value")
    expr = t.expression()
    features = expr.select(F.lit("m").alias("model_id"), "gene").distinct()
    ready = training.prepare(expr, dep.unionByName(flags), one_model(t), features=features, scope="all")
    weights = M.response_weights(ready["centred"])
    return _fit_out(M.search(ready["moments"], weights, ready["models"], M.grid_trials(*SETTING), epochs=50))


@query("k8_single_fit")
def _(t):
    expr = t.expression()
    features = expr.select(F.lit("m").alias("model_id"), "gene").distinct()
    ready = training.prepare(expr, joint_responses(t).where("response = 'dep'"), one_model(t), features=features, ddof=0)
    weights = M.response_weights(ready["centred"])
    return _fit_out(M.search(ready["moments"], weights, ready["models"], M.grid_trials(*SETTING), epochs=50))


@query("k10_search")
def _(t):
    ready = _ready(t)
    weights = M.response_weights(ready["centred"])
    losses = M.trial_losses(M.search(ready["moments"], weights, ready["models"], M.random_trials(8, 20357), epochs=20))
    return losses.select("model_id", "trial", "latent_dim", "diverged", r("val_loss").alias("val_loss"))


@query("k11_grid_search")
def _(t):
    ready = _ready(t)
    weights = M.response_weights(ready["centred"])
    fits = M.search(ready["moments"], weights, ready["models"], M.grid_trials([10, 20], [1e-5, 1e-4], [1e-3]), epochs=20)
    best = M.best_trials(M.trial_losses(fits), absolute=True)
    return best.select("model_id", "trial", "latent_dim", "learning_rate", "lambda", r("val_loss").alias("val_loss"))


def _trained(t, seeds=(SEED,), epochs=30):
    models = per_seed(one_model(t).drop("seed", "model_id"), seeds).withColumn("seed", F.substring("model_id", 2, 20).cast("int"))
    responses = per_seed(t.responses(), seeds)
    return training.train(
        t.expression(), responses, models, trials=M.grid_trials([10], [1e-5, 3e-5], [1e-3]), tuning_epochs=epochs,
        training_epochs=2 * epochs, k=10)


@query("k12_final_fit")
def _(t):
    return _trained(t)["model"].select("model_id", "drug", "target", "seed", "params.status", r("params.val_loss").alias("val_loss"))


@query("k14_train_and_test")
def _(t):
    return _trained(t)["metrics"]


@query("k15_batch")
def _(t):
    return _trained(t, SEEDS)["metrics"]


@query("k16_reuse_split")
def _(t):
    joint = _trained(t)
    single = one_model(t, model_id=f"m{SEED}")
    responses = joint_responses(t, f"m{SEED}").where("response = 'ic50'")
    out = training.train(
        t.expression(), responses, single, trials=M.grid_trials([10], [1e-5], [1e-3]), tuning_epochs=20, training_epochs=40,
        split=joint["model_split"], features=joint["model_weight"].select("model_id", "gene"))
    return out["metrics"]


PRED = """
pr AS (SELECT l_returnflag AS model_id, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split, l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem),
rk AS (SELECT *, rank() OVER (PARTITION BY model_id, split ORDER BY y) + (count(*) OVER (PARTITION BY model_id, split, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY model_id, split ORDER BY p) + (count(*) OVER (PARTITION BY model_id, split, p) - 1) / 2.0 AS rp FROM pr)"""


@query("k13_metrics", f"""
WITH {PRED} SELECT model_id, 'r' AS response, split, count(*) AS n, round(corr(y, p), 5) AS pearson, round(corr(ry, rp), 5) AS spearman,
 round(avg((y - p) * (y - p)), 5) AS mse FROM rk GROUP BY 1, 3""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model_id"), F.lit("r").alias("response"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("split"),
        F.col("l_quantity").alias("value"), (F.col("l_extendedprice") / 1500).alias("prediction"))
    return S.model_metrics(rows)
