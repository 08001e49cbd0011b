"""Registered queries: fits whose answer is known in closed form.

Without a penalty and with at least as many latent dimensions as features, a full-rank ``W``
with its best heads predicts exactly what least squares predicts, whatever the random start;
the gradient is zero and every epoch keeps it. So losses and metrics of these fits are
those of least squares on two features, which SQL can state.
"""

from pyspark.sql import functions as F

from essenta.operators import factor_model as M
from essenta.operators import scores as S
from essenta.plans import training
from essenta.plans.catalog import SEEDS, query, r, with_
from essenta.plans.q_models import SEED, joint_responses, one_model, per_seed

GENES = ["f0", "f5"]
EPOCHS = {"tuning_epochs": 500, "training_epochs": 1000}
FLAGS = """resp AS (SELECT CAST(vec_id AS VARCHAR) AS sample, 'drug' || i AS response, abs(CAST(label AS DOUBLE) - 3 * i) AS value
  FROM embeddings, (SELECT unnest(range(3)) AS i) UNION ALL
  SELECT CAST(vec_id AS VARCHAR), 'dep', CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE) FROM embeddings)"""


def _sql(tail, seeds=(SEED,), scope="split = 'train'", resp=None):
    parts = [resp] if resp else []
    return with_("expr" if resp else "expr resp", *parts, f"""
ord AS (SELECT seed, sample, row_number() OVER (PARTITION BY seed ORDER BY md5(sample || '|' || seed), sample) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n
  FROM (SELECT DISTINCT sample FROM resp), (SELECT unnest({list(seeds)}) AS seed)),
cutp AS (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS held FROM ord),
fl AS (SELECT *, pos - held AS pl, (n - held) // 5 AS small, (n - held) % 5 AS larger FROM cutp),
sp AS (SELECT seed, sample, CASE WHEN pos < held THEN 'test' ELSE 'train' END AS split, CAST(CASE WHEN pos < held THEN -1
  WHEN pl < larger * (small + 1) THEN pl // (small + 1) ELSE larger + (pl - larger * (small + 1)) // small END AS INTEGER) AS fold FROM fl),
mean AS (SELECT seed, response, avg(value) AS m FROM resp JOIN sp USING (sample) WHERE split = 'train' GROUP BY 1, 2),
cen AS (SELECT seed, response, sample, value - m AS y FROM resp JOIN mean USING (response)),
st AS (SELECT seed, gene, avg(value) AS m, stddev_samp(value) AS s FROM expr JOIN sp USING (sample) WHERE gene IN ('f0', 'f5') AND {scope} GROUP BY 1, 2),
x AS (SELECT seed, sample, max((value - m) / s) FILTER (gene = 'f0') AS a, max((value - m) / s) FILTER (gene = 'f5') AS b FROM expr JOIN st USING (gene) GROUP BY 1, 2),
d AS (SELECT seed, sample, split, fold, response, a, b, y FROM x JOIN sp USING (seed, sample) JOIN cen USING (seed, sample)),
ls AS (SELECT seed, held, response, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb
  FROM d, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS held) WHERE split = 'train' AND fold <> held GROUP BY 1, 2, 3),
w AS (SELECT seed, held, response, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM ls),
p AS (SELECT d.*, held, a * wa + b * wb AS p FROM d JOIN w USING (seed, response)),
k AS (SELECT response, CASE WHEN count(*) OVER () = 1 THEN 1.0 WHEN response = 'dep' THEN 0.5 WHEN response = 'ic50' THEN 0.5 ELSE 0.5 / (count(*) OVER () - 1) END AS share
  FROM (SELECT DISTINCT response FROM resp)),
loss AS (SELECT seed, held, sum(share * train) AS train_loss, sum(share * val) AS val_loss FROM (SELECT seed, held, response,
  avg((p - y) * (p - y)) FILTER (fold >= 0 AND fold <> held) AS train, avg((p - y) * (p - y)) FILTER (fold = held) AS val FROM p GROUP BY 1, 2, 3) JOIN k USING (response) GROUP BY 1, 2),
fin AS (SELECT 'm' || seed AS model_id, response, split, y, p FROM p WHERE held = -1),
rk AS (SELECT *, rank() OVER (PARTITION BY model_id, response, split ORDER BY y) + (count(*) OVER (PARTITION BY model_id, response, split, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY model_id, response, split ORDER BY p) + (count(*) OVER (PARTITION BY model_id, response, split, p) - 1) / 2.0 AS rp FROM fin)""") + tail


METRICS = """SELECT model_id, response, split, count(*) AS n, round(corr(y, p), 4) AS pearson, round(corr(ry, rp), 3) AS spearman,
 round(avg((y - p) * (y - p)), 3) AS mse FROM rk {} GROUP BY 1, 2, 3"""
FOLDS = "SELECT held AS fold, round(train_loss, 5) AS train_loss, round(val_loss, 5) AS val_loss FROM loss WHERE held >= 0"


def _features(t, *models):
    return t.spark.createDataFrame([(m, g) for m in models for g in GENES], "model_id string, gene string")


def _ready(t, responses, **options):
    return training.prepare(t.expression().where(F.col("gene").isin(GENES)), responses, one_model(t), features=_features(t, "m"), **options)


def _search(ready, trials):
    return M.search(ready["moments"], M.response_weights(ready["centred"]), ready["models"], trials)


def _folds(fits):
    return fits.select("fold", r("train_loss", 5).alias("train_loss"), r("val_loss", 5).alias("val_loss"))


ONE = ([10], [1e-5], [0.0])


@query("k6_least_squares", _sql(FOLDS))
def _(t):
    return _folds(_search(_ready(t, joint_responses(t)), M.grid_trials(*ONE)))


@query("k7_least_squares", _sql(FOLDS, scope="TRUE", resp=FLAGS))
def _(t):
    flags = t.embeddings.select(
        F.lit("m").alias("model_id"), F.col("vec_id").cast("string").alias("sample"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
            F.concat(F.lit("drug"), i).alias("response"), F.abs(F.col("label") - 3 * i).cast("double").alias("value")))).alias("e"),
    ).select("model_id", "e.response", "sample", "e.value")
    dep = joint_responses(t).where("response = 'dep'").select("model_id", "response", "sample", "value")
    return _folds(_search(_ready(t, dep.unionByName(flags), scope="all"), M.grid_trials(*ONE)))


@query("k8_least_squares", _sql("""SELECT held AS fold, round(avg((p - y) * (p - y)) FILTER (fold >= 0 AND fold <> held), 5) AS train_loss,
 round(avg((p - y) * (p - y)) FILTER (fold = held), 5) AS val_loss FROM p WHERE response = 'dep' AND held >= 0 GROUP BY 1"""))
def _(t):
    return _folds(_search(_ready(t, joint_responses(t).where("response = 'dep'"), ddof=0), M.grid_trials(*ONE)))


@query("k10_least_squares", _sql("""SELECT latent_dim, 5 AS folds, round(avg(val_loss), 5) AS val_loss FROM loss,
 (SELECT unnest([2, 10, 40]) AS latent_dim) WHERE held >= 0 GROUP BY 1"""))
def _(t):
    fits = _search(_ready(t, joint_responses(t)), M.grid_trials([2, 10, 40], [1e-5, 1e-4], [0.0]))
    losses = M.trial_losses(fits).groupBy("latent_dim").agg(F.max("val_loss").alias("v"))
    counted = fits.where("status = 'ok'").groupBy("latent_dim").agg(F.countDistinct("fold").cast("int").alias("folds"))
    return counted.join(losses, "latent_dim").select("latent_dim", "folds", r("v", 5).alias("val_loss"))


@query("k11_least_squares", _sql("SELECT 'm' AS model_id, round(avg(val_loss), 5) AS val_loss FROM loss WHERE held >= 0"))
def _(t):
    fits = _search(_ready(t, joint_responses(t)), M.grid_trials([10, 20], [1e-5, 1e-4], [0.0]))
    return M.best_trials(M.trial_losses(fits), absolute=True).select("model_id", r("val_loss", 5).alias("val_loss"))


def _trained(t, seeds=(SEED,), **options):
    models = per_seed(one_model(t).drop("seed", "model_id"), seeds).withColumn("seed", F.substring("model_id", 2, 20).cast("int"))
    features = _features(t, *[f"m{s}" for s in seeds])
    return training.train(t.expression().where(F.col("gene").isin(GENES)), per_seed(t.responses(), seeds), models,
                          trials=M.grid_trials(*ONE), features=features, **EPOCHS, **options)


def _metrics(rows):
    return rows.select("model_id", "response", "split", "n", r("pearson", 4).alias("pearson"), r("spearman", 3).alias("spearman"), r("mse", 3).alias("mse"))


@query("k12_least_squares", _sql("SELECT 'm' || seed AS model_id, 'ok' AS status, round(val_loss, 5) AS val_loss FROM loss WHERE held = -1"))
def _(t):
    return _trained(t)["model"].select("model_id", "params.status", r("params.val_loss", 5).alias("val_loss"))


@query("k14_least_squares", _sql(METRICS.format("")))
def _(t):
    return _metrics(_trained(t)["metrics"])


@query("k15_least_squares", _sql(METRICS.format(""), seeds=SEEDS))
def _(t):
    return _metrics(_trained(t, SEEDS)["metrics"])


@query("k16_least_squares", _sql(METRICS.format("WHERE response = 'ic50'")))
def _(t):
    joint = _trained(t)
    single = one_model(t, model_id=f"m{SEED}")
    responses = joint_responses(t, f"m{SEED}").where("response = 'ic50'")
    out = training.train(t.expression().where(F.col("gene").isin(GENES)), responses, single, trials=M.grid_trials(*ONE),
                         split=joint["model_split"], features=joint["model_weight"].select("model_id", "gene"), **EPOCHS)
    return _metrics(out["metrics"])


@query("k26_least_squares", _sql("SELECT response, split, round(corr(y, p), 4) AS r FROM fin GROUP BY 1, 2"))
def _(t):
    ready = _ready(t, joint_responses(t))
    unit = t.spark.createDataFrame([("m", "f0", [1.0, 0.0]), ("m", "f5", [0.0, 1.0])], "model_id string, gene string, w array<double>")
    return S.refit_heads(ready["moments"], unit).select("response", "split", r("r", 4).alias("r"))
