import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from essenta.operators import factor_model as M
from essenta.operators import scores as S
from essenta.plans import training
from essenta.sources import registry

N, P, SEED = 120, 8, 42


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(11)
    g = rng.normal(size=(N, P)) * 2 + 3
    dep = g[:, 0] - g[:, 1] + rng.normal(scale=0.1, size=N)
    ic50 = g[:, 2] + rng.normal(scale=0.1, size=N)
    return g, dep, ic50


@pytest.fixture(scope="module")
def tables(spark, raw):
    g, dep, ic50 = raw
    expr = pd.DataFrame([(f"s{i:03d}", f"g{j}", float(g[i, j])) for i in range(N) for j in range(P)], columns=["sample", "gene", "value"])
    resp = pd.DataFrame([("m", r, f"s{i:03d}", float(v[i])) for r, v in (("dep", dep), ("ic50", ic50)) for i in range(N)],
                        columns=["model_id", "response", "sample", "value"])
    models = pd.DataFrame([("m", "d", "g7", SEED)], columns=["model_id", "drug", "target", "seed"])
    return [spark.createDataFrame(x).cache() for x in (expr, resp, models)]


@pytest.fixture(scope="module")
def ready(tables):
    expr, resp, models = tables
    return training.prepare(expr, resp, models, features=expr.selectExpr("'m' AS model_id", "gene").distinct())


def test_split_sizes_and_determinism(spark, split):
    cohort = spark.range(103).select(F.lit("m").alias("model_id"), F.col("id").cast("string").alias("sample"), F.lit(1).alias("seed"))
    a, b = (M.split_samples(cohort).toPandas().set_index("sample") for _ in range(2))
    assert a.sort_index().equals(b.sort_index())
    sizes = a.groupby("fold").size().to_dict()
    assert sizes == {-1: 20, 0: 17, 1: 17, 2: 17, 3: 16, 4: 16}
    other = M.split_samples(cohort.withColumn("seed", F.lit(2))).toPandas().set_index("sample")
    assert not a.sort_index().equals(other.sort_index())


def test_moments_equal_rows(ready, raw):
    g, dep, ic50 = raw
    split = ready["split"].toPandas().set_index("sample").sort_index()
    train = (split["split"] == "train").to_numpy()
    z = (g - g[train].mean(0)) / g[train].std(0, ddof=1)
    v = np.column_stack([z, dep - dep[train].mean(), ic50 - ic50[train].mean(), np.ones(N)])
    table = ready["moments"].toPandas()
    total = np.zeros((P + 3, P + 3))
    for row in table.itertuples():
        rows = v[(split["fold"] == row.fold).to_numpy()]
        a = np.reshape(row.a, (row.d, row.d))
        assert np.allclose(a, rows.T @ rows)
        total += a
    assert np.allclose(total, v.T @ v) and total[-1, -1] == pytest.approx(N)


def test_epochs_on_moments_equal_epochs_on_rows():
    rng = np.random.default_rng(0)
    g, y = rng.normal(size=(60, 6)), rng.normal(size=(60, 2))
    y = y - y.mean(0)
    start = rng.standard_normal((6, 3))
    v = np.column_stack([g, y, np.ones(60)])
    got = M.descend(v.T @ v, 6, np.array([0.5, 0.5]), start, 1e-4, 1e-2, 25)
    w = start.copy()
    for _ in range(25):
        zt = g @ w
        h = np.linalg.pinv(zt.T @ zt) @ zt.T @ y
        err = zt @ h - y
        loss = 0.5 * (err**2).mean(0).sum()
        w = w - 1e-4 * (4 * g.T @ err @ h.T + 1e-2 * np.sign(w))
    assert np.allclose(got[0], w) and np.allclose(got[1], h) and got[2] == pytest.approx(loss)
    with np.errstate(all="ignore"):
        assert M.descend(v.T @ v, 6, np.array([0.5, 0.5]), start, 1e300, 0.0, 5) is None


def test_search_picks_a_finite_trial(ready):
    weights = M.response_weights(ready["centred"])
    assert {r.response: r.weight for r in weights.collect()} == {"dep": 0.5, "ic50": 0.5}
    fits = M.search(ready["moments"], weights, ready["models"], M.grid_trials([3], [1e-5, 1e300], [1e-3]), epochs=40, per_task=1)
    losses = M.trial_losses(fits).toPandas().set_index("trial")
    assert losses.loc[1, "diverged"] > 0 and np.isnan(losses.loc[1, "val_loss"])
    best = M.best_trials(M.trial_losses(fits)).collect()
    assert [r.trial for r in best] == [0]
    one = M.search(ready["moments"], weights, ready["models"], M.grid_trials([3], [1e-5], [1e-3]), epochs=1).agg(F.avg("train_loss")).first()[0]
    many = M.search(ready["moments"], weights, ready["models"], M.grid_trials([3], [1e-4], [1e-3]), epochs=60).agg(F.avg("train_loss")).first()[0]
    assert many < one


def test_multi_drug_weights(spark):
    rows = spark.createDataFrame([("m", r) for r in ("dep", "a", "b")] + [("one", "x")], "model_id string, response string")
    got = {(r.model_id, r.response): r.weight for r in M.response_weights(rows).collect()}
    assert got == {("m", "dep"): 0.5, ("m", "a"): 0.25, ("m", "b"): 0.25, ("one", "x"): 1.0}


def test_random_trials_stay_in_the_space(spark):
    rows = spark.range(1).select(F.explode(M.random_trials(200, 5)).alias("t")).select("t.*").toPandas()
    assert set(rows["latent_dim"]) <= set(range(10, 75, 5)) and len(set(rows["latent_dim"])) == 13
    assert rows["learning_rate"].between(1e-5, 1e-2).all() and rows["lambda"].between(1e-5, 1e-1).all()


def test_missing_feature_is_an_error(tables):
    expr, resp, models = tables
    holes = expr.where("NOT (sample = 's003' AND gene = 'g2')")
    with pytest.raises(Exception, match="lacks features"):
        training.prepare(holes, resp, models, features=expr.selectExpr("'m' AS model_id", "gene").distinct())


def test_one_unfit_model_ends_no_other(spark, tables):
    expr, resp, models = tables
    copy = lambda d, name: d.withColumn("model_id", F.lit(name))
    three = copy(models, "m").unionByName(copy(models, "gaps")).unionByName(copy(models, "none"))
    gaps = resp.withColumn("value", F.when(~((F.col("sample") < "s005") & (F.col("response") == "ic50")), F.col("value")))
    rows = copy(resp, "m").unionByName(copy(gaps, "gaps")).unionByName(copy(resp, "none").withColumn("value", F.lit(None).cast("double")))
    out = training.train(expr, rows, three, trials=M.grid_trials([3], [1e-4], [1e-3]), tuning_epochs=5, training_epochs=20, k=3)
    assert {r.model_id: r.status for r in out["status"].collect()} == {"m": "ok", "gaps": "ok", "none": "no complete sample"}
    assert {r.model_id for r in out["metrics"].collect()} == {"m", "gaps"}
    used = {r.sample for r in out["model_split"].where("model_id = 'gaps'").collect()}
    assert len(used) == N - 5 and "s000" not in used
    holes = expr.where("NOT (sample = 's003' AND gene = 'g2')")
    features = expr.selectExpr("'m' AS model_id", "gene").distinct()
    assert training.prepare(holes, resp, models, features=features, strict=False)["status"].first().status == "a sample lacks a feature"


def test_training_registry_and_resume(spark, tables, tmp_path, raw):
    expr, resp, models = tables
    out = training.train(expr, resp, models, trials=M.grid_trials([4], [1e-4], [1e-3]), tuning_epochs=30, training_epochs=200, k=3)
    metrics = {(r.response, r.split): r for r in out["metrics"].collect()}
    assert metrics["dep", "test"].pearson > 0.8 and metrics["ic50", "train"].pearson > 0.8
    path = str(tmp_path / "models")
    registry.save_models(out, path)
    saved = registry.load_models(spark, path)
    genes = {r.gene for r in saved["model_weight"].collect()}
    assert {"g0", "g1", "g2", "g7"} <= genes
    grid = models.union(spark.createDataFrame([("n", "d2", "g1", 1)], models.schema))
    left = registry.still_to_fit(grid, saved["model"], ["drug", "target", "seed"]).collect()
    assert [r.model_id for r in left] == ["n"]
    rows = M.scaled(expr, saved["model_weight"].select("model_id", "gene", "mean", "sd"), saved["model_split"].select("model_id", "sample"))
    latent = S.latent(rows, saved["model_weight"]).first()
    assert len(latent.z) == 4
    with pytest.raises(FileNotFoundError):
        registry.load_models(spark, str(tmp_path / "none"))


def test_refit_heads_against_rows(spark, ready, raw):
    g, dep, ic50 = raw
    w = np.random.default_rng(2).normal(size=(P, 3))
    weights = spark.createDataFrame([("m", f"g{j}", w[j].tolist()) for j in range(P)], "model_id string, gene string, w array<double>")
    got = {(r.response, r.split): r.r for r in S.refit_heads(ready["moments"], weights).collect()}
    split = ready["split"].toPandas().set_index("sample").sort_index()
    train = (split["split"] == "train").to_numpy()
    z = (g - g[train].mean(0)) / g[train].std(0, ddof=1) @ np.eye(P) @ w
    for name, y in (("dep", dep), ("ic50", ic50)):
        y = y - y[train].mean()
        h = np.linalg.pinv(z[train].T @ z[train] + 1e-6 * np.eye(3)) @ z[train].T @ y[train]
        assert got[name, "train"] == pytest.approx(np.corrcoef(z[train] @ h, y[train])[0, 1])
        assert got[name, "test"] == pytest.approx(np.corrcoef(z[~train] @ h, y[~train])[0, 1])


def test_components_are_principal(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(80, 3)) @ np.diag([3.0, 1.0, 0.5])
    z[:, 2] += z[:, 0]
    df = spark.createDataFrame([("m", f"s{i}", z[i].tolist()) for i in range(80)], "model_id string, sample string, z array<double>")
    rows = S.component_scores(df, 5).toPandas()
    got = np.vstack(rows["components"])
    unit = (z - z.mean(0)) / z.std(0)
    values = np.sort(np.linalg.eigvalsh(unit.T @ unit / 80))[::-1]
    assert np.allclose(got.var(0)[:3], values) and (got[:, 3:] == 0).all()


def test_group_samples_minimum(spark):
    rng = np.random.default_rng(9)
    z = np.vstack([rng.normal(size=(40, 2)), rng.normal(size=(30, 2)) + 20, rng.normal(size=(5, 2)) - 30])
    df = spark.createDataFrame([(f"s{i}", z[i].tolist()) for i in range(75)], "sample string, z array<double>")
    sizes = S.group_samples(df, k=3, least=13).groupBy("cluster").count().toPandas().set_index("cluster")["count"].to_dict()
    assert sum(sizes.values()) == 75 and all(n >= 13 for c, n in sizes.items() if c != 0)


def test_best_group_uses_one_label(spark):
    profile = spark.createDataFrame([(0, 0.0, 9.0, 9.0), (1, 1.0, 3.0, 3.0), (2, 2.0, 2.0, 1.0)],
                                    "cluster int, response_a double, response_b double, score double")
    out = {r.cluster: r for r in S.best_group(profile).collect()}
    assert set(out) == {1, 2} and out[1].best and out[1].total_rank == 3
