"""A registry that commits, and searches that go on after a crash."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from essenta.operators import factor_model as M
from essenta.plans import training
from essenta.sources import registry

SCHEMA = "model_id string, seed long"


def models(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def broken(df):
    return df.withColumn("seed", F.raise_error(F.lit("lost")).cast("long"))


@pytest.mark.parametrize("last", ["model", "model_split"])
def test_failed_save_changes_nothing(spark, tmp_path, last):
    path = str(tmp_path / "r")
    heads = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model_id string, h double")
    registry.save_models({"model": models(spark, ("a", 1), ("b", 1)), "model_head": heads}, path)
    tables = {"model": models(spark, ("b", 2), ("c", 2)), "model_head": heads.withColumn("h", F.lit(9.0)), "model_split": models(spark, ("c", 2))}
    with pytest.raises(Exception, match="lost"):
        registry.save_models({**tables, last: broken(tables[last])}, path)
    saved = registry.load_models(spark, path)
    assert sorted(map(tuple, saved["model"].collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, saved["model_head"].collect())) == [("a", 1.0), ("b", 2.0)]
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string")
    assert [r.model_id for r in registry.still_to_fit(grid, saved["model"], ["model_id"]).collect()] == ["c"]
    registry.save_models(tables, path)  # the retry
    saved = registry.load_models(spark, path)
    assert sorted(map(tuple, saved["model"].collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, saved["model_head"].collect())) == [("a", 1.0), ("b", 9.0)]


def test_folders_follow_saves(spark, tmp_path):
    path = str(tmp_path / "r")
    registry.save_models({"model": models(spark, *[(f"m{k}", k) for k in range(300)])}, path)
    assert len(os.listdir(f"{path}/model")) == 1 and len(os.listdir(f"{path}/commits")) >= 1


def test_unfinished_marker_is_no_commit(spark, tmp_path):
    path = str(tmp_path / "r")
    registry.save_models({"model": models(spark, ("a", 1))}, path)
    (tmp_path / "r" / "commits" / "000000000002.json").write_text('{"number": 2, "bat')
    assert registry.load_models(spark, path)["model"].count() == 1
    registry.save_models({"model": models(spark, ("b", 1))}, path)
    assert registry.load_models(spark, path)["model"].count() == 2
    assert [c["number"] for c in registry.commits(spark, path)] == [1, 3]


def test_killed_search_goes_on(spark, tmp_path):
    expr = spark.createDataFrame([(f"s{k}", f"g{j}", float((k * 7 + j * j * k) % 11)) for k in range(40) for j in range(4)], "sample string, gene string, value double")
    responses = spark.createDataFrame([(m, x, f"s{k}", float((k * 5 + len(x)) % 7)) for m in "ab" for x in ("dep", "ic50") for k in range(40)],
                                      "model_id string, response string, sample string, value double")
    grid = spark.createDataFrame([("a", "g0", 1), ("b", "g1", 2)], "model_id string, target string, seed int")
    path, trials, fitted = str(tmp_path / "losses"), M.random_trials(7, 3), []
    ready = training.prepare(expr, responses, grid, k=2)
    weights = M.response_weights(ready["centred"])

    def run(limit):
        def go(part, done):
            if len(fitted) >= limit:
                raise RuntimeError("killed")
            out = M.search(ready["moments"], weights, grid, part, epochs=3, done=done).cache()
            fitted.append(out.count())
            return out
        return go

    with pytest.raises(RuntimeError, match="killed"):
        registry.resume_search(spark, path, trials, run(2), every=2)
    assert registry.load_losses(spark, path).count() == 2 * 5 * 4 == sum(fitted)
    out = registry.resume_search(spark, path, trials, run(99), every=2)
    assert sum(fitted) == out.count() == 2 * 5 * 7
    whole = M.search(ready["moments"], weights, grid, trials, epochs=3)
    key = lambda rows: sorted((r.model_id, r.fold, r.trial, r.val_loss) for r in rows.collect())
    assert key(out) == key(whole)
    # the whole training takes the stored losses
    again = training.train(expr, responses, grid, trials=trials, training_epochs=3, k=2, losses=path)
    assert key(again["trials"]) == key(whole) and len(glob.glob(f"{path}/commits/*.json")) == 2 + 4 + 1
