"""Nulls, NaN, tiny groups and other inputs that once gave wrong results."""

import math
import time

import pytest
from pyspark.sql import functions as F

from essenta.functions import probability as P
from essenta.operators import graph as G
from essenta.operators import linear_models as L
from essenta.operators import ranking as E
from essenta.operators import statistics as H
from essenta.operators.order import quantiles, top_rows
from essenta.sources import registry


def test_missing_values_have_no_quartile(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(8)] + [(8, None)], "k int, v double")
    got = {r.k: r.quartile for r in E.quartiles(df, "v").collect()}
    assert got[8] is None and got[0] == "Q1" and got[7] == "Q4"
    label = E.quartile_label(F.lit(math.nan), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert spark.range(1).select(label.alias("q")).first().q is None


def test_groups_without_a_value_keep_their_rows(spark, split):
    df = spark.createDataFrame([("a", float(k)) for k in range(90)] + [("b", None), ("b", None)], "g string, v double")
    assert {r.g: r.m for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": 44.5, "b": None}
    assert E.robust_scale(df, "v", ["g"]).count() == 92


def test_null_keys_have_quantiles(spark, split):
    rows = [("a", None, float(k)) for k in range(90)] + [(None, 1, float(k)) for k in range(60)] + [(None, None, 7.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r.g, r.h): r.m for r in quantiles(df, ["g", "h"], "v", {"m": 0.5}).collect()}
    assert got == {("a", None): 44.5, (None, 1): 29.5, (None, None): 7.0, (None, 2): None}


def test_two_rows_have_no_p(spark):
    rows = [(g, 0.1 * g + k / 3, 0.7 * g * k + 0.1) for g in range(200) for k in range(2)] + [(999, 1.0, 2.0)]
    got = H.correlation_test(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()
    assert len(got) == 201 and all(r.pearson_p is None and r.spearman_p is None for r in got)


def test_probabilities_settle_or_are_null():
    assert P.gamma_upper(5e7, 5e7) == pytest.approx(0.5, abs=1e-4)
    assert math.isnan(P.t_upper(1.0, 0.0))
    start = time.time()
    assert 0 < P.exact_u_upper(4.6e6, 8, 1_000_000) < 0.5 and time.time() - start < 10
    assert P.exact_u_upper(0, 3, 4) == 1.0 and P.exact_u_upper(12, 3, 4) == pytest.approx(1 / 35)
    assert P.exact_u_upper(6, 3, 4) + P.exact_u_upper(7, 3, 4) == pytest.approx(1.0)


def test_lengths_must_be_positive(spark):
    edges = spark.createDataFrame([("a", "b", 0.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    one = spark.createDataFrame([("a",)], "node string")
    with pytest.raises(ValueError):
        G.subset_betweenness(edges, one, one)
    with pytest.raises(ValueError):
        G.steiner_trees(edges, one.withColumn("grp", F.lit(0)))


def test_parallel_strengths_add_up(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("a", "c", 3.0)], "src string, dst string, weight double")
    hub = spark.createDataFrame([("x", "a")], "seed_set string, node string")
    got = {r.node: r.probability for r in G.random_walk(edges, hub, zeros=False).collect()}
    assert got["b"] == pytest.approx(got["c"])


def test_every_gene_is_in_the_moderated_table(spark):
    rows = [(f"g{k}", 0.1 * k, 8.0 + k, 0.2 + 0.01 * k, 6, 0.6, True) for k in range(30)]
    rows += [("zero", 0.5, 9.0, 0.0, 6, 0.6, True), ("gap", None, None, None, 6, 0.6, False)]
    df = spark.createDataFrame(rows, "gene string, log_fc double, ave_expr double, s2 double, df long, stdev double, complete boolean")
    got = {r.gene: r for r in L.top_table(L.moderated(df, trend_bins=2)).collect()}
    assert len(got) == 32 and got["gap"].p is None and got["gap"].p_adj is None
    assert 0 < got["zero"].p <= got["zero"].p_adj <= 1


def test_first_rows_without_keys_are_cut_in_the_tasks(spark):
    df = spark.range(0, 10_000, 1, 8)
    top = top_rows(df, [], [F.desc("id")], 3)
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r["rank"]) for r in top.orderBy("rank").collect()] == [(9999, 1), (9998, 2), (9997, 3)]


def test_a_model_stored_twice_is_there_once(spark, tmp_path):
    model = spark.createDataFrame([("m1", 1), ("m2", 2)], "model_id string, seed int")
    registry.save_models({"model": model}, str(tmp_path))
    registry.save_models({"model": model.where("seed = 2").withColumn("seed", F.lit(5))}, str(tmp_path))
    got = registry.load_models(spark, str(tmp_path))["model"]
    assert sorted((r.model_id, r.seed) for r in got.collect()) == [("m1", 1), ("m2", 5)] and got.columns == ["model_id", "seed"]
