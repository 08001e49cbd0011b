"""Packed rank correlation against the windowed one, long chains, neighbours by demand."""

import random

from pyspark.sql import functions as F

from essenta.operators import graph as G
from essenta.operators import statistics as S
from essenta.session import SPLIT_ROWS_CONF


def test_packed_ranks_equal_windowed_ranks(spark, monkeypatch):
    rng = random.Random(2)
    genes = [("g%d" % j, "s%d" % k, None if rng.random() < 0.1 else float(rng.randint(0, 9)) if j else 1.0) for j in range(5) for k in range(60)]
    x = spark.createDataFrame(genes, "gene string, sample string, value double")
    rows = [(m, d, "s%d" % k, float(rng.randint(0, 6))) for m in "ab" for d in "xyz" for k in range(55) if rng.random() < (0.9 if m == "a" else 0.8)]
    y = spark.createDataFrame(rows + [("c", "x", "other", 1.0), ("a", "x", "s59", None)], "m string, d string, sample string, value double")

    def result(drop):
        out = S.spearman(x, y, ["m", "d"], ["m"], drop_constant=drop)
        assert out.columns == ["m", "d", "gene", "rho", "n"]
        return sorted((r.m, r.d, r.gene, None if r.rho is None else round(r.rho, 12), r.n) for r in out.collect())

    monkeypatch.setattr(S, "_BLOCK", 130)  # two responses per pass
    packed = result(False), result(True)
    spark.conf.set(SPLIT_ROWS_CONF, "40")
    try:
        windowed = result(False), result(True)
        assert [r for r in packed[0] if r not in windowed[0]] == [r for r in windowed[0] if r not in packed[0]]
        assert packed == windowed
    finally:
        spark.conf.unset(SPLIT_ROWS_CONF)
    assert any(r[3] is None for r in packed[0]) and not any(r[3] is None for r in packed[1])


def test_no_common_samples(spark):
    x = spark.createDataFrame([("g", "s", 1.0)], "gene string, sample string, value double")
    y = spark.createDataFrame([("a", "t", 1.0)], "m string, sample string, value double")
    assert S.spearman(x, y, ["m"], ["m"]).collect() == []


def test_paths_on_a_chain(spark):
    n = 25
    edges = spark.range(n).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    source = spark.createDataFrame([("n0",), ("n0",), ("none",)], "node string")
    got = G.hop_paths(edges, source)
    assert got.columns == ["source", "node", "distance", "n_paths", "path"]
    assert {r.node: (r.distance, r.n_paths) for r in got.collect()} == {f"n{k}": (k, 1.0) for k in range(n + 1)}


def test_walks_in_passes(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * 3 + 1) % 11}", 1.0 + k) for k in range(11)], "src string, dst string, weight double")
    hubs = spark.createDataFrame([(s, f"n{(ord(s) * 5) % 11}") for s in "abcde"], "seed_set string, node string")
    one = {(r.seed_set, r.node): r.probability for r in G.random_walk(edges, hubs, tol=1e-4).collect()}
    two = {(r.seed_set, r.node): r.probability for r in G.random_walk(edges, hubs, tol=1e-4, per_pass=2).collect()}
    assert one.keys() == two.keys() and len(one) == 5 * 11
    assert all(abs(one[k] - two[k]) < 1e-12 for k in one)
