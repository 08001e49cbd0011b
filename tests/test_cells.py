import numpy as np
import pytest
from pyspark.sql import functions as F

from essenta.operators import cells as S
from essenta.operators import linear_models as L
from essenta.operators import normalise as N


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(8)
    return rng.poisson(rng.gamma(1.0, 3.0, size=30), size=(50, 30)).astype(float)


@pytest.fixture(scope="module")
def counts(spark, dense):
    rows = [("p", f"c{i:02d}", f"g{j:02d}", int(dense[i, j])) for i in range(50) for j in range(30) if dense[i, j] > 0]
    return spark.createDataFrame(rows, "plate string, cell string, gene string, count long").cache()


def test_moments_count_absent_zeros(counts, dense):
    values = counts.withColumn("value", F.col("count").cast("double"))
    got = S.gene_moments(values, S.cell_number(counts)).toPandas().set_index("gene").sort_index()
    seen = dense.sum(0) > 0
    assert np.allclose(got["mean"], dense.mean(0)[seen]) and np.allclose(got["variance"], dense.var(0, ddof=1)[seen])


def test_components_equal_the_dense_ones(counts, dense):
    values = counts.withColumn("value", F.col("count").cast("double"))
    scaled = S.scale_genes(values, S.gene_moments(values, S.cell_number(counts)), most=2.0)
    got = S.components(scaled, counts.select("gene").distinct(), k=3).toPandas().sort_values("cell")
    keep = dense[:, dense.sum(0) > 0]
    sd = keep.std(0, ddof=1)
    z = np.minimum((keep - keep.mean(0)) / np.where(sd > 0, sd, 1), 2.0)
    z = z - z.mean(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(np.vstack(got["z"])), np.abs(z @ vt[:3].T), atol=1e-6)


def test_outliers_use_the_plate(spark):
    rows = [("p", f"c{i}", float(10 + i % 3)) for i in range(20)] + [("p", "far", 40.0), ("q", "far", 40.0), ("q", "x", 41.0), ("q", "y", 39.5)]
    df = spark.createDataFrame(rows, "plate string, cell string, m double")
    got = {(r.plate, r.cell) for r in S.mad_outlier(df, "m").where("outlier").collect()}
    assert got == {("p", "far")}


def test_neighbours_exact_and_by_trees(spark):
    rng = np.random.default_rng(6)
    z = np.vstack([rng.normal(size=(200, 4)), np.zeros((100, 4))])  # a third are copies
    df = spark.createDataFrame([(f"s{i:03d}", z[i].tolist()) for i in range(300)], "sample string, z array<double>")
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    names = np.array([f"s{i:03d}" for i in range(300)])
    first = np.array([[names[j] for j in np.lexsort((names, d[i].round(9)))[:5]] for i in range(300)])
    for cell in (2048, 40, 7):  # the same rows, however small the cells are
        got = S.nearest(df, 5, cell=cell).toPandas().sort_values(["sample", "rank"])
        assert np.allclose(got["distance"].to_numpy().reshape(300, 5), want)
        assert (got["neighbour"].to_numpy().reshape(300, 5) == first).all()
    assert S.nearest(df.limit(0)).count() == 0
    near = S.nearest_by_trees(df, 5, trees=12, leaf=80).toPandas()
    assert (near.groupby("sample").size() == 5).all() and (near["sample"] != near["neighbour"]).all()
    found = near.sort_values(["sample", "rank"])["distance"].to_numpy().reshape(300, 5)
    assert (np.isclose(found, want)).mean() > 0.8


def test_neighbours_ship_no_vector_per_asked_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(300, 16))  # nothing can be ruled out: every block is asked by all rows
    df = spark.createDataFrame([(f"s{i:03d}", z[i].tolist()) for i in range(300)], "sample string, z array<double>")
    stored, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda rows: stored.append(cut(rows)) or stored[-1])
    got = S.nearest(df, 3, cell=7).toPandas().sort_values(["sample", "rank"])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got["distance"].to_numpy().reshape(300, 3), np.sort(d, axis=1)[:, :3])
    assert max(rows.count() for rows in stored) <= 600  # 300 rows, or few (tile, cell) pairs; before: 300 x 43


def test_variable_genes_share(counts):
    values = counts.withColumn("value", F.log1p("count"))
    got = S.variable_genes(S.gene_moments(values, S.cell_number(counts)), number=3)
    assert got.count() >= 3


def test_linear_model_with_background_equals_the_dense_fit(spark, counts, dense):
    rows = counts.select(F.col("cell").alias("sample"), "gene", "count")
    e = N.log_cpm(rows).select("sample", "gene", F.col("e").alias("value"))
    bg = N.log_cpm_background(rows)
    samples = rows.select("sample").distinct().withColumn("grp", F.when(F.substring("sample", 3, 1) < "5", "a").otherwise("b"))
    design = L.design(samples, {"grp": ["a", "b"]})
    got = L.coefficient(L.fit(e, design, bg), design, "grpb").toPandas().set_index("gene").sort_index()
    y = np.log2((dense + 0.5) / (dense.sum(1, keepdims=True) + 1) * 1e6)
    x = np.column_stack([np.ones(50), [float(i % 10 >= 5) for i in range(50)]])
    seen = dense.sum(0) > 0
    beta, rss, *_ = np.linalg.lstsq(x, y[:, seen], rcond=None)
    assert np.allclose(got["log_fc"], beta[1]) and np.allclose(got["s2"], rss / 48) and got["complete"].all()
    assert np.allclose(got["ave_expr"], y[:, seen].mean(0))


def test_contrast_needs_known_columns(spark):
    samples = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "a")], "sample string, f string")
    design = L.design(samples, {"f": ["a", "b"]}, intercept=False)
    assert design.names == ["fa", "fb"]
    rows = spark.createDataFrame([("s1", "g", 1.0), ("s2", "g", 5.0), ("s3", "g", 3.0), ("s1", "h", 1.0)], "sample string, gene string, value double")
    out = {r.gene: r for r in L.contrast(L.fit(rows, design), design, {"fb": 1, "fa": -1}).collect()}
    assert out["g"].log_fc == pytest.approx(3.0) and out["g"].complete and not out["h"].complete
    with pytest.raises(ValueError):
        L.contrast(L.fit(rows, design), design, {"nope": 1.0})


def test_special_values():
    assert L.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert L.trigamma(1.0) == pytest.approx(np.pi**2 / 6, abs=1e-8)
    assert L.trigamma(L.inverse_trigamma(0.37)) == pytest.approx(0.37, rel=1e-9)


def test_moderated_t_shrinks_towards_the_prior(spark):
    rng = np.random.default_rng(12)
    genes = [(f"g{i:03d}", float(rng.normal()), float(rng.normal(8)), float(0.5 * rng.chisquare(10) / 10 * rng.gamma(3) / 3), 10, 0.6, True) for i in range(300)]
    df = spark.createDataFrame(genes, "gene string, log_fc double, ave_expr double, s2 double, df long, stdev double, complete boolean")
    out = L.moderated(df, trend_bins=1).toPandas()
    low, high = np.minimum(out["s2"], out["s2_prior"]), np.maximum(out["s2"], out["s2_prior"])
    assert out["s2_post"].between(low, high).all() and out["df_total"].nunique() == 1 and out["df_total"][0] > 10
    assert np.allclose(out["t"], out["log_fc"] / (np.sqrt(out["s2_post"]) * 0.6))
    table = L.top_table(L.moderated(df, trend_bins=1), 10).toPandas()
    assert len(table) == 10 and table["p"].is_monotonic_increasing and (table["p_adj"] >= table["p"]).all()
    assert table["b"].iloc[0] == out["b"].max()


def test_norm_factors_have_geometric_mean_one(spark, counts):
    f = N.trimmed_mean_factors(counts.select(F.col("cell").alias("sample"), "gene", "count")).toPandas()["factor"]
    assert np.log(f).mean() == pytest.approx(0) and len(f) == 50
    same = spark.createDataFrame([(s, g, c * k) for s, k in (("a", 1), ("b", 3)) for g, c in (("x", 4), ("y", 9), ("z", 30))], "sample string, gene string, count long")
    assert np.allclose(N.trimmed_mean_factors(same).toPandas()["factor"], 1)
