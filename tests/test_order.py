import numpy as np
import pandas as pd
import pytest

from essenta.operators import order as O
from essenta.operators import ranking as E
from essenta.operators.topk import top_with_ties


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 700
    hot = rng.random(n) < 0.6  # one group and one value hold most rows
    return pd.DataFrame({
        "g": np.where(hot, "a", rng.choice(list("bcd"), n)),
        "v": np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(size=n), 1)),
        "id": np.arange(n)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_average_rank_equals_pandas(df, pdf, split, keys):
    got = O.average_rank(df, keys, "v").toPandas().sort_values("id")["rank"].to_numpy()
    want = (pdf.groupby("g")["v"] if keys else pdf["v"]).rank().to_numpy()
    assert np.allclose(got, want)


def test_ranks_sum_to_the_triangle_number(df, pdf, split):
    got = O.average_rank(df, ["g"], "v").groupBy("g").sum("rank").toPandas().set_index("g")["sum(rank)"]
    for g, n in pdf.groupby("g").size().items():
        assert got[g] == n * (n + 1) / 2


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_interpolate(df, pdf, split, keys):
    got = O.quantiles(df, keys, "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas()
    if keys:
        want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.93]).unstack()
        got = got.sort_values("g")
    else:
        want = pdf["v"].quantile([0.1, 0.5, 0.93]).to_frame().T
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_quantiles_from_ordered_counts(df, pdf):
    got = O.pick_quantiles(O.value_counts(df, ["g"], "v"), ["g"], "v", {"q": 0.3}).toPandas().set_index("g")["q"]
    assert np.allclose(got.sort_index(), pdf.groupby("g")["v"].quantile(0.3))


def test_position_is_row_number(df, pdf, split):
    got = O.position(df, ["g"], ["v", "id"]).toPandas().sort_values("id")["pos"].to_numpy()
    want = (pdf.sort_values(["v", "id"]).groupby("g").cumcount() + 1).sort_index().to_numpy()
    assert (got == want).all()


def test_running_minimum_and_total(df, pdf, split):
    rows = df.withColumn("x", (df.id * 7919) % 701)
    got = O.running(rows, ["g"], ["id"], sums={"s": "x"}, mins={"m": "x"}, totals={"t": "x"}).toPandas().sort_values("id")
    x = pdf.assign(x=(pdf["id"] * 7919) % 701)
    by = x.groupby("g")["x"]
    assert (got["s"].to_numpy() == (by.cumsum() - x["x"]).to_numpy()).all()
    assert (got["m"].to_numpy() == by.cummin().to_numpy()).all()
    assert (got["t"].to_numpy() == by.transform("sum").to_numpy()).all()


def test_ranges_are_bounded(df, spark):
    counted = df.select("g", "id")
    sizes = O.with_ranges(counted, ["g"], ["id"], 40).groupBy("g", "_range").count().toPandas()
    assert sizes["count"].max() < 160
    assert len(sizes) > 10


def test_quartiles_right_closed(df, pdf, split):
    got = E.quartiles(df, "v").toPandas().sort_values("id")["quartile"]
    edges = pdf["v"].quantile([0.25, 0.5, 0.75]).to_list()
    want = ["Q1" if v <= edges[0] else "Q2" if v <= edges[1] else "Q3" if v <= edges[2] else "Q4" for v in pdf["v"]]
    assert got.to_list() == want


def test_first_row_and_ties(df, pdf):
    first = E.first_row(df, ["g"], -df.v, df.id).toPandas().set_index("g")
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").first()
    assert first["id"].to_dict() == want["id"].to_dict()
    ties = top_with_ties(df, ["g"], "v", 2).toPandas()
    assert (ties.groupby("g")["rank"].max() <= 2).all()
    assert len(ties) == (pdf.groupby("g")["v"].rank(method="min", ascending=False) <= 2).sum()


def test_min_max_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, v double")
    assert [r.scaled for r in E.min_max(df, "v").collect()] == [None, None]


def test_robust_scale_floor(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 5)], "v double")
    got = sorted(r.scaled for r in E.robust_scale(df, "v").collect())
    q1, q3 = 1.0, 2.0
    assert got[-1] == pytest.approx(np.log10(1 + (5 - 1) / (q3 - q1)))
