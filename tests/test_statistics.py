import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from essenta.functions import probability as P
from essenta.operators import statistics as H


def test_tails_against_closed_forms():
    for t in (-3.0, -0.4, 0.0, 1.3, 8.0):
        assert P.t_upper(t, 1) == pytest.approx(0.5 - math.atan(t) / math.pi, abs=1e-12)
        assert P.t_upper(t, 2) == pytest.approx(0.5 * (1 - t / math.sqrt(2 + t * t)), abs=1e-12)
    for x in (0.1, 2.0, 15.0, 60.0):
        assert P.gamma_upper(1.0, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert P.gamma_upper(0.5, x * x / 2) == pytest.approx(math.erfc(x / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert P.beta_regularised(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)


@pytest.mark.parametrize("n1,n2", [(1, 1), (3, 4), (4, 3), (2, 7), (5, 5)])
def test_exact_u_against_enumeration(n1, n2):
    us = []
    for first in itertools.combinations(range(n1 + n2), n1):
        us.append(sum(first) + n1 - n1 * (n1 + 1) / 2)
    for u in sorted(set(us)):
        assert P.exact_u_upper(u, n1, n2) == pytest.approx(np.mean([x >= u for x in us]))


def test_tails_as_columns(spark):
    row = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "t double, d double").select(
        P.t_sf("t", "d").alias("a"), P.f_sf(F.col("t") * F.col("t"), F.lit(1.0), "d").alias("b"), P.t_two_sided("t", "d").alias("c")).collect()
    assert row[0].b == pytest.approx(row[0].c) and row[0].a == pytest.approx(row[0].c / 2)
    assert row[1].a is None


def brute_pairs(x, y):
    con = dis = tx = ty = txy = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = x[i] - x[j], y[i] - y[j]
            con, dis = con + (a * b > 0), dis + (a * b < 0)
            tx, ty, txy = tx + (a == 0), ty + (b == 0), txy + (a == 0 and b == 0)
    return con, dis, tx, ty, txy


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    k = rng.integers(0, 2, 150)
    x = rng.integers(0, 60, 150).astype(float)
    y = np.where(rng.random(150) < 0.3, 5, np.round(x + rng.normal(scale=20, size=150)))
    return pd.DataFrame({"k": k, "x": x, "y": y})


def test_pair_statistics_against_all_pairs(spark, scores, split):
    df = spark.createDataFrame(scores)
    tau = H.kendall(df, ["k"], "x", "y").toPandas().set_index("k")["tau"]
    index = H.concordance_index(df, ["k"], "y", "x").toPandas().set_index("k")["c_index"]
    for k, part in scores.groupby("k"):
        con, dis, tx, ty, txy = brute_pairs(part["x"].to_numpy(), part["y"].to_numpy())
        n0 = len(part) * (len(part) - 1) / 2
        assert tau[k] == pytest.approx((con - dis) / math.sqrt((n0 - tx) * (n0 - ty)))
        assert index[k] == pytest.approx((con + (tx - txy) / 2) / (n0 - ty))


def test_kendall_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert H.kendall(df, [], "x", "y").first().tau is None


def test_mann_whitney_exact_and_tied(spark):
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", 5.0)], "g string, v double")
    row = H.mann_whitney(small, [], "g", "v", "a", "b").first()
    assert (row.u, row.n1, row.n2, row.effect) == (0.0, 2, 3, 1.0)
    assert row.p == pytest.approx(0.2)  # 2 of 10 orders
    less = H.mann_whitney(small, [], "g", "v", "a", "b", "less").first()
    assert less.p == pytest.approx(0.1)
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    row = H.mann_whitney(tied, [], "g", "v", "a", "b").first()
    assert row.u == 0.5 and 0 < row.p < 1
    alone = H.mann_whitney(small, [], "g", "v", "a", "zzz").first()
    assert alone.n2 == 0 and alone.p is None


def test_group_matrix_equals_single_tests(spark, split):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("xyz"), 200, p=[0.7, 0.2, 0.1]), "v": np.round(rng.normal(size=200), 1)})
    df = spark.createDataFrame(pdf)
    table = H.group_test_matrix(df, "g", "v", [("x", "y"), ("y", "x"), ("y", "z")]).toPandas()
    for row in table.itertuples():
        one = H.mann_whitney(df, [], "g", "v", row.ref, row.test).first()
        assert (row.u, row.p, row.effect) == pytest.approx((one.u, one.p, one.effect))


def test_bh_against_a_loop(spark, split):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(120) ** 2, 3)
    got = H.adjust_bh(spark.createDataFrame(pd.DataFrame({"i": range(120), "p": p})), []).toPandas().sort_values("i")["p_adj"]
    order = np.argsort(p)
    want = np.empty(120)
    low = 1.0
    for rank in range(120, 0, -1):
        low = min(low, p[order[rank - 1]] * 120 / rank)
        want[order[rank - 1]] = low
    assert np.allclose(got, want)


def test_chi_square_two_by_two(spark):
    cells = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    row = H.chi_square(spark.createDataFrame(cells, "r string, c string"), "r", "c").first()
    n, gap = 65, abs(10 * 5 - 20 * 30)
    want = n * (gap - n / 2) ** 2 / (30 * 35 * 40 * 25)
    assert row.dof == 1 and row.chi2 == pytest.approx(want)
    assert row.p == pytest.approx(math.erfc(math.sqrt(want / 2)))
    assert row.v == pytest.approx(math.sqrt(want / n))


def test_chi_square_with_an_empty_cell(spark):
    cells = [("a", "x")] * 4 + [("a", "y")] * 6 + [("b", "x")] * 5 + [("b", "z")] * 5
    row = H.chi_square(spark.createDataFrame(cells, "r string, c string"), "r", "c").first()
    obs = np.array([[4, 6, 0], [5, 0, 5]], float)
    exp = np.outer(obs.sum(1), obs.sum(0)) / obs.sum()
    assert row.chi2 == pytest.approx(((obs - exp) ** 2 / exp).sum())
    assert row.p == pytest.approx(math.exp(-row.chi2 / 2))


def test_t_tests(spark):
    df = spark.createDataFrame([("k", "a", v) for v in (1.0, 2.0, 4.0)] + [("k", "b", v) for v in (2.0, 5.0, 9.0, 12.0)]
                               + [("one", "a", 1.0), ("one", "b", 2.0), ("one", "b", 3.0)], "k string, g string, v double")
    out = {r.k: r for r in H.t_test(df, ["k"], "g", "v", "a", "b", "less", pooled=True).collect()}
    a, b = np.array([1.0, 2, 4]), np.array([2.0, 5, 9, 12])
    s2 = (a.var(ddof=1) * 2 + b.var(ddof=1) * 3) / 5
    assert out["k"].t == pytest.approx((a.mean() - b.mean()) / math.sqrt(s2 * (1 / 3 + 1 / 4)))
    assert out["k"].p == pytest.approx(1 - P.t_upper(out["k"].t, 5))
    assert out["one"].t is None and out["one"].p is None
    welch = {r.k: r for r in H.t_test(df, ["k"], "g", "v", "a", "b", pooled=False).collect()}
    assert welch["k"].t == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 3 + b.var(ddof=1) / 4))
    pairs = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5), (5.0, 7.0)], "x double, y double")
    d = np.array([-1.0, -0.5, -2.0])
    assert H.paired_t(pairs, [], "x", "y").first().t == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))


def test_spearman_constant_and_tied_features(spark, split):
    rng = np.random.default_rng(0)
    n = 90
    y = rng.normal(size=n)
    genes = {"same": y, "tied": np.round(y), "flat": np.ones(n), "noise": rng.normal(size=n)}
    expr = pd.DataFrame([(f"s{i}", g, float(v[i])) for g, v in genes.items() for i in range(n)], columns=["sample", "gene", "value"])
    resp = pd.DataFrame([("r", f"s{i}", float(y[i])) for i in range(n)] + [("gap", f"s{i}", float(y[i])) for i in range(0, n, 2)],
                        columns=["response", "sample", "value"])
    out = H.spearman(spark.createDataFrame(expr), spark.createDataFrame(resp), ["response"], ["response"]).toPandas()
    got = out.set_index(["response", "gene"])["rho"]
    assert got["r", "same"] == pytest.approx(1) and np.isnan(got["r", "flat"])
    for resp_name, step in (("r", 1), ("gap", 2)):
        for g in ("tied", "noise"):
            want = pd.Series(genes[g][::step]).rank().corr(pd.Series(y[::step]).rank())
            assert got[resp_name, g] == pytest.approx(want)
    dropped = H.spearman(spark.createDataFrame(expr), spark.createDataFrame(resp), ["response"], ["response"], drop_constant=True)
    assert dropped.where("gene = 'flat'").count() == 0


def test_group_matrix_orders_every_value_once(spark, split):
    rng = np.random.default_rng(14)
    rows = [("xyzw"[int(g)], float(v)) for g, v in zip(rng.integers(0, 4, 300), rng.normal(size=300).round(1))] + [("x", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    pairs = [(a, b) for a in "xyzw" for b in "xyzw" if a != b] + [("x", "nobody"), ("nobody", "no one")]
    out = H.group_test_matrix(df, "g", "v", pairs)
    by = {g: [v for h, v in rows if h == g and v is not None] for g in "xyzw"} | {"nobody": []}
    got = {(r.ref, r.test): r for r in out.collect()}
    assert set(got) == set(pairs[:-1])
    for (a, b), r in got.items():
        assert (r.n1, r.n2) == (len(by[a]), len(by[b]))
        assert r.u == sum((v > w) + (v == w) / 2 for v in by[a] for w in by[b])
    # pairs are formed in the tasks after the order; before, every row was shuffled once per pair of its group
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and ("Window" not in plan or plan.index("Generate") < plan.index("Window"))


def test_split_correlation_ranks_both_sides_from_the_rows(spark, monkeypatch):
    from essenta.operators import order as O

    rng = np.random.default_rng(15)
    x = rng.normal(size=400).round(1)
    y = (x + rng.normal(size=400)).round(2)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    spark.conf.set("spark.essenta.splitRows", "40")
    sized, sizes = [], O.group_sizes
    monkeypatch.setattr(O, "group_sizes", lambda rows, keys: sized.append(rows._jdf.queryExecution().optimizedPlan().toString()) or sizes(rows, keys))
    try:
        got = H.correlation_test(df, ["g"], "x", "y").collect()[0]
    finally:
        spark.conf.unset("spark.essenta.splitRows")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got.n == 400 and got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    # before, the ranks of y were taken from the join with those of x, which ran again each time
    assert sized and not any("Join" in plan for plan in sized)
