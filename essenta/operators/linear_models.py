"""Per-gene linear models with a shared design, contrasts and moderated t.

A gene needs only the sums ``X'y``, ``y'y`` and its count, which combine map-side. The
design has few columns, so ``X'X`` is one row of sums and its inverse becomes constants of
the plan: no gene is moved whole and nothing is solved in Python per gene.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from essenta.functions import probability as P
from essenta.operators.order import attach, median, position
from essenta.operators.statistics import adjust_bh
from essenta.session import bounded_broadcast, cut

_MOST_COLUMNS = 64


class Design(NamedTuple):
    """Design rows ``(sample, x ARRAY<DOUBLE>)`` and the column names."""

    table: DataFrame
    names: list[str]


class Fit(NamedTuple):
    """Per-gene rows and the inverse of ``X'X``."""

    table: DataFrame
    names: list[str]
    inverse: np.ndarray


def design(samples: DataFrame, factors: dict[str, Sequence[str]], intercept: bool = True) -> Design:
    """Indicator columns of factors. The first level is the reference.

    Without an intercept the first factor has a column for every level (cell means).
    """
    names, cols = (["intercept"], [F.lit(1.0)]) if intercept else ([], [])
    for at, (factor, levels) in enumerate(factors.items()):
        for level in list(levels)[0 if at == 0 and not intercept else 1:]:
            names.append(f"{factor}{level}")
            cols.append((F.col(factor) == level).cast("double"))
    if len(names) > _MOST_COLUMNS:
        raise ValueError(f"a design of {len(names)} columns is wider than {_MOST_COLUMNS}")
    return Design(samples.select("sample", F.array(*cols).alias("x")), names)


def fit(rows: DataFrame, design: Design, background: DataFrame | None = None) -> Fit:
    """Least squares per gene on rows ``(sample, gene, value)``.

    ``background`` gives the value of absent rows per sample: its sums are shared by all
    genes, and a present row adds only its difference. Without it a gene must occur in
    every sample to be ``complete``.
    """
    q = len(design.names)
    x = [F.get("x", F.lit(i)) for i in range(q)]
    table = design.table
    if background is not None:
        table = table.join(background.select("sample", F.col("value").alias("_bg")), "sample")
    else:
        table = table.withColumn("_bg", F.lit(0.0))
    bg = F.col("_bg")
    shared = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(bg).alias("s"), F.sum(bg * bg).alias("ss"),
        *[F.sum(x[i] * bg).alias(f"b{i}") for i in range(q)],
        *[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(q) for j in range(i, q)],
    ).first()
    cross = np.array([[shared[f"x{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)], dtype=float)
    if np.linalg.matrix_rank(cross) < q:
        raise ValueError(f"the design columns {design.names} are linearly dependent")
    inverse = np.linalg.inv(cross)
    n = int(shared["n"])
    if n <= q:
        raise ValueError(f"{n} samples are too few for {q} design columns")

    y = F.col("value")
    sums = rows.join(bounded_broadcast(table), "sample").groupBy("gene").agg(
        F.count(F.lit(1)).alias("_seen"), F.sum(y - bg).alias("_s"), F.sum(y * y - bg * bg).alias("_ss"),
        *[F.sum(x[i] * (y - bg)).alias(f"_b{i}") for i in range(q)])
    b = [F.col(f"_b{i}") + float(shared[f"b{i}"]) for i in range(q)]
    beta = [sum((F.lit(float(inverse[i, j])) * b[j] for j in range(q)), F.lit(0.0)) for i in range(q)]
    fitted = sums.withColumn("coef", F.array(*beta))
    explained = sum((F.get("coef", F.lit(i)) * b[i] for i in range(q)), F.lit(0.0))
    complete = F.lit(True) if background is not None else F.col("_seen") == n
    out = fitted.select(
        "gene", ((F.col("_s") + float(shared["s"])) / n).alias("ave_expr"), "coef",
        F.greatest((F.col("_ss") + float(shared["ss"]) - explained) / (n - q), F.lit(0.0)).alias("s2"),
        F.lit(n - q).cast("long").alias("df"), complete.alias("complete"))
    return Fit(out, design.names, inverse)


def contrast(fitted: Fit, design: Design, weights: dict[str, float]) -> DataFrame:
    """A linear combination of coefficients: ``log_fc`` and its unscaled sd per gene."""
    c = np.array([weights.get(name, 0.0) for name in design.names])
    unknown = set(weights) - set(design.names)
    if unknown:
        raise ValueError(f"no design column {sorted(unknown)}")
    value = sum((F.get("coef", F.lit(i)) * float(w) for i, w in enumerate(c) if w), F.lit(0.0))
    return fitted.table.select(
        "gene", value.alias("log_fc"), "ave_expr", "s2", "df",
        F.lit(float(math.sqrt(c @ fitted.inverse @ c))).alias("stdev"), "complete")


def coefficient(fitted: Fit, design: Design, name: str) -> DataFrame:
    return contrast(fitted, design, {name: 1.0})


# Moderated t ----------------------------------------------------------------------


def digamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def inverse_trigamma(y: float) -> float:
    """Solve ``trigamma(x) = y`` by bisection on a falling function."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if trigamma(mid) > y else (low, mid)
    return math.sqrt(low * high)


@F.pandas_udf(DoubleType())
def _prior_variance(t: pd.Series, v1: pd.Series, rank: pd.Series, genes: pd.Series, share: pd.Series, dof: pd.Series) -> pd.Series:
    """Variance ratio that makes one of the largest statistics match its expected order."""

    def one(t, v1, rank, genes, share, dof):
        p0 = 2 * P.t_upper(t, dof)
        target = ((rank - 0.5) / genes - (1 - share) * p0) / share
        if not target > p0:
            return 0.0
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if P.t_upper(mid, dof) > target / 2 else (low, mid)
        return v1 * ((t / low) ** 2 - 1)

    return pd.Series([one(*row) for row in zip(t, v1, rank, genes, share, dof)], dtype="float64")


def moderated(df: DataFrame, trend_bins: int = 20, proportion: float = 0.01) -> DataFrame:
    """Moderated t, p and log odds per gene; the prior variance follows the mean expression.

    The trend of ``log s2`` is the mean per equal-count bin of mean expression (a spline in
    the usual form), in ``trend_bins`` bins or one per gene. Every gene has a row: a zero
    variance enters the prior as 1e-5 of the median one, and a gene that lacks samples has null
    statistics and no part in the adjustment.
    """
    # one row per gene; several fits of the prior read it
    every = cut(df)
    genes = every.where(F.col("complete") & F.col("s2").isNotNull())
    head = genes.agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df"), F.max("s2").alias("most")).first()
    n, d = int(head["n"]), float(head["df"] or 0)
    if n == 0 or not head["most"]:
        raise ValueError("no complete gene with a positive residual variance")
    floor = 1e-5 * (median(genes, [], "s2", "m", n).first()["m"] or head["most"])
    bins = max(1, min(trend_bins, n))
    e = F.log(F.greatest(F.col("s2"), F.lit(floor))) - digamma(d / 2) + math.log(d / 2)
    placed = position(genes, [], ["ave_expr", "gene"], "_pos").withColumns({
        "_bin": F.floor((F.col("_pos") - 1) * bins / n), "_e": e}).drop("_pos")
    trend = placed.groupBy("_bin").agg(
        F.avg("_e").alias("_mean"), F.sum((F.col("_e")) * F.col("_e")).alias("_sq"), F.count(F.lit(1)).alias("_k"))
    spread = trend.agg(
        F.sum(F.col("_sq") - F.col("_k") * F.col("_mean") * F.col("_mean")).alias("v"),
        F.count(F.lit(1)).alias("b")).first()
    excess = (spread["v"] / max(n - spread["b"], 1)) - trigamma(d / 2)
    d0 = 2 * inverse_trigamma(excess) if excess > 0 else math.inf
    back = digamma(d0 / 2) - math.log(d0 / 2) if math.isfinite(d0) else 0.0
    prior = F.exp(F.col("_mean") + back)
    total = min(d + d0, n * d)
    post = (d0 * prior + d * F.col("s2")) / (d0 + d) if math.isfinite(d0) else prior
    out = placed.join(F.broadcast(trend.select("_bin", "_mean")), "_bin").withColumns({
        "s2_prior": prior, "s2_post": post}).drop("_bin", "_mean", "_e")
    out = out.withColumn("t", F.col("log_fc") / (F.sqrt("s2_post") * F.col("stdev"))).withColumns({
        "df_total": F.lit(float(total)), "p": P.t_two_sided("t", F.lit(float(total)))})

    wanted = math.ceil(proportion / 2 * n)
    share = max(wanted / n, proportion)
    largest = position(out.withColumn("_down", -F.abs("t")), [], ["_down", "gene"], "_rank").where(F.col("_rank") <= wanted)
    middle = float(trend.agg(F.median(prior)).first()[0])
    v0 = _prior_variance(
        F.abs("t"), F.col("stdev") * F.col("stdev"), F.col("_rank").cast("double"), F.lit(float(n)),
        F.lit(float(share)), F.lit(float(total)))
    bounded = F.least(F.greatest(v0, F.lit(0.01 / middle)), F.lit(16.0 / middle))
    variance = largest.agg(F.avg(bounded).alias("_v0"))
    ratio = (F.col("stdev") * F.col("stdev") + F.col("_v0")) / (F.col("stdev") * F.col("stdev"))
    t2 = F.col("t") * F.col("t")
    kernel = (1 + total) / 2 * F.log((t2 + total) / (t2 / ratio + total))
    odds = math.log(proportion / (1 - proportion))
    tested = attach(out, variance).withColumn("b", odds - F.log(ratio) / 2 + kernel).drop("_v0")
    return tested.unionByName(every.where(~(F.col("complete") & F.col("s2").isNotNull())), allowMissingColumns=True)


def top_table(df: DataFrame, number: int | None = None) -> DataFrame:
    """Full result sorted by p with Benjamini-Hochberg adjustment, or its first rows."""
    out = adjust_bh(df, [], "p", "p_adj").select("gene", "log_fc", "ave_expr", "t", "p", "p_adj", "b").orderBy(F.asc_nulls_last("p"), "gene")
    return out if number is None else out.limit(number)
