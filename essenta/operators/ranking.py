"""De-duplication, quantile groups and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.functions.columns import signed_log
from essenta.operators.order import attach, quantiles


def first_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in a total order.

    A minimum of a struct combines map-side, so no group is sorted or even moved whole.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def once_only(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur exactly once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == 1).drop("_c")


def quartile_label(x: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Right-closed groups, the lowest value belongs to Q1; a missing value (null or NaN) has no group."""
    missing = x.isNull() | F.isnan(x.cast("double"))
    return F.when(missing, None).when(x <= q1, "Q1").when(x <= q2, "Q2").when(x <= q3, "Q3").otherwise("Q4")


def quartiles(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "quartile") -> DataFrame:
    """Equal-frequency groups on linearly interpolated edges (not ``ntile``)."""
    edges = quantiles(df, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    return attach(df, edges, keys).withColumn(
        out, quartile_label(F.col(value), F.col("_q1"), F.col("_q2"), F.col("_q3"))).drop("_q1", "_q2", "_q3")


def z_score(
    df: DataFrame, keys: Sequence[str], value: str = "value", ddof: int = 1, out: str = "z"
) -> DataFrame:
    """(x - mean) / sd per key; sample sd for ``ddof=1``, population sd for 0. Constant -> null."""
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), sd.alias("_sd"))
    return attach(df, stats, keys).withColumn(
        out, (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd")


def min_max(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    stats = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    return attach(df, stats, keys).withColumn(
        out, (F.col(value) - F.col("_low")) / span).drop("_low", "_high")


def robust_scale(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    """Signed log of the distance to the median in interquartile ranges."""
    q = quantiles(df, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    spread = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1e-8))
    return attach(df, q, keys).withColumn(
        out, signed_log((F.col(value) - F.col("_q2")) / spread)).drop("_q1", "_q2", "_q3")
