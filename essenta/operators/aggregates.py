"""Group summaries and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.operators.order import attach, pick_quantiles, position, value_counts


def group_mean(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def mean_sd_sem(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample sd, standard error and count per group."""
    n = F.count(value)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(n)).alias("sem"), n.alias("n"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sd, min, quartiles and max.

    All come from one table of distinct values with their counts, so the quartiles and
    the moments share a pass.
    """
    counted = value_counts(df, keys, value)
    x, c = F.col(value), F.col("_c")
    quart = pick_quantiles(counted, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    moments = df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return attach(moments, quart, keys)


def cross_table(
    df: DataFrame, row: str, column: str, levels: Sequence[str]
) -> DataFrame:
    """Counts per row and column level, absent cells are 0. One column per given level."""
    table = df.groupBy(row).pivot(column, list(levels)).agg(F.count(F.lit(1)))
    return table.na.fill(0)


def levels_by_total(df: DataFrame, column: str, skip: Sequence[str] = (), most: int = 1000) -> list[str]:
    """Levels of a category ordered by falling total (column names of a cross table)."""
    totals = df.where(~F.col(column).isin(list(skip))) if skip else df
    rows = totals.groupBy(column).count().orderBy(F.desc("count"), column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels, keep the long form")
    return [r[0] for r in rows]


def name_lists(df: DataFrame, key: str, name: str, part_size: int = 100_000) -> DataFrame:
    """Sorted distinct names per key as a comma list, with its length.

    A key with more than ``part_size`` names gets several numbered parts, each a bounded
    cell; parts in order make up the whole list.
    """
    names = position(df.where(F.col(name).isNotNull()).select(key, name).distinct(), [key], [name])
    parts = names.withColumn("part", F.floor((F.col("pos") - 1) / part_size).cast("long"))
    return parts.groupBy(key, "part").agg(
        F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"),
        F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, cohort: DataFrame, drug: str = "drug", part_size: int = 100_000) -> DataFrame:
    """Per drug the sorted samples of the cohort that hold a value, and their number."""
    inside = df.where(F.col("value").isNotNull()).join(cohort.select("sample"), "sample", "left_semi")
    return name_lists(inside, drug, "sample", part_size)


def wide(df: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide for a given, short list of column names."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.first(value, ignorenulls=True))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


