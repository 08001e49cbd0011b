"""Top-k, arg-min and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from essenta.operators.order import top_rows
from essenta.operators.ranking import first_row
from essenta.session import bounded_broadcast


def top_features(corr: DataFrame, keys: Sequence[str], k: int = 100) -> DataFrame:
    """First ``k`` features by absolute correlation; missing correlations come last."""
    return top_rows(corr, keys, [F.abs("rho").desc_nulls_last(), F.col("gene")], k)


def feature_set(top: DataFrame, keys: Sequence[str], targets: DataFrame | None = None) -> DataFrame:
    """Union of the features over responses, target gene added when absent."""
    out = top.select(*keys, "gene")
    if targets is not None:
        out = out.unionByName(targets.select(*keys, "gene"))
    return out.distinct()


def extremes(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str = "gene") -> DataFrame:
    """Label every row ``top`` (n largest), ``bottom`` (n smallest) or ``normal``."""
    high = top_rows(df, keys, [F.desc(value), F.col(name)], n).select(*keys, name, F.lit("top").alias("_h"))
    low = top_rows(df, keys, [F.asc(value), F.col(name)], n).select(*keys, name, F.lit("bottom").alias("_l"))
    out = df.join(high, [*keys, name], "left").join(low, [*keys, name], "left")
    return out.withColumn("label", F.coalesce("_h", "_l", F.lit("normal"))).drop("_h", "_l")


def top_with_ties(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The n largest values per key, every row that ties with the last one kept, with its rank.

    Ranks come from the n largest distinct values and their counts, so a value that a
    third of the rows share is never sorted in one task; the rows join back on the value.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    best = top_rows(counts, keys, [F.desc(value)], n, "_k")
    above = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ranks = best.select(*keys, value, (F.coalesce(F.sum("_c").over(above), F.lit(0)) + 1).alias("rank"))
    return df.join(bounded_broadcast(ranks.where(F.col("rank") <= n)), [*keys, value])


def arg_min(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The row with the smallest value per key; ties go to the smallest name. NaN and null lose."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return first_row(usable, keys, F.col(value), F.col(name))


def in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    pairs = df.select(item, group).distinct()
    k = pairs.select(group).distinct().agg(F.count(F.lit(1)).alias("_k"))
    counted = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_c"))
    return counted.where(F.col("_c") == k.scalar()).select(item)


def overlap_regions(df: DataFrame, item: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Size of every region of 2 or 3 overlapping name lists, e.g. ``A``, ``A&B``."""
    marks = df.where(F.col(group).isin(list(groups))).groupBy(item).agg(
        *[F.max(F.col(group) == g).alias(f"_{i}") for i, g in enumerate(groups)])
    region = F.concat_ws("&", *[F.when(F.col(f"_{i}"), g) for i, g in enumerate(groups)])
    return marks.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"))


def enrichment(df: DataFrame, model: str, group: str, value: str, k: int = 3) -> DataFrame:
    """Mean inside a group minus mean outside it, first ``k`` models per group.

    Inside sums come from one aggregate; outside = all - inside, so no group is paired
    with another.
    """
    inside = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(model, group).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"))
    # a label is part of this comparison even when it is missing elsewhere
    every = df.where(F.col(value).isNotNull()).groupBy(model).agg(
        F.sum(value).alias("_all"), F.count(value).alias("_m"))
    scored = inside.join(every, model).withColumn(
        "enrichment",
        F.col("_s") / F.col("_n")
        - (F.col("_all") - F.col("_s")) / F.nullif(F.col("_m") - F.col("_n"), F.lit(0)))
    return top_rows(scored, [group], [F.col("enrichment").desc_nulls_last(), F.col(model)], k).select(
        group, model, "enrichment", "rank")


