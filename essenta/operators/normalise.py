"""Library-size normalisation of counts in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.operators.order import attach, average_rank, pick_quantiles, running
from essenta.operators.ranking import first_row
from essenta.session import cut

# Trimmed share of the log ratios and of the mean intensities.
RATIO_TRIM = 0.3
INTENSITY_TRIM = 0.05


def _positive(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0.0))


def library_size(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("count").cast("double").alias("library"))


def log_cpm(counts: DataFrame, keys: Sequence[str] = ("sample",), factors: DataFrame | None = None) -> DataFrame:
    """``log2((count + 0.5) / (library * factor + 1) * 1e6)`` for the counts that occur."""
    sizes = _scaled_sizes(counts, keys, factors)
    e = F.log2((F.col("count") + 0.5) / (F.col("library") + 1) * 1e6)
    return counts.join(sizes, list(keys)).withColumn("e", e).drop("library")


def log_cpm_background(counts: DataFrame, keys: Sequence[str] = ("sample",), factors: DataFrame | None = None) -> DataFrame:
    """The value an absent (zero) count has in each sample; keeps the matrix sparse."""
    sizes = _scaled_sizes(counts, keys, factors)
    return sizes.select(*keys, F.log2(F.lit(0.5) / (F.col("library") + 1) * 1e6).alias("value"))


def _scaled_sizes(counts: DataFrame, keys: Sequence[str], factors: DataFrame | None) -> DataFrame:
    sizes = library_size(counts, keys)
    if factors is None:
        return sizes
    return sizes.join(factors, list(keys)).select(*keys, (F.col("library") * F.col("factor")).alias("library"))


def depth_normalise(counts: DataFrame, keys: Sequence[str], target: float = 1e4) -> DataFrame:
    """Scale each cell to the same total, then natural ``log1p``."""
    sizes = library_size(counts, keys).where("library > 0")
    return counts.join(sizes, list(keys)).withColumn(
        "value", F.log1p(F.col("count") / F.col("library") * target)).drop("library")


def upper_quartiles(counts: DataFrame) -> DataFrame:
    """Per sample the library size and the 75 % quantile with absent genes counted as 0."""
    present = counts.where("count > 0")
    genes = present.select("gene").distinct().agg(F.count(F.lit(1)).alias("_genes"))
    seen = present.groupBy("sample").agg(F.count(F.lit(1)).alias("_seen"))
    zeros = attach(seen, genes).select(
        "sample", F.lit(0.0).alias("_x"), (F.col("_genes") - F.col("_seen")).alias("_c")).where("_c > 0")
    values = present.groupBy("sample", F.col("count").cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    counted = running(values.unionByName(zeros), ["sample"], ["_x"], sums={"_before": "_c"}, totals={"_n": "_c"})
    quarter = pick_quantiles(counted, ["sample"], "_x", {"q75": 0.75})
    return quarter.join(library_size(present, ["sample"]), "sample").withColumn("share", F.col("q75") / F.col("library"))


def trimmed_mean_factors(counts: DataFrame) -> DataFrame:
    """Trimmed mean of log ratios against the sample whose upper quartile is most typical.

    Rows ``(sample, gene, count)``; returns ``(sample, factor)`` with geometric mean 1.
    """
    per = cut(upper_quartiles(counts))
    typical = attach(per, per.agg(F.avg("share").alias("_mean")))
    chosen = first_row(
        typical.select(F.lit(1).alias("_one"), "sample", "library", F.abs(F.col("share") - F.col("_mean")).alias("_gap")),
        ["_one"], F.col("_gap"), F.col("sample"))
    present = counts.where("count > 0")
    reference = present.join(chosen.select("sample", F.col("library").alias("_rn")), "sample").select(
        "gene", F.col("count").cast("double").alias("_rc"), "_rn")
    both = present.join(per.select("sample", "library"), "sample").join(reference, "gene")
    x, n, rc, rn = F.col("count").cast("double"), F.col("library"), F.col("_rc"), F.col("_rn")
    # four aggregates and orders read the ratios
    ratios = both.select(
        "sample", "gene", F.log2((x / n) / (rc / rn)).alias("_m"), ((F.log2(x / n) + F.log2(rc / rn)) / 2).alias("_a"),
        ((n - x) / n / x + (rn - rc) / rn / rc).alias("_v"))
    ratios = cut(ratios)
    ranked = average_rank(average_rank(ratios, ["sample"], "_m", "_rm"), ["sample"], "_a", "_ra")
    size = ratios.groupBy("sample").agg(F.count(F.lit(1)).alias("_k"), F.max(F.abs("_m")).alias("_far"))

    def inside(rank: str, trim: float):
        trimmed = F.floor(F.col("_k") * trim)
        return (F.col(rank) >= trimmed + 1) & (F.col(rank) <= F.col("_k") - trimmed)

    kept = ranked.join(size, "sample").withColumn(
        "_keep", inside("_rm", RATIO_TRIM) & inside("_ra", INTENSITY_TRIM))
    raw = kept.groupBy("sample").agg(
        F.sum(F.when(F.col("_keep"), F.col("_m") / _positive("_v"))).alias("_top"),
        F.sum(F.when(F.col("_keep"), 1 / _positive("_v"))).alias("_weight"), F.max("_far").alias("_far"))
    raw = raw.select("sample", F.when(F.col("_far") < 1e-6, F.lit(1.0)).otherwise(
        F.coalesce(F.pow(F.lit(2.0), F.col("_top") / _positive("_weight")), F.lit(1.0))).alias("_f"))
    centre = raw.agg(F.exp(F.avg(F.log("_f"))).alias("_g"))
    return attach(raw, centre).select("sample", (F.col("_f") / F.col("_g")).alias("factor"))
