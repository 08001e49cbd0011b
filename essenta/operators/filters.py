"""Selection, validation, renaming and cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.functions import columns as C
from essenta.operators.order import attach, median, quantiles


def response(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of one response without missing values."""
    return df.where((F.col(key) == name) & F.col("value").isNotNull() & ~F.isnan("value"))


def complete_cases(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Rows of the samples that hold a value for every given name."""
    wanted = df.where(F.col(key).isin(list(names)) & F.col("value").isNotNull())
    full = wanted.groupBy("sample").agg(F.countDistinct(key).alias("_k")).where(F.col("_k") == len(set(names)))
    return wanted.join(full.select("sample"), "sample", "left_semi")


def validate_pairs(
    pairs: DataFrame, samples: DataFrame, ic50: DataFrame, dependency: DataFrame, few: int = 200
) -> DataFrame:
    """One status row per (drug, target): unknown names, no common sample, too few, ok."""
    known = samples.select("sample").distinct()
    drugs = ic50.select("drug").distinct().withColumn("_d", F.lit(True))
    targets = dependency.select(F.col("gene").alias("target")).distinct().withColumn("_t", F.lit(True))
    tested = ic50.join(known, "sample", "left_semi").select("drug", "sample").distinct()
    scored = dependency.join(known, "sample", "left_semi").select(
        F.col("gene").alias("target"), "sample").distinct()
    common = (
        pairs.join(tested, "drug").join(scored, ["target", "sample"])
        .groupBy("drug", "target").agg(F.count(F.lit(1)).alias("_c"))
    )
    out = pairs.join(drugs, "drug", "left").join(targets, "target", "left").join(common, ["drug", "target"], "left")
    n = F.coalesce("_c", F.lit(0))
    status = (
        F.when(F.col("_d").isNull(), "unknown drug")
        .when(F.col("_t").isNull(), "unknown target")
        .when(n == 0, "no common sample")
        .when(n < few, "few samples")
        .otherwise("ok")
    )
    return out.select("drug", "target", n.cast("long").alias("n_samples"), status.alias("status"))


def resolve_alias(features: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Map feature names to wanted names through alias rows ``(target, alias)``.

    Only wanted names that are missing are looked up. An alias goes to one target (the
    first by name); several aliases of one target all take its name and are averaged
    later. Returns ``(gene, target)``.
    """
    present = features.select("gene").distinct()
    missing = wanted.select(F.col("gene").alias("target")).distinct().join(
        present.withColumnRenamed("gene", "target"), "target", "left_anti")
    hits = (
        aliases.where(F.col("alias").isNotNull())
        .join(missing, "target", "left_semi")
        .join(present.withColumnRenamed("gene", "alias"), "alias", "left_semi")
    )
    return hits.groupBy(F.col("alias").alias("gene")).agg(F.min("target").alias("target"))


def rename_features(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply a ``(gene, target)`` mapping, unmapped names stay."""
    return df.join(mapping, "gene", "left").withColumn("gene", F.coalesce("target", "gene")).drop("target")


def median_split(
    df: DataFrame, value: str, keys: Sequence[str] = (), strict: bool = False, out: str = "group"
) -> DataFrame:
    """``high`` / ``low`` against the exact median; ``strict`` decides where the median itself goes."""
    cut = median(df, keys, value, "_median")
    return attach(df, cut, keys).withColumn(out, C.high_low(F.col(value), F.col("_median"), strict)).drop("_median")


def clip_quantiles(
    df: DataFrame, value: str, low: float = 0.01, high: float = 0.9, keys: Sequence[str] = (), out: str = "clipped"
) -> DataFrame:
    bounds = quantiles(df, keys, value, {"_low": low, "_high": high})
    return attach(df, bounds, keys).withColumn(
        out, C.clip(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def keep_filled(df: DataFrame, key: str, minimum: int, other: str) -> DataFrame:
    """Rows whose ``key`` has non-zero counts for at least ``minimum`` distinct ``other``."""
    seen = df.where(F.col("count") > 0).select(key, other).distinct()
    ok = seen.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= minimum)
    return df.join(ok.select(key), key, "left_semi")
