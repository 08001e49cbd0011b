"""Feature lists per drug as one plan over all drugs and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.operators.aggregates import name_lists
from essenta.operators.joins import explode_targets
from essenta.operators.statistics import spearman
from essenta.operators.topk import feature_set, top_features
from essenta.session import cut


def same_samples(df: DataFrame, key: str) -> bool:
    """True when every key has a value for the same samples."""
    per = df.where(F.col("value").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least, most = per.agg(F.min("_n"), F.max("_n")).first()
    return least == most and df.select("sample").distinct().count() == most


def feature_lists(
    expression: DataFrame, dependency: DataFrame, drug_target: DataFrame, ic50: DataFrame,
    k: int = 100, least: int = 20,
) -> DataFrame:
    """Sorted feature list per drug ``(drug, part, names, n)``.

    Features: top ``k`` by rank correlation with the dependency on each target, top ``k``
    with the drug's response, and the targets themselves. A drug with no targets or fewer
    than ``least`` responses has no list at all. Correlations are computed once per
    target, not once per drug.
    """
    pairs = explode_targets(drug_target)
    enough = ic50.where(F.col("value").isNotNull()).groupBy("drug").agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("drug")
    pairs = pairs.join(enough, "drug", "left_semi")
    targets = pairs.select(F.col("target").alias("gene")).distinct()
    scores = dependency.join(targets, "gene", "left_semi").withColumnRenamed("gene", "target")
    # without gaps in the dependency table, all targets share one ranking of the features
    within = [] if same_samples(scores, "target") else ["target"]
    # k rows per target or drug; the list and its size check read them
    by_target = cut(top_features(
        spearman(expression, scores, ["target"], within, drop_constant=True), ["target"], k))
    responses = ic50.join(pairs.select("drug").distinct(), "drug", "left_semi")
    by_drug = cut(top_features(
        spearman(expression, responses, ["drug"], ["drug"], drop_constant=True), ["drug"], k))
    found = pairs.join(by_target.select("target", "gene"), "target").select("drug", "gene").unionByName(
        by_drug.select("drug", "gene"))
    own = pairs.select("drug", F.col("target").alias("gene"))
    return name_lists(feature_set(found, ["drug"], own), "drug", "gene")
