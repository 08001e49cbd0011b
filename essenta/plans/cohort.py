"""Pseudobulk cohorts: score control samples, split, compare with drug response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.functions.columns import parse_sample_id
from essenta.operators.filters import median_split
from essenta.operators.ranking import z_score
from essenta.operators.scores import mean_per_line, score_cohort
from essenta.operators.statistics import correlation_test, mann_whitney
from essenta.session import cut


def sample_table(samples: DataFrame, **patterns) -> DataFrame:
    """Parsed sample ids: ``(sample, treatment, plate, conc, cell_line)``."""
    parsed = parse_sample_id(F.col("sample"), **patterns)
    return samples.select("sample").distinct().select("sample", *[e.alias(n) for n, e in parsed.items()])


def line_scores(
    expression: DataFrame, influence: DataFrame, samples: DataFrame, control: str = "DMSO", standardise: bool = False
) -> DataFrame:
    """Control samples scored, averaged per cell line over plates, split strictly above the median."""
    chosen = samples.where(F.col("treatment") == control)
    rows = expression.join(chosen.select("sample"), "sample", "left_semi")
    # one row per line; the median and its size check read it
    per_line = cut(mean_per_line(score_cohort(rows, influence, standardise=standardise), chosen))
    return median_split(per_line, "scaled_score", strict=True, out="group")


def score_against_response(lines: DataFrame, ic50: DataFrame) -> DataFrame:
    """Correlation of score and response, and the U test of high against low lines, one row."""
    both = lines.join(ic50.select("cell_line", F.col("value").alias("ic50")), "cell_line").withColumn("_k", F.lit(1))
    both = cut(both)
    related = correlation_test(both, ["_k"], "scaled_score", "ic50")
    tested = mann_whitney(both, ["_k"], "group", "ic50", "high", "low")
    return related.join(tested, "_k").drop("_k")


def pathway_panel(
    expression: DataFrame, samples: DataFrame, genes: DataFrame, scores: DataFrame
) -> DataFrame:
    """Mean expression per line and condition for a gene list, z-scored per gene, with the line's score."""
    rows = expression.join(F.broadcast(genes.select("gene").distinct()), "gene", "left_semi").join(
        samples.select("sample", "cell_line", "treatment"), "sample")
    means = rows.groupBy("gene", "cell_line", "treatment").agg(F.avg("value").alias("mean"))
    scaled = z_score(means, ["gene"], "mean")
    return scaled.join(scores.select("cell_line", "scaled_score"), "cell_line")
