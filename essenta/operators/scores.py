"""Gene influence, benefit scores and everything built on fitted models.

Model tables: ``model_weight(model_id, gene, w ARRAY, mean, sd)`` and
``model_head(model_id, response, h ARRAY, mean)``; matrices are long rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.functions.columns import dot, norm
from essenta.operators.filters import rename_features, resolve_alias
from essenta.operators.factor_model import sum_arrays, vector_moments
from essenta.operators.joins import product
from essenta.operators.order import attach, position
from essenta.operators.ranking import min_max, z_score
from essenta.operators.statistics import corr, correlation_test, regression_metrics
from essenta.operators.topk import in_all
from essenta.session import bounded_broadcast, cut

KEY_GROUP = "keyCluster"


# Influence ------------------------------------------------------------------------


def gene_influence(weights: DataFrame, heads: DataFrame) -> DataFrame:
    """``W h`` per (model, response, gene)."""
    h = heads.select("model_id", "response", "h")
    return weights.select("model_id", "gene", "w").join(h, "model_id").select(
        "model_id", "response", "gene", dot(F.col("w"), F.col("h")).alias("influence"))


def influence_table(weights: DataFrame, heads: DataFrame, dependency: str = "dep", drug: str = "ic50") -> DataFrame:
    """Dependency, drug and combined influence per gene; combined is z-scored by population sd."""
    per = gene_influence(weights, heads).groupBy("model_id", "gene").agg(
        F.max(F.when(F.col("response") == dependency, F.col("influence"))).alias("dep_inf"),
        F.max(F.when(F.col("response") == drug, F.col("influence"))).alias("ic50_inf"))
    both = per.withColumn("combined_inf", F.col("dep_inf") - F.col("ic50_inf"))
    return z_score(both, ["model_id"], "combined_inf", ddof=0, out="scaled_combined")


def unit_influence(weights: DataFrame, heads: DataFrame, dependency: str = "dep", drug: str = "ic50") -> DataFrame:
    """Influence of unit-norm heads: dependency effect, negative drug effect, total."""
    unit = heads.withColumn("_n", norm(F.col("h"))).select(
        "model_id", "response", F.transform("h", lambda x: x / F.nullif(F.col("_n"), F.lit(0.0))).alias("h"))
    per = gene_influence(weights, unit).groupBy("model_id", "gene").agg(
        F.max(F.when(F.col("response") == dependency, F.col("influence"))).alias("dependency_effect"),
        F.max(F.when(F.col("response") == drug, -F.col("influence"))).alias("ic50_effect"))
    return per.withColumn("total_influence", F.col("dependency_effect") + F.col("ic50_effect"))


def influence_by_drug(weights: DataFrame, heads: DataFrame) -> DataFrame:
    """Influence per drug, standardised per drug with population sd."""
    return z_score(gene_influence(weights, heads), ["model_id", "response"], "influence", ddof=0, out="scaled")


# Scores and predictions -----------------------------------------------------------


def benefit_score(rows: DataFrame, influence: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Expression times scaled influence per sample: raw and min-max scaled per model."""
    keys = list(keys)
    weight = influence.select(*keys, "gene", F.col("scaled_combined").alias("weight"))
    joined = rows.join(bounded_broadcast(weight), ["gene", *[k for k in keys if k in rows.columns]])
    raw = joined.groupBy(*keys, "sample").agg(F.sum(F.col("value") * F.col("weight")).alias("raw_score"))
    return min_max(raw, "raw_score", keys, "scaled_score")


def predict(rows: DataFrame, tables: dict[str, DataFrame], raw_scale: bool = False) -> DataFrame:
    """Predicted responses ``Z h`` per (model, response, sample).

    ``rows`` are scaled with the model's own mean and sd. One join with ``W h`` replaces
    the latent coordinates. ``raw_scale`` adds the training mean back.
    """
    beta = gene_influence(tables["model_weight"], tables["model_head"])
    keys = ["model_id", "gene"] if "model_id" in rows.columns else ["gene"]
    out = rows.join(bounded_broadcast(beta), keys).groupBy("model_id", "response", "sample").agg(
        F.sum(F.col("value") * F.col("influence")).alias("prediction"))
    if raw_scale:
        mean = tables["model_head"].select("model_id", "response", F.col("mean").alias("_mean"))
        out = out.join(bounded_broadcast(mean), ["model_id", "response"]).withColumn(
            "prediction", F.col("prediction") + F.col("_mean")).drop("_mean")
    return out


def difference_score(predictions: DataFrame, dependency: str = "dep", drug: str = "ic50") -> DataFrame:
    """Predicted dependency minus predicted drug response, raw and min-max scaled."""
    p = F.col("prediction")
    raw = predictions.groupBy("model_id", "sample").agg(
        (F.max(F.when(F.col("response") == dependency, p)) - F.max(F.when(F.col("response") == drug, p))).alias("raw_score"))
    return min_max(raw, "raw_score", ["model_id"], "scaled_score")


def latent(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Latent coordinates ``(model_id, sample, z ARRAY)`` of scaled or raw expression rows.

    The products of one sample are added per coordinate with map-side combine; only the
    short vector of coordinates is collected.
    """
    keys = ["model_id", "gene"] if "model_id" in rows.columns else ["gene"]
    parts = rows.join(bounded_broadcast(weights.select("model_id", "gene", "w")), keys).select(
        "model_id", "sample", "value", F.posexplode("w").alias("dim", "w"))
    sums = parts.groupBy("model_id", "sample", "dim").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    return sums.groupBy("model_id", "sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda e: e["z"]).alias("z"))


def model_metrics(predicted: DataFrame, digits: int = 5) -> DataFrame:
    """Pearson, Spearman and MSE per (model, response, split); ``value`` is the truth."""
    keys = ["model_id", "response", "split"]
    tests = correlation_test(predicted, keys, "value", "prediction")
    errors = regression_metrics(predicted, keys, "value", "prediction").select(*keys, "mse")
    return tests.join(errors, keys).select(
        *keys, "n", *[F.round(c, digits).alias(c) for c in ("pearson", "spearman", "mse")])


def score_cohort(
    cohort: DataFrame, influence: DataFrame, aliases: DataFrame | None = None, standardise: bool = True,
) -> DataFrame:
    """Score an outside cohort ``(sample, gene, value)`` with saved influence ``(gene, scaled_combined)``.

    Missing names are resolved through aliases, duplicates averaged, shared genes kept,
    each gene z-scored over the cohort (or taken as is), then summed and min-max scaled.
    """
    rows = cohort
    if aliases is not None:
        rows = rename_features(rows, resolve_alias(rows, aliases, influence))
    weight = influence.select("gene", F.col("scaled_combined").alias("weight"))
    shared = rows.join(weight.select("gene"), "gene", "left_semi").groupBy("sample", "gene").agg(
        F.avg("value").alias("value"))
    if standardise:
        shared = z_score(shared, ["gene"], out="_z").select(
            "sample", "gene", F.coalesce("_z", F.lit(0.0)).alias("value"))
    raw = product(shared, weight, ["sample"], out="raw_score")
    return min_max(raw, "raw_score", [], "scaled_score")


def mean_per_line(scores: DataFrame, lines: DataFrame, line: str = "cell_line") -> DataFrame:
    """Average score per cell line over its samples (plates)."""
    return scores.join(lines.select("sample", line), "sample").groupBy(line).agg(
        F.avg("raw_score").alias("raw_score"), F.avg("scaled_score").alias("scaled_score"), F.count(F.lit(1)).alias("n"))


# Refit on a frozen W --------------------------------------------------------------


def _refit(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in pdf.itertuples(index=False):
        d, p = int(row.d), len(row.w)
        w = np.vstack(row.w)
        a = {"train": np.reshape(row.a_train, (d, d)), "test": np.reshape(row.a_test, (d, d))}
        sw = a["train"][:p, :p] @ w
        solve = np.linalg.pinv(w.T @ sw + 1e-6 * np.eye(w.shape[1]), hermitian=True)
        for at, name in enumerate(row.responses):
            h = solve @ (w.T @ a["train"][:p, p + at])
            b = w @ h
            for split, m in a.items():
                n, y = m[-1, -1], p + at
                mean_p, mean_y = b @ m[:p, -1] / n, m[y, -1] / n
                cov = b @ m[:p, y] / n - mean_p * mean_y
                var_p, var_y = b @ m[:p, :p] @ b / n - mean_p**2, m[y, y] / n - mean_y**2
                r = cov / np.sqrt(var_p * var_y) if var_p > 0 and var_y > 0 else None
                out.append((row.model_id, name, split, r, h.tolist()))
    return pd.DataFrame(out, columns=["model_id", "response", "split", "r", "h"])


def refit_heads(table: DataFrame, weights: DataFrame) -> DataFrame:
    """Ridge heads on a frozen ``W`` per model of a moment table, with train and test correlation.

    One model id per (model, seed): the moment table then holds one split each.
    """
    def part(test: bool) -> DataFrame:
        rows = table.where("fold < 0" if test else "fold >= 0").groupBy("model_id", "d", "genes", "responses").agg(
            F.collect_list("a").alias("_all"))
        return rows.withColumn("a_test" if test else "a_train", sum_arrays(F.col("_all"), F.col("d") * F.col("d"))).drop("_all")

    packed = weights.groupBy("model_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gene", "w"))), lambda e: e["w"]).alias("w"))
    jobs = part(False).join(part(True).select("model_id", "a_test"), "model_id").join(packed, "model_id")
    cols = ["model_id", "d", "responses", "a_train", "a_test", "w"]
    return jobs.select(*cols).groupBy("model_id").applyInPandas(
        _refit, "model_id string, response string, split string, r double, h array<double>")


# Many models ----------------------------------------------------------------------


def score_matrix(scores: DataFrame, lineage: DataFrame) -> DataFrame:
    """Scores of many models on the samples all of them share, z-scored per model, with lineage."""
    shared = in_all(scores, "sample", "model_id")
    kept = z_score(scores.join(shared, "sample", "left_semi"), ["model_id"], "raw_score", out="z")
    named = kept.join(lineage.select("sample", "lineage"), "sample", "left")
    return named.withColumn("lineage", F.coalesce("lineage", F.lit("Unknown"))).select(
        "lineage", "sample", "model_id", "z")


def compare_predictions(ours: DataFrame, theirs: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Our and an outside model's fold-averaged predictions against the same truth.

    ``ours`` and ``theirs``: (*keys, sample, fold, prediction).
    """
    keys = list(keys)

    def mean(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, "sample").agg(F.avg("prediction").alias(name))

    both = truth.join(mean(ours, "ours"), [*keys, "sample"]).join(mean(theirs, "theirs"), [*keys, "sample"])
    long = both.unpivot([*keys, "sample", "value"], ["ours", "theirs"], "source", "prediction")
    tests = correlation_test(long, [*keys, "source"], "value", "prediction")
    return tests.join(regression_metrics(long, [*keys, "source"], "value", "prediction").select(
        *keys, "source", "rmse", "mae"), [*keys, "source"])


def _principal(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            a = np.reshape(row.a, (row.d, row.d))
            n, k = a[-1, -1], row.d - 1
            mean = a[:k, -1] / n
            cov = a[:k, :k] / n - np.outer(mean, mean)
            sd = np.sqrt(np.clip(np.diag(cov), 0, None))
            sd[sd == 0] = 1.0
            values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
            order = np.argsort(values)[::-1][:size]
            axes = vectors[:, order].T
            axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
            share = values[order] / values.sum()
            out.append((row.model_id, mean.tolist(), sd.tolist(), axes.tolist(), share.tolist()))
        return pd.DataFrame(out, columns=["model_id", "mean", "sd", "axes", "share"])

    return run


def principal_axes(z: DataFrame, size: int = 10) -> DataFrame:
    """Principal axes of standardised vectors per model, from their summed moments.

    The sign of an axis makes its largest entry positive.
    """
    vectors = z.select("model_id", F.lit(0).alias("fold"), F.concat("z", F.array(F.lit(1.0))).alias("v"))
    return vector_moments(vectors, ["model_id"]).groupBy("model_id").applyInPandas(
        _principal(size), "model_id string, mean array<double>, sd array<double>, axes array<array<double>>, share array<double>")


def component_scores(z: DataFrame, size: int = 10) -> DataFrame:
    """Each model's coordinates reduced to ``size`` components, zero-padded, stacked."""
    axes = principal_axes(z, size)
    joined = z.join(bounded_broadcast(axes, 10_000), "model_id")
    unit = F.zip_with(F.zip_with("z", "mean", lambda a, b: a - b), "sd", lambda a, b: a / b)
    scores = F.transform("axes", lambda axis: dot(unit, axis))
    padded = F.slice(F.concat(scores, F.array_repeat(F.lit(0.0), size)), 1, size)
    return joined.select("model_id", "sample", padded.alias("components"))


def group_samples(z: DataFrame, k: int = 8, least: int = 13, seed: int = 20357) -> DataFrame:
    """Group samples by latent position with bisecting k-means; groups under ``least`` get 0.

    Rows ``(sample, z ARRAY)``. Labels run from 1 by falling size.
    """
    rows = z.select("sample", array_to_vector("z").alias("features"))
    model = BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=float(2 * least), featuresCol="features",
                            predictionCol="_c").fit(rows)
    labelled = cut(model.transform(rows).select("sample", "_c"))
    sizes = labelled.groupBy("_c").agg(F.count(F.lit(1)).alias("size"))
    order = position(sizes.withColumn("_neg", -F.col("size")), [], ["_neg", "_c"], "cluster")
    names = order.select("_c", "size", F.when(F.col("size") >= least, F.col("cluster")).otherwise(F.lit(0)).alias("cluster"))
    return labelled.join(F.broadcast(names), "_c").select("sample", F.col("cluster").cast("int").alias("cluster"))


def best_group(profile: DataFrame, name: str = "cluster") -> DataFrame:
    """Ranks of the groups: drug response up, dependency down, score down, their sum.

    Group 0 is left out. ``best`` marks the smallest sum (first name on ties). Rows
    ``(name, response_a, response_b, score)`` with a = drug response, b = dependency.
    """
    used = profile.where(F.col(name) != 0).withColumns({
        "_b": -F.col("response_b"), "_s": -F.col("score")})
    out = used
    for column, rank in (("response_a", "rank_ic50"), ("_b", "rank_dep"), ("_s", "rank_score")):
        out = position(out, [], [column, name], rank)
    out = out.withColumn("total_rank", F.col("rank_ic50") + F.col("rank_dep") + F.col("rank_score"))
    first = out.agg(F.min(F.struct("total_rank", name)).alias("_first"))
    return attach(out, first).withColumn("best", F.col("_first")[name] == F.col(name)).drop("_first", "_b", "_s")


def members(labels: DataFrame, best: DataFrame, split: DataFrame, name: str = "cluster") -> DataFrame:
    """Samples of the best group with their set."""
    chosen = best.where("best").select(name)
    return labels.join(F.broadcast(chosen), name, "left_semi").join(split.select("sample", "split"), "sample")


def group_profile(df: DataFrame, keys: Sequence[str], a: str, b: str, score: str) -> DataFrame:
    """Mean responses, mean score and size per group."""
    return df.groupBy(*keys).agg(
        F.avg(a).alias("response_a"), F.avg(b).alias("response_b"), F.avg(score).alias("score"),
        F.count(F.lit(1)).alias("size"))


def agreement(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Pearson correlation of two influence vectors per key."""
    return df.groupBy(*keys).agg(corr(first, second).alias("r"), F.count(F.lit(1)).alias("n"))
