"""Alignment, lookups, grids and the sparse matrix product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.session import bounded_broadcast


def common_samples(*tables: DataFrame) -> DataFrame:
    """Samples that occur in every table."""
    out = tables[0].select("sample").distinct()
    for other in tables[1:]:
        out = out.join(other.select("sample"), "sample", "left_semi")
    return out


def align(*tables: DataFrame) -> list[DataFrame]:
    """Cut every table to the samples all of them share."""
    shared = common_samples(*tables)
    return [t.join(shared, "sample", "left_semi") for t in tables]


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str] | str, labels: dict[str, str]) -> DataFrame:
    """Left lookup; a label missing in ``dim`` takes the given default."""
    out = df.join(dim, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in labels.items()})


def explode_targets(df: DataFrame, drug: str = "drug", targets: str = "targets") -> DataFrame:
    """Comma-joined target lists as one trimmed row per target."""
    return df.select(
        drug, F.explode(F.transform(F.split(targets, ","), lambda x: F.trim(x))).alias("target")
    ).where(F.col("target") != "").distinct()


def merge_drug_targets(tables: Sequence[DataFrame], first_only: bool = False) -> DataFrame:
    """Stack ``(drug, targets)`` tables with upper-case drug names, one row per drug and target.

    By default the lists of all tables are united; ``first_only`` keeps the list of the
    first table that knows a drug.
    """
    parts = []
    for place, table in enumerate(tables):
        rows = explode_targets(table.withColumn("drug", F.upper("drug")))
        parts.append(rows.withColumn("_place", F.lit(place)))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    if first_only:
        first = out.groupBy("drug").agg(F.min("_place").alias("_place"))
        out = out.join(first, ["drug", "_place"], "left_semi")
    return out.select("drug", "target").distinct()


def drugs_of_target(drug_target: DataFrame, ic50: DataFrame, target: str | None = None) -> DataFrame:
    """Tested drugs per target."""
    rows = drug_target if target is None else drug_target.where(F.col("target") == target)
    return rows.join(ic50.select("drug").distinct(), "drug", "left_semi")


def pair_grid(
    drug_target: DataFrame, dependency_genes: DataFrame, expression_genes: DataFrame, seeds: Sequence[int]
) -> DataFrame:
    """(drug, target, seed) for targets present in both matrices."""
    genes = [g.select(F.col("gene").alias("target")) for g in (dependency_genes, expression_genes)]
    kept = drug_target.select("drug", "target").distinct()
    for g in genes:
        kept = kept.join(g, "target", "left_semi")
    return kept.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def match_models(joint: DataFrame, single: DataFrame, keys: Sequence[str], default: Column) -> DataFrame:
    """Left match of joint and single-response models, a default id where there is none."""
    return joint.join(single, list(keys), "left").withColumn(
        "single_id", F.coalesce("single_id", default))


def product(
    rows: DataFrame, weights: DataFrame, keys: Sequence[str], inner: str = "gene",
    value: str = "value", weight: str = "weight", out: str = "score",
) -> DataFrame:
    """Sparse matrix product: join on the inner key, sum of products per ``keys``.

    ``weights`` is broadcast only after a bounded count; the sum combines map-side, so a
    sample with a third of all rows is reduced before the shuffle.
    """
    joined = rows.join(bounded_broadcast(weights), inner)
    return joined.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias(out))
