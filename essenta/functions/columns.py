"""Column expressions: names, ids, classes and scalings. All run inside Spark's codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample-id patterns and the concentration-to-plate table.
CONTROL_PATTERN = r"DMSO_Plate_(\d+)_(CVCL_[A-Za-z0-9]+)"
TREATED_PATTERN = r"Erlotinib_([0-9\.]+)_(CVCL_[A-Za-z0-9]+)"
PLATE_OF_CONCENTRATION = {"0.05": "Plate_7", "0.5": "Plate_8", "5": "Plate_9"}
# Gene class patterns.
MITO_PREFIX = "MT-"
RIBO_PREFIXES = ("RPS", "RPL")
HEMO_PATTERN = "^HB[^(P)]"
# Renamed gene ids.
GENE_RENAMES = {
    "ENSG00000253102": "LRRC59-AS1",
    "ENSG00000228925": "MCFD2-AS1",
    "ENSG00000241073": "MFSD14A-AS1",
    "ENSG00000227741": "PEA15-AS1",
    "KIAA1522": "NHSL3",
}


def strip_suffix(name: Column) -> Column:
    """``EGFR (1956)`` -> ``EGFR``."""
    return F.regexp_replace(name, r" \(.*\)$", "")


def strip_hyphens(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit(""))


def rename_by(name: Column, table: dict[str, str]) -> Column:
    """Look a name up in a fixed map, unchanged when absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def plate_of(concentration: Column, table: dict[str, str] = PLATE_OF_CONCENTRATION) -> Column:
    out = F.lit("Unknown")
    for conc, plate in table.items():
        out = F.when(concentration == conc, plate).otherwise(out)
    return out


def parse_sample_id(
    sample_id: Column,
    control: str = CONTROL_PATTERN,
    treated: str = TREATED_PATTERN,
    control_name: str = "DMSO",
    treated_name: str = "Erlotinib",
    plates: dict[str, str] = PLATE_OF_CONCENTRATION,
) -> dict[str, Column]:
    """Columns ``treatment, plate, conc, cell_line``; unmatched ids are ``Unknown``."""
    is_control, is_treated = sample_id.rlike(control), sample_id.rlike(treated)
    conc = F.regexp_extract(sample_id, treated, 1)
    unknown = F.lit("Unknown")
    return {
        "treatment": F.when(is_control, control_name).when(is_treated, treated_name).otherwise(unknown),
        "plate": F.when(is_control, F.concat(F.lit("Plate_"), F.regexp_extract(sample_id, control, 1)))
        .when(is_treated, plate_of(conc, plates)).otherwise(unknown),
        "conc": F.when(is_control, F.lit(0.0)).when(is_treated, conc.try_cast("double")),
        "cell_line": F.when(is_control, F.regexp_extract(sample_id, control, 2))
        .when(is_treated, F.regexp_extract(sample_id, treated, 2)).otherwise(unknown),
    }


def regulation_class(
    log_fc: Column, p_adj: Column, min_fc: float = 1.0, max_p: float = 0.05, two_way: bool = False
) -> Column:
    """Three-way class; the two-way form calls every significant non-up gene down."""
    significant = p_adj < max_p
    up = F.when(significant & (log_fc > min_fc), "upregulated")
    if two_way:
        return up.when(significant, "downregulated").otherwise("nonsignificant")
    return up.when(significant & (log_fc < -min_fc), "downregulated").otherwise("nonsignificant")


def response_class(best: Column, best_average: Column) -> Column:
    # Cut-offs on best and best average volume change, first match wins.
    return (
        F.when((best < -95) & (best_average < -40), "mCR")
        .when((best < -50) & (best_average < -20), "mPR")
        .when((best < 35) & (best_average < 30), "mSD")
        .otherwise("mPD")
    )


def membership(in_features: Column, in_pathway: Column, regulation: Column) -> Column:
    """One class per gene: feature list, then pathway, then regulation."""
    return (
        F.when(in_features == "yes", "feature_list")
        .when(in_pathway == "yes", "pathway")
        .when(regulation == "upregulated", "DEG_up")
        .when(regulation == "downregulated", "DEG_down")
        .when(regulation.isin("nonsignificant", "non_significant"), "non_significant")
        .otherwise("no_member")
    )


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def high_low(value: Column, cutoff: Column | float, strict: bool = False) -> Column:
    """``high`` at or above the cutoff, or only above it when ``strict``."""
    return F.when(value > cutoff if strict else value >= cutoff, "high").otherwise("low")


def stars(p: Column) -> Column:
    # Significance marks.
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def signed_log(z: Column) -> Column:
    return F.signum(z) * F.log10(1 + F.abs(z))


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def is_mito(gene: Column) -> Column:
    return gene.startswith(MITO_PREFIX)


def is_ribo(gene: Column) -> Column:
    return gene.startswith(RIBO_PREFIXES[0]) | gene.startswith(RIBO_PREFIXES[1])


def is_hemo(gene: Column) -> Column:
    return gene.rlike(HEMO_PATTERN)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def pseudo_counts(fpkm: Column, length: Column, reads: Column) -> Column:
    """Raw counts implied by FPKM, gene length and a depth divisor."""
    return F.round(fpkm * length / reads)
