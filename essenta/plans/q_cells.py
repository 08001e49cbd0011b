"""Registered queries: single cells and pseudobulk cohorts."""

from pyspark.sql import functions as F

from essenta.operators import cells as S
from essenta.operators.normalise import depth_normalise
from essenta.plans import cohort
from essenta.plans import sqltext as Q
from essenta.plans.catalog import R, query, r, with_

# Brands stand for genes, so the class flags use brand prefixes.
NAMED = """
nm AS (SELECT plate, cell, CASE WHEN gene IN ('Brand#1', 'Brand#2') THEN 'MT-' || gene WHEN gene = 'Brand#3' THEN 'RPS' || gene
  WHEN gene = 'Brand#4' THEN 'RPL' || gene WHEN gene = 'Brand#5' THEN 'HBA' || gene WHEN gene = 'Brand#6' THEN 'HBP' || gene ELSE gene END AS gene, count FROM cnt)"""


def named(t):
    g = F.col("gene")
    return t.counts().withColumn("gene", F.when(g.isin("Brand#1", "Brand#2"), F.concat(F.lit("MT-"), g))
                                 .when(g == "Brand#3", F.concat(F.lit("RPS"), g)).when(g == "Brand#4", F.concat(F.lit("RPL"), g))
                                 .when(g == "Brand#5", F.concat(F.lit("HBA"), g)).when(g == "Brand#6", F.concat(F.lit("HBP"), g)).otherwise(g))


@query("sc1_gene_flags", with_("cnt", NAMED) + """
SELECT DISTINCT gene, starts_with(gene, 'MT-') AS mito, starts_with(gene, 'RPS') OR starts_with(gene, 'RPL') AS ribo,
  regexp_matches(gene, '^HB[^(P)]') AS hb FROM nm""")
def _(t):
    return named(t).select("gene", *[e.alias(n) for n, e in S.gene_flags(F.col("gene")).items()]).distinct()


METRICS = """
rk AS (SELECT *, row_number() OVER (PARTITION BY plate, cell ORDER BY count DESC, gene) AS k FROM nm),
cm AS (SELECT plate, cell, CAST(sum(count) AS BIGINT) AS total_counts, count(*) AS n_genes, ln(1 + sum(count)) AS log1p_total, ln(1 + count(*)) AS log1p_genes,
  sum(count) FILTER (k <= 20) / sum(count) * 100 AS pct_top_20, coalesce(sum(count) FILTER (starts_with(gene, 'MT-')), 0) / sum(count) * 100 AS pct_mito,
  coalesce(sum(count) FILTER (starts_with(gene, 'RPS') OR starts_with(gene, 'RPL')), 0) / sum(count) * 100 AS pct_ribo,
  coalesce(sum(count) FILTER (regexp_matches(gene, '^HB[^(P)]')), 0) / sum(count) * 100 AS pct_hb FROM rk GROUP BY 1, 2)"""
_METRIC_COLUMNS = ("log1p_total", "log1p_genes", "pct_top_20", "pct_mito", "pct_ribo", "pct_hb")


@query("sc2_cell_metrics", with_("cnt", NAMED, METRICS) + f"""
SELECT plate, cell, total_counts, n_genes, {', '.join(f'{R(c)} AS {c}' for c in _METRIC_COLUMNS)} FROM cm""")
def _(t):
    return S.cell_metrics(named(t)).select("plate", "cell", "total_counts", "n_genes", *[r(c).alias(c) for c in _METRIC_COLUMNS])


@query("sc2_gene_metrics", with_("cnt", NAMED, "nc AS (SELECT count(*) AS n FROM (SELECT DISTINCT plate, cell FROM nm))") + f"""
SELECT gene, count(*) AS cells_seen, CAST(sum(count) AS BIGINT) AS total_counts, {R('ln(1 + sum(count))')} AS log1p_total, {R('sum(count) / max(n)')} AS mean_counts,
  {R('(1 - count(*) / max(n)) * 100')} AS pct_dropout FROM nm, nc GROUP BY 1""")
def _(t):
    rows = named(t)
    return S.gene_metrics(rows, S.cell_number(rows)).select(
        "gene", "cells_seen", "total_counts", *[r(c).alias(c) for c in ("log1p_total", "mean_counts", "pct_dropout")])


def _outlier_sql(metric):
    return f"""
med_{metric} AS (SELECT plate, quantile_cont({metric}, 0.5) AS m FROM cm GROUP BY 1),
mad_{metric} AS (SELECT plate, max(m) AS m, quantile_cont(abs({metric} - m), 0.5) AS d FROM cm JOIN med_{metric} USING (plate) GROUP BY 1)"""


_OUT = [_outlier_sql(m) for m in ("log1p_total", "log1p_genes", "pct_top_20")]

FLAGGED = """
fl AS (SELECT plate, cell, abs(log1p_total - a.m) > 5 * a.d OR abs(log1p_genes - b.m) > 5 * b.d OR abs(pct_top_20 - c.m) > 5 * c.d AS outlier
  FROM cm JOIN mad_log1p_total a USING (plate) JOIN mad_log1p_genes b USING (plate) JOIN mad_pct_top_20 c USING (plate))"""


@query("sc3_mad_outlier", with_("cnt", NAMED, METRICS, *_OUT, FLAGGED) + "SELECT plate, cell, outlier FROM fl")
def _(t):
    return S.outlier_cells(S.cell_metrics(named(t))).select("plate", "cell", "outlier")


@query("sc4_gene_filter", with_("cnt") + """
SELECT plate, cell, gene, count FROM cnt WHERE (plate, gene) IN (SELECT (plate, gene) FROM cnt GROUP BY plate, gene HAVING sum(count) > 20000)""")
def _(t):
    return S.keep_genes(t.counts(), total=20000)


@query("sc5_join_plates", with_("cnt", NAMED, METRICS, *_OUT, FLAGGED, """
kept AS (SELECT n.* FROM nm n JOIN fl f ON f.plate = n.plate AND f.cell = n.cell WHERE NOT outlier)""") + """
SELECT plate, cell, gene, count, cell || '-' || plate AS cell_id FROM kept WHERE (plate, gene) IN (SELECT (plate, gene) FROM kept GROUP BY plate, gene HAVING sum(count) > 200)""")
def _(t):
    return S.filter_plates(named(t))


# Single genes: brand and type, many more than brands alone.
FINE = """
fine AS (SELECT l_returnflag AS plate, CAST(l_suppkey AS VARCHAR) AS cell, p_brand || '-' || p_type AS gene, CAST(sum(l_quantity) AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def fine(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("plate"), F.col("l_suppkey").cast("string").alias("cell"),
        F.concat_ws("-", "p_brand", "p_type").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("count"))


NORMAL = """
lb AS (SELECT plate, cell, sum(count) AS n FROM fine GROUP BY 1, 2),
nz AS (SELECT plate, cell, gene, ln(1 + count / n * 1e4) AS value FROM fine JOIN lb USING (plate, cell)),
mo AS (SELECT gene, sum(value) / max(k) AS mean, (sum(value * value) - max(k) * (sum(value) / max(k)) ** 2) / (max(k) - 1) AS variance
  FROM nz, (SELECT count(*) AS k FROM lb) GROUP BY 1)"""


@query("sc7_depth_normalise", with_("cnt", FINE, NORMAL) + f"SELECT plate, cell, gene, {R('value')} AS value FROM nz")
def _(t):
    return depth_normalise(fine(t), ["plate", "cell"]).select("plate", "cell", "gene", r("value").alias("value"))


def _moments(t):
    counts = fine(t)
    values = depth_normalise(counts, ["plate", "cell"])
    return values, S.gene_moments(values, S.cell_number(counts))


_EDGES = ", ".join(f"{p / 100:.2f}" for p in range(10, 105, 5))


@query("sc6_variable_genes", with_("cnt", FINE, NORMAL, f"""
ed AS (SELECT quantile_cont(mean, [{_EDGES}]) AS e FROM mo)""", """
bn AS (SELECT gene, mean, variance / greatest(mean, 1e-12) AS d, len(list_filter(e, lambda x: x < mean)) AS bin FROM mo, ed)""", """
md AS (SELECT bin, quantile_cont(d, 0.5) AS m FROM bn GROUP BY 1)""", """
ma AS (SELECT bin, quantile_cont(abs(d - m), 0.5) / 0.6744897501960817 AS s FROM bn JOIN md USING (bin) GROUP BY 1)""", """
sr AS (SELECT gene, (d - m) / s AS score FROM bn JOIN md USING (bin) JOIN ma USING (bin) WHERE s > 0)""") + f"""
SELECT gene, {R('score', 5)} AS score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS k FROM sr) WHERE k <= (SELECT floor(count(*) * 0.1) FROM mo)""")
def _(t):
    return S.variable_genes(_moments(t)[1]).select("gene", r("score", 5).alias("score"))


@query("sc8_scale_genes", with_("cnt", FINE, NORMAL) + f"""
SELECT plate, cell, gene, {R('least((value - mean) / sqrt(variance), 10)', 5)} AS scaled, {R('least(-mean / sqrt(variance), 10)', 5)} AS background FROM nz JOIN mo USING (gene)""")
def _(t):
    values, moments = _moments(t)
    return S.scale_genes(values, moments).select("plate", "cell", "gene", r("scaled", 5).alias("scaled"), r("background", 5).alias("background"))


@query("sc9_components")
def _(t):
    values, moments = _moments(t)
    genes = S.variable_genes(moments)
    out = S.components(S.scale_genes(values, moments), genes, k=5)
    return out.select("plate", "cell", F.posexplode("z").alias("component", "z")).withColumn("z", r(F.abs("z"), 4))


@query("sc10_neighbours", f"""
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS sample, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
d AS (SELECT a.sample, b.sample AS neighbour, list_distance(a.z, b.z) AS d FROM e a JOIN e b ON a.sample <> b.sample),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d, neighbour) AS rank FROM d)
SELECT sample, neighbour, {R('d')} AS distance, rank FROM k WHERE rank <= 20""")
def _(t):
    z = t.embeddings.select(F.col("vec_id").cast("string").alias("sample"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return S.nearest(z, 20).select("sample", "neighbour", r("distance").alias("distance"), "rank")


# Pseudobulk samples: one per supplier, flag and status; ids carry treatment, plate and line.
BULK = """
bk AS (SELECT CASE WHEN l_returnflag = 'N' THEN concat('DMSO_Plate_', 1 + l_linenumber % 3, '_CVCL_', l_suppkey) ELSE concat('Erlotinib_0.5_CVCL_', l_suppkey) END AS sample,
  p_brand AS gene, avg(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
iw AS (SELECT p_brand AS gene, (avg(p_size) - 25) / 5 AS z FROM part GROUP BY 1),
dm AS (SELECT *, regexp_extract(sample, '(CVCL_[A-Za-z0-9]+)', 1) AS cell_line FROM bk WHERE sample LIKE 'DMSO%'),
rw AS (SELECT sample, cell_line, sum(value * z) AS s FROM dm JOIN iw USING (gene) GROUP BY 1, 2),
mm AS (SELECT *, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS sc FROM rw),
ln AS (SELECT cell_line, avg(s) AS raw_score, avg(sc) AS scaled_score, count(*) AS n FROM mm GROUP BY 1),
li AS (SELECT ln.*, CASE WHEN scaled_score > m THEN 'high' ELSE 'low' END AS grp FROM ln, (SELECT quantile_cont(scaled_score, 0.5) AS m FROM ln)),
ic AS (SELECT 'CVCL_' || s_suppkey AS cell_line, s_acctbal AS y FROM supplier)"""


def bulk(t):
    sample = F.expr("""CASE WHEN l_returnflag = 'N' THEN concat('DMSO_Plate_', 1 + l_linenumber % 3, '_CVCL_', l_suppkey)
        ELSE concat('Erlotinib_0.5_CVCL_', l_suppkey) END""")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        sample.alias("sample"), F.col("p_brand").alias("gene")).agg(F.avg("l_quantity").alias("value"))


def bulk_influence(t):
    return t.part.groupBy(F.col("p_brand").alias("gene")).agg(((F.avg("p_size") - 25) / 5).alias("scaled_combined"))


@query("sc11_line_scores", with_("cnt", BULK) + f"SELECT cell_line, {R('raw_score')} AS raw_score, {R('scaled_score')} AS scaled_score, n, grp FROM li")
def _(t):
    rows = bulk(t)
    out = cohort.line_scores(rows, bulk_influence(t), cohort.sample_table(rows))
    return out.select("cell_line", r("raw_score").alias("raw_score"), r("scaled_score").alias("scaled_score"), "n", F.col("group").alias("grp"))


@query("sc11_score_response", with_("cnt", BULK, """
j AS (SELECT scaled_score AS x, y, grp, rank() OVER (ORDER BY scaled_score) AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM li JOIN ic USING (cell_line))""", """
c AS (SELECT count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) FILTER (grp = 'high') AS n1, count(*) FILTER (grp = 'low') AS n2, sum(ry) FILTER (grp = 'high') AS r1 FROM j)""", """
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, pearson * sqrt((n - 2) / (1 - pearson ** 2)) AS tp, spearman * sqrt((n - 2) / (1 - spearman ** 2)) AS ts FROM c)""") + f"""
SELECT n, {R('pearson')} AS pearson, {R('spearman')} AS spearman, {R(Q.t_two_sided('tp', 'n - 2'))} AS pearson_p, {R(Q.t_two_sided('ts', 'n - 2'))} AS spearman_p,
  n1, n2, {R('u', 1)} AS u, {R('1 - 2 * u / (n1 * n2)')} AS effect FROM u""")
def _(t):
    rows = bulk(t)
    lines = cohort.line_scores(rows, bulk_influence(t), cohort.sample_table(rows))
    ic50 = t.supplier.select(F.concat(F.lit("CVCL_"), "s_suppkey").alias("cell_line"), F.col("s_acctbal").alias("value"))
    out = cohort.score_against_response(lines, ic50)
    names = ("pearson", "spearman", "pearson_p", "spearman_p", "effect")
    return out.select("n", "n1", "n2", r("u", 1).alias("u"), *[r(c).alias(c) for c in names])


@query("sc12_pathway_panel", with_("cnt", BULK, """
pn AS (SELECT gene, regexp_extract(sample, '(CVCL_[A-Za-z0-9]+)', 1) AS cell_line, CASE WHEN sample LIKE 'DMSO%' THEN 'DMSO' ELSE 'Erlotinib' END AS treatment, avg(value) AS m
  FROM bk WHERE gene IN ('Brand#1', 'Brand#7', 'Brand#9') GROUP BY 1, 2, 3)""") + f"""
SELECT gene, cell_line, treatment, {R('(m - avg(m) OVER g) / stddev_samp(m) OVER g')} AS z, {R('scaled_score')} AS scaled_score FROM pn JOIN li USING (cell_line)
WINDOW g AS (PARTITION BY gene) ORDER BY scaled_score""")
def _(t):
    rows = bulk(t)
    samples = cohort.sample_table(rows)
    genes = t.part.where("p_brand IN ('Brand#1', 'Brand#7', 'Brand#9')").select(F.col("p_brand").alias("gene"))
    lines = cohort.line_scores(rows, bulk_influence(t), samples)
    out = cohort.pathway_panel(rows, samples, genes, lines)
    return out.select("gene", "cell_line", "treatment", r("z").alias("z"), r("scaled_score").alias("scaled_score")).orderBy("scaled_score")
