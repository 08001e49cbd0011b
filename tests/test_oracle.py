"""Registered queries against their SQL, on the small test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not there")

QUICK = """a1_wide_matrix a2_orientation a6_edge_list a10_experiments a11_resume b1_complete_cases b2_validate b5_resolve_alias
b6_parse_ids b12_median_split c1_align c8_pair_grid c10_product d3_mean_sd_sem d5_cross_table d8_coverage d10_describe d13_melt
e1_average_rank e3_first_per_key e7_quartiles e8_z_score f1_top_features f5_top_with_ties f8_lineage_enrichment f13_overlap_regions
g2_numeric h1_spearman h5_kendall h8_mann_whitney h11_bh h15_chi_square h17_linear_model h20_log_cpm k1_split k5_moments
k13_metrics k17_latent k21_benefit k25_score_cohort k31_best_group n4_shortest_paths n8_confident_edges sc2_cell_metrics
sc8_scale_genes sc10_neighbours sc11_line_scores""".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20
