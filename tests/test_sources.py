import json

import pytest
from pyspark.sql import functions as F

from essenta.functions import columns as C
from essenta.operators import aggregates as D
from essenta.operators import filters as B
from essenta.operators import joins as J
from essenta.operators import topk as K
from essenta.sources import matrix, tables


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_wide_matrix_with_gaps_and_quotes(spark, tmp_path):
    path = write(tmp_path, "m.csv", '"drug",S1,"S,2",S3.x\nERL,1.5,,-2\n"AFA, B",NA,0.25,1e-3\n')
    rows = {(r.drug, r.sample): r.value for r in matrix.read_matrix(spark, path, "drug", "sample").collect()}
    assert rows == {("ERL", "S1"): 1.5, ("ERL", "S3.x"): -2.0, ("AFA, B", "S,2"): 0.25, ("AFA, B", "S3.x"): 0.001}


def test_wide_matrix_has_no_column_limit(spark, tmp_path):
    width = 30_000
    head = "sample," + ",".join(f"g-{i}" for i in range(width))
    lines = [f"s{k}," + ",".join(str(k + i) for i in range(width)) for k in range(3)]
    path = write(tmp_path, "wide.csv", "\r\n".join([head, *lines]) + "\r\n")
    rows = matrix.read_matrix(spark, path)
    assert rows.count() == 3 * width
    assert rows.where("gene = 'g-29999' AND sample = 's2'").first().value == 30001.0


def test_orientation_by_names(spark):
    by_drug = spark.createDataFrame([("ERL", "s1", 1.0), ("ERL", "s2", 2.0)], "sample string, drug string, value double")
    known = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample string")
    out = matrix.as_sample_rows(by_drug, known, "sample", "drug").collect()
    assert {(r.sample, r.drug) for r in out} == {("s1", "ERL"), ("s2", "ERL")}


def test_dumps(spark, tmp_path):
    dump = "\n".join(json.dumps(x) for x in (
        {"drug": "a", "cell_id": "c1", "data": [{"IC50": 0.5}, {"IC50": 9.0}]},
        {"drug": "a", "cell_id": "c2", "data": []}, {"drug": "b", "cell_id": "c1", "data": [{"other": 1}]}))
    rows = tables.read_experiments(spark, write(tmp_path, "x.json", dump)).collect()
    assert [(r.drug, r.cell_id, r.value) for r in rows] == [("a", "c1", 0.5)]
    alias = "\n".join(json.dumps(x) for x in ({"query": "q", "alias": "one"}, {"query": "p", "alias": ["x", "y"]}, {"query": "n"}))
    got = {(r.query, r.place, r.alias) for r in tables.read_aliases(spark, write(tmp_path, "a.json", alias)).collect()}
    assert got == {("q", 0, "one"), ("p", 0, "x"), ("p", 1, "y")}


def test_graphml_text(spark, tmp_path):
    text = """<?xml version="1.0"?><graphml><key id="d0" for="edge" attr.name="weight"/><graph edgedefault="undirected">
    <node id="A"/><edge source="A" target="B"><data key="d0">0.5</data></edge><edge source="B" target="C"/></graph></graphml>"""
    rows = tables.read_graphml(spark, write(tmp_path, "g.graphml", text)).collect()
    assert {(r.src, r.dst, r.weight) for r in rows} == {("A", "B", 0.5), ("B", "C", 1.0)}


def test_sample_ids(spark):
    ids = ["DMSO_Plate_7_CVCL_0023", "Erlotinib_0.05_CVCL_0023", "Erlotinib_5_CVCL_C466", "other"]
    cols = C.parse_sample_id(F.col("id"))
    rows = {r.id: r for r in spark.createDataFrame([(i,) for i in ids], "id string").select(
        "id", *[e.alias(n) for n, e in cols.items()]).collect()}
    assert tuple(rows[ids[0]])[1:] == ("DMSO", "Plate_7", 0.0, "CVCL_0023")
    assert tuple(rows[ids[1]])[1:] == ("Erlotinib", "Plate_7", 0.05, "CVCL_0023")
    assert tuple(rows[ids[2]])[1:] == ("Erlotinib", "Plate_9", 5.0, "CVCL_C466")
    assert tuple(rows["other"])[1:] == ("Unknown", "Unknown", None, "Unknown")


def test_gene_classes_and_names(spark):
    genes = spark.createDataFrame([("MT-CO1",), ("RPS3",), ("RPL1",), ("HBA1",), ("HBP1",), ("AMTX",)], "gene string")
    rows = {r.gene: (r.m, r.r, r.h) for r in genes.select(
        "gene", C.is_mito(F.col("gene")).alias("m"), C.is_ribo(F.col("gene")).alias("r"), C.is_hemo(F.col("gene")).alias("h")).collect()}
    assert rows == {"MT-CO1": (True, False, False), "RPS3": (False, True, False), "RPL1": (False, True, False),
                    "HBA1": (False, False, True), "HBP1": (False, False, False), "AMTX": (False, False, False)}
    row = spark.range(1).select(C.strip_suffix(F.lit("EGFR (1956)")).alias("a"), C.strip_hyphens(F.lit("A-549-X")).alias("b"),
                                C.rename_by(F.lit("KIAA1522"), C.GENE_RENAMES).alias("c"), C.rename_by(F.lit("TP53"), C.GENE_RENAMES).alias("d")).first()
    assert tuple(row) == ("EGFR", "A549X", "NHSL3", "TP53")


def test_alias_resolution_and_averaging(spark):
    rows = spark.createDataFrame([("s", "old1", 1.0), ("s", "old2", 3.0), ("s", "KEEP", 7.0)], "sample string, gene string, value double")
    aliases = spark.createDataFrame([("NEW", "old1"), ("NEW", "old2"), ("KEEP", "old2"), ("NEW", None), ("ZZZ", "old1")], "target string, alias string")
    wanted = spark.createDataFrame([("NEW",), ("KEEP",), ("ZZZ",)], "gene string")
    mapping = {r.gene: r.target for r in B.resolve_alias(rows, aliases, wanted).collect()}
    assert mapping == {"old1": "NEW", "old2": "NEW"}
    renamed = B.rename_features(rows, B.resolve_alias(rows, aliases, wanted))
    assert {(r.gene, r.mean) for r in D.group_mean(renamed, ["sample", "gene"]).collect()} == {("NEW", 2.0), ("KEEP", 7.0)}


def test_name_lists_stay_whole(spark):
    rows = spark.createDataFrame([("k", f"n{i:03d}") for i in range(25)] * 2 + [("j", "x")], "key string, name string")
    parts = D.name_lists(rows, "key", "name", part_size=10).orderBy("key", "part").collect()
    assert [(r.key, r.part, r.n) for r in parts] == [("j", 0, 1), ("k", 0, 10), ("k", 1, 10), ("k", 2, 5)]
    assert ",".join(r.names for r in parts if r.key == "k").split(",") == [f"n{i:03d}" for i in range(25)]


def test_validation_states(spark):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(5)], "sample string")
    ic50 = spark.createDataFrame([("d", f"s{i}", 1.0) for i in range(5)] + [("far", "zz", 1.0)], "drug string, sample string, value double")
    dep = spark.createDataFrame([("g", f"s{i}", 1.0) for i in range(3)], "gene string, sample string, value double")
    pairs = spark.createDataFrame([("d", "g"), ("far", "g"), ("x", "g"), ("d", "y")], "drug string, target string")
    got = {(r.drug, r.target): (r.n_samples, r.status) for r in B.validate_pairs(pairs, samples, ic50, dep, few=3).collect()}
    assert got == {("d", "g"): (3, "ok"), ("far", "g"): (0, "no common sample"), ("x", "g"): (0, "unknown drug"), ("d", "y"): (0, "unknown target")}


def test_enrichment_and_overlap(spark):
    rows = spark.createDataFrame([("m", "l1", 3.0), ("m", "l1", 5.0), ("m", "l2", 1.0), ("m", None, 2.0)], "model string, lineage string, value double")
    got = {r.lineage: r.enrichment for r in K.enrichment(rows, "model", "lineage", "value").collect()}
    assert got == {"l1": 4.0 - 1.5, "l2": pytest.approx(1.0 - 10 / 3)}
    sets = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("C", "y"), ("C", "z")], "grp string, item string")
    assert {r.region: r.n for r in K.overlap_regions(sets, "item", "grp", ["A", "B", "C"]).collect()} == {"A": 1, "A&B&C": 1, "C": 1}


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "v double")
    got = {r.v: r.clipped for r in B.clip_quantiles(df, "v", 0.0, 0.5).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 9.0: 2.0, None: None}


def test_align_and_targets(spark):
    a = spark.createDataFrame([("s1",), ("s2",), ("s2",)], "sample string")
    b = spark.createDataFrame([("s2",), ("s3",)], "sample string")
    assert [t.count() for t in J.align(a, b)] == [2, 1]
    lists = spark.createDataFrame([("d", "G1, G2,G1,"), ("e", "")], "drug string, targets string")
    assert {(r.drug, r.target) for r in J.explode_targets(lists).collect()} == {("d", "G1"), ("d", "G2")}


def test_wide_quoted_header(spark, tmp_path):
    names = [f'g"{k},x' if k % 1000 == 0 else f"g{k}" for k in range(54_000)]
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    (tmp_path / "m.csv").write_text(",".join(map(quote, ["id", *names])) + "\n" + ",".join(['"s,1"', *["1.5"] * 54_000]) + "\r\n")
    rows = matrix.read_matrix(spark, str(tmp_path))
    assert rows.count() == 54_000
    assert [tuple(r) for r in rows.where("gene = 'g\"3000,x'").collect()] == [("s,1", 'g"3000,x', 1.5)]


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b\nx,1,2\n")
    (tmp_path / "b.csv").write_text("id,b,a\ny,1,2\n")
    with pytest.raises(ValueError):
        matrix.read_matrix(spark, str(tmp_path))
