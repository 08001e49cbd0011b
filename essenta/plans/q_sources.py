"""Registered queries: sources and sinks. Files are derived from the given tables."""

from pyspark.sql import functions as F

from essenta.operators.joins import product
from essenta.operators.order import attach
from essenta.operators.ranking import first_row
from essenta.plans.catalog import SEEDS, R, query, r, with_
from essenta.session import scratch_path
from essenta.sources import matrix, registry, tables


@query("a1_wide_matrix", with_("expr") + f"SELECT sample, gene, {R('value')} AS value FROM expr")
def _(t):
    width = 64  # length of the embedding vectors
    wide = t.embeddings.select(
        F.col("vec_id").cast("string").alias("sample"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(width)])
    path = scratch_path(t.spark, "matrix")
    matrix.write_matrix(wide, path)
    return matrix.read_matrix(t.spark, path).withColumn("value", r("value"))


@query("a2_orientation", with_("ic50") + "SELECT sample, drug, value FROM ic50")
def _(t):
    by_drug = t.ic50()
    samples = t.customer.select(F.col("c_custkey").cast("string").alias("sample"))
    # the drug column comes first on disk; the samples decide the orientation
    raw = by_drug.select(F.col("drug").alias("sample"), F.col("sample").alias("drug"), "value")
    return matrix.as_sample_rows(raw, samples, "sample", "drug").select("sample", "drug", "value")


@query("a3_delimited", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "tsv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("sep", "\t").option(
        "header", True).csv(path)
    return tables.read_delimited(
        t.spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING")


@query("a4_filtered_parquet", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    wanted = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    rows = tables.read_filtered(t.spark, f"{t.dir}/orders.parquet", o_orderpriority="1-URGENT")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice").join(wanted, "o_custkey", "left_semi")


@query("a5_plate_cells", with_("cnt") + """
SELECT plate, cell, gene, count FROM cnt
WHERE cell IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)""")
def _(t):
    path = scratch_path(t.spark, "cells")
    tables.write_cells(t.counts(), path)
    plates = t.lineitem.select(F.col("l_returnflag").alias("plate"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    good = t.supplier.where(F.col("s_acctbal") > 5000).select("s_suppkey")
    barcodes = plates.join(good, "s_suppkey").select("plate", F.col("s_suppkey").cast("string").alias("cell"))
    return tables.read_cells(t.spark, path, barcodes).select("plate", "cell", "gene", "count")


@query("a6_edge_list", with_("edge") + "SELECT src, dst, weight FROM edge")
def _(t):
    path = scratch_path(t.spark, "graph")
    tables.write_graphml(t.edges(), path)
    return tables.read_graphml(t.spark, path)


@query("a7_name_list", "SELECT DISTINCT p_name AS name FROM part")
def _(t):
    path = scratch_path(t.spark, "names")
    tables.write_names(t.part.select("p_name").distinct(), "p_name", path)
    return tables.read_names(t.spark, path)


@query("a8_result_table", """
SELECT l_returnflag AS plate, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "result")
    tables.write_table(t.lineitem.groupBy(F.col("l_returnflag").alias("plate")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top")), path, "csv")
    return tables.read_delimited(t.spark, path, "plate STRING, n BIGINT, top DOUBLE", ",")


SCORES = with_("expr", """
w AS (SELECT gene, avg(value) AS mean, stddev_samp(value) AS sd FROM expr GROUP BY gene)""") + f"""
SELECT e.sample, {R('sum((e.value - w.mean) / w.sd)')} AS score FROM expr e JOIN w USING (gene) GROUP BY 1"""


def _model_tables(t, rows, model_id="m"):
    return {
        "model": t.spark.sql(f"SELECT '{model_id}' AS model_id, 'd' AS drug, 'f0' AS target, 42L AS seed"),
        "model_weight": rows.groupBy("gene").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).select(
            F.lit(model_id).alias("model_id"), "gene", F.array(F.lit(1.0)).alias("w"), "mean", "sd"),
    }


def _stored_scores(t, path):
    weights = registry.load_models(t.spark, path)["model_weight"].select("gene", "mean", "sd", F.col("w")[0].alias("weight"))
    rows = t.expression().join(weights.select("gene", "mean", "sd"), "gene").withColumn(
        "value", (F.col("value") - F.col("mean")) / F.col("sd"))
    return product(rows, weights.select("gene", "weight"), ["sample"]).select("sample", r("score").alias("score"))


@query("a9_registry", SCORES)
def _(t):
    path = scratch_path(t.spark, "models")
    registry.save_models(_model_tables(t, t.expression()), path)
    return _stored_scores(t, path)


def _failing_save(t, path, tables):
    """A save whose ``model`` table cannot be written, after the others were."""
    broken = tables["model"].withColumn("drug", F.raise_error(F.concat(F.lit("lost "), "drug")).cast("string"))
    try:
        registry.save_models({**tables, "model": broken}, path)
    except Exception as err:
        if "lost d" not in str(err):
            raise
        return
    raise AssertionError("the save went through")


@query("a9_failed_save", SCORES)
def _(t):
    path = scratch_path(t.spark, "models")
    registry.save_models(_model_tables(t, t.expression()), path)
    # the second state of the model, which never becomes visible
    _failing_save(t, path, _model_tables(t, t.expression().withColumn("value", F.col("value") * 2 + 1)))
    return _stored_scores(t, path)


@query("a10_experiments", """
SELECT o_orderpriority AS drug, CAST(o_custkey AS VARCHAR) AS cell_id, max(o_totalprice) AS value
FROM orders GROUP BY 1, 2 HAVING max(o_totalprice) >= 100000""")
def _(t):
    path = scratch_path(t.spark, "experiments")
    best = F.col("value")
    t.ic50().select(
        "drug", F.col("sample").alias("cell_id"),
        F.array(F.struct(F.when(best >= 100000, best).alias("IC50")), F.struct(F.lit(0.0).alias("IC50"))).alias("data"),
    ).write.json(path)
    return tables.read_experiments(t.spark, path)


@query("a10_gene_lists", "SELECT DISTINCT p_brand AS pathway, p_type AS gene FROM part")
def _(t):
    path = scratch_path(t.spark, "pathways")
    t.drug_targets().groupBy(F.col("drug").alias("pathway")).agg(
        F.collect_set("target").alias("genes")).write.json(path)
    return tables.read_gene_lists(t.spark, path)


@query("a10_interactions", with_("edge") + "SELECT src, dst, weight AS score FROM edge")
def _(t):
    path = scratch_path(t.spark, "interactions")
    t.edges().write.option("sep", "\t").csv(path)
    return tables.read_interactions(t.spark, path)


@query("a10_aliases", """
SELECT DISTINCT p_brand AS query, 0 AS place, p_name AS alias FROM part WHERE p_size <= 25
UNION ALL SELECT query, unnest([0, 1]) AS place, unnest([a, b]) AS alias FROM (
  SELECT p_brand AS query, min(p_name) AS a, max(p_name) AS b FROM part WHERE p_size > 25 GROUP BY 1)""")
def _(t):
    path = scratch_path(t.spark, "aliases")
    single = t.part.where("p_size <= 25").select(F.col("p_brand").alias("query"), F.col("p_name").alias("alias")).distinct()
    double = t.part.where("p_size > 25").groupBy(F.col("p_brand").alias("query")).agg(
        F.array(F.min("p_name"), F.max("p_name")).alias("alias"))
    single.write.json(path)
    double.write.mode("append").json(path)
    return tables.read_aliases(t.spark, path).select("query", "place", "alias")


@query("a11_resume", with_("dt") + f"""
SELECT drug, target, CAST(seed AS BIGINT) AS seed FROM dt, (SELECT unnest({SEEDS}) AS seed)
WHERE NOT (seed = 42 AND drug IN (SELECT p_brand FROM part WHERE p_retailprice > 1000))""")
def _(t):
    grid = t.drug_targets().withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in SEEDS])))
    fitted = t.part.where("p_retailprice > 1000").select(F.col("p_brand").alias("drug")).distinct()
    done = first_row(t.drug_targets().join(fitted, "drug").withColumn("seed", F.lit(42).cast("long")),
                     ["drug", "target", "seed"], F.col("drug"))
    return registry.still_to_fit(grid, done, ["drug", "target", "seed"])


@query("a11_failed_save", """
SELECT p_brand AS drug FROM part GROUP BY 1 HAVING NOT bool_or(p_retailprice > 1000)""")
def _(t):
    path = scratch_path(t.spark, "models")
    brands = t.part.groupBy(F.col("p_brand").alias("drug")).agg(F.bool_or(F.col("p_retailprice") > 1000).alias("good"))
    model = brands.select(F.col("drug").alias("model_id"), "drug", F.lit("f0").alias("target"), F.lit(42).cast("long").alias("seed"), "good")
    registry.save_models({"model": model.where("good")}, path)
    rest = model.where("NOT good")
    _failing_save(t, path, {"model": rest.select("model_id", F.lit("d").alias("drug"), "target", "seed"), "model_split": rest.select("model_id")})
    return registry.still_to_fit(brands, registry.load_models(t.spark, path)["model"], ["drug"]).select("drug")


@query("a11_search_resumed", """
SELECT model_id, CAST(fold AS INTEGER) AS fold, CAST(trial AS INTEGER) AS trial, CASE WHEN trial < 3 OR trial = 3 AND fold < 2 THEN 'first' ELSE 'second' END AS run
FROM (SELECT DISTINCT o_orderpriority AS model_id FROM orders), (SELECT unnest(range(5)) AS fold), (SELECT unnest(range(8)) AS trial)""")
def _(t):
    from essenta.operators import factor_model as M
    from essenta.plans import training

    path = scratch_path(t.spark, "losses")
    drugs = t.orders.select(F.col("o_orderpriority").alias("model_id")).distinct()
    names = drugs.agg(F.collect_list("model_id").alias("n"))  # five order priorities
    responses = attach(t.responses(), names).select(F.explode("n").alias("model_id"), "response", "sample", "value")
    models = drugs.select("model_id", F.lit("f0").alias("target"), F.lit(42).alias("seed"))
    ready = training.prepare(t.expression(), responses, models, k=3)
    weights = M.response_weights(ready["centred"])
    trials = M.random_trials(8, 20357)

    def run(label):
        return lambda part, done: M.search(ready["moments"], weights, models, part, epochs=5, done=done).withColumn("run", F.lit(label))

    # the first run is killed after three trials and two folds of the fourth
    first = run("first")(F.slice(trials, 1, 4), None)
    registry.save_losses(first.where("trial < 3 OR fold < 2"), path)
    return registry.resume_search(t.spark, path, trials, run("second"), every=3).select("model_id", "fold", "trial", "run")
