"""Delimited tables, parquet, name lists, edge lists, cell tables and API dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """Delimited text with a header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def read_filtered(spark: SparkSession, path: str, **equals) -> DataFrame:
    """Parquet rows where each named column is in the given values; pushed to the scan."""
    df = spark.read.parquet(path)
    for name, values in equals.items():
        df = df.where(F.col(name).isin(values if isinstance(values, (list, tuple, set)) else [values]))
    return df


def read_cells(spark: SparkSession, path: str, barcodes: DataFrame) -> DataFrame:
    """Cell counts partitioned by plate, wanted barcodes only."""
    return spark.read.parquet(path).join(barcodes.select("plate", "cell").distinct(), ["plate", "cell"], "left_semi")


def write_cells(df: DataFrame, path: str) -> None:
    df.write.partitionBy("plate").parquet(path)


def read_names(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """One name per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def write_names(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GraphML file as ``(src, dst, weight)``; a missing weight is 1."""
    schema = T.StructType([
        T.StructField("_source", T.StringType()),
        T.StructField("_target", T.StringType()),
        T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))),
    ])
    raw = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    weight = F.get("data", F.lit(0))["_VALUE"].try_cast("double")
    return raw.select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"))


def write_graphml(edges: DataFrame, path: str) -> None:
    """Write edges as XML rows below a ``graphml`` root, readable by ``read_graphml``."""
    rows = edges.select(
        F.col("src").alias("_source"), F.col("dst").alias("_target"),
        F.array(F.struct(F.col("weight").cast("string").alias("_VALUE"), F.lit("weight").alias("_key"))).alias("data"))
    rows.write.format("xml").option("rootTag", "graphml").option("rowTag", "edge").save(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table as parquet or CSV with a header."""
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(path)


# Dumped service answers -----------------------------------------------------------

EXPERIMENTS = "drug STRING, cell_id STRING, data ARRAY<STRUCT<IC50: DOUBLE>>"


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """IC50 per (drug, cell_id): first experiment of each answer, missing values dropped."""
    raw = spark.read.schema(EXPERIMENTS).json(path)
    return raw.select("drug", "cell_id", F.get("data", F.lit(0))["IC50"].alias("value")).where(
        F.col("value").isNotNull())


def read_gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """Pathway answers ``{"pathway": ..., "genes": [...]}`` as one row per gene."""
    raw = spark.read.schema("pathway STRING, genes ARRAY<STRING>").json(path)
    return raw.select("pathway", F.explode("genes").alias("gene"))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless interaction dump: source, target, score."""
    return spark.read.schema("src STRING, dst STRING, score DOUBLE").option("sep", "\t").csv(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias answers: the alias field is a string or a list of strings."""
    raw = spark.read.schema("query STRING, alias STRING").json(path)
    as_list = F.from_json("alias", "ARRAY<STRING>")
    names = F.when(F.col("alias").startswith("["), as_list).otherwise(F.array("alias"))
    return raw.where(F.col("alias").isNotNull()).select("query", F.posexplode(names).alias("place", "alias"))
