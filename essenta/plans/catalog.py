"""Registered queries: each pairs a Spark plan with the SQL that states its result.

``t`` in a query function gives the driver tables as attributes and the stand-in tables
of the domain (expression matrix, responses, counts, graph) as methods. ``CTE`` holds
the SQL text of the same stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEEDS = [42, 1043, 2061]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def expression(self) -> DataFrame:
        """Dense matrix: one sample per vector, one gene per position."""
        return self.embeddings.select(
            F.col("vec_id").cast("string").alias("sample"), F.posexplode("embedding").alias("p", "v")
        ).select("sample", F.concat(F.lit("f"), "p").alias("gene"), F.col("v").cast("double").alias("value"))

    def responses(self) -> DataFrame:
        """Two responses per sample: ``ic50`` and ``dep``."""
        f = [F.get("embedding", F.lit(i)).cast("double") for i in (0, 1)]
        return self.embeddings.select(
            F.col("vec_id").cast("string").alias("sample"),
            F.explode(F.array(
                F.struct(F.lit("ic50").alias("response"), F.col("label").cast("double").alias("value")),
                F.struct(F.lit("dep").alias("response"), (f[0] - f[1]).alias("value")))).alias("r"),
        ).select("sample", "r.response", "r.value")

    def ic50(self) -> DataFrame:
        """Responses with gaps: drug = order priority, sample = customer."""
        return self.orders.groupBy(
            F.col("o_orderpriority").alias("drug"), F.col("o_custkey").cast("string").alias("sample")
        ).agg(F.max("o_totalprice").alias("value"))

    def drug_targets(self) -> DataFrame:
        return self.part.select(F.col("p_brand").alias("drug"), F.col("p_type").alias("target")).distinct()

    def lineage(self) -> DataFrame:
        nations = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").cast("string").alias("sample"), "c_name", "c_acctbal", "c_mktsegment",
            F.col("n_name").alias("nation"), F.col("r_name").alias("lineage"))

    def counts(self) -> DataFrame:
        """Counts: plate = return flag, cell = supplier, gene = brand."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
            F.col("l_returnflag").alias("plate"), F.col("l_suppkey").cast("string").alias("cell"),
            F.col("p_brand").alias("gene"),
        ).agg(F.sum("l_quantity").cast("long").alias("count"))

    def sparse_expression(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
            F.col("l_suppkey").cast("string").alias("sample"),
            F.concat_ws("-", "p_brand", "p_type").alias("gene"),
        ).agg(F.sum("l_quantity").alias("value"))

    def edges(self) -> DataFrame:
        """Undirected supplier - brand graph, one row per edge."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
            F.col("p_brand").alias("dst"),
        ).agg(F.count(F.lit(1)).cast("double").alias("weight"))

    def ties(self) -> DataFrame:
        """A sparse undirected graph: customers and suppliers - nations - regions, customers - order priorities."""
        name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
        one = F.lit(1.0).alias("weight")
        return self.customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), one).unionByName(
            self.supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), one)).unionByName(
            self.nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), one)).unionByName(
            self.orders.groupBy(name("c", "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(
                F.count(F.lit(1)).cast("double").alias("weight")))


CTE = {
    "ties": """ties AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.0::DOUBLE AS weight FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1.0 FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation
        UNION ALL SELECT 'c' || o_custkey, o_orderpriority, count(*) FROM orders GROUP BY 1, 2)""",
    "expr": """expr AS (SELECT sample, 'f' || CAST(p - 1 AS VARCHAR) AS gene, CAST(v AS DOUBLE) AS value FROM (
        SELECT CAST(vec_id AS VARCHAR) AS sample, unnest(embedding) AS v,
               generate_subscripts(embedding, 1) AS p FROM embeddings))""",
    "resp": """resp AS (SELECT CAST(vec_id AS VARCHAR) AS sample, 'ic50' AS response, CAST(label AS DOUBLE) AS value FROM embeddings
        UNION ALL SELECT CAST(vec_id AS VARCHAR), 'dep',
               CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE) FROM embeddings)""",
    "ic50": """ic50 AS (SELECT o_orderpriority AS drug, CAST(o_custkey AS VARCHAR) AS sample, max(o_totalprice) AS value
        FROM orders GROUP BY 1, 2)""",
    "dt": "dt AS (SELECT DISTINCT p_brand AS drug, p_type AS target FROM part)",
    "lin": """lin AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, c_name, c_acctbal, c_mktsegment,
        n_name AS nation, r_name AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)""",
    "cnt": """cnt AS (SELECT l_returnflag AS plate, CAST(l_suppkey AS VARCHAR) AS cell, p_brand AS gene,
        CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)""",
    "sparse": """sparse AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample, p_brand || '-' || p_type AS gene,
        sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "edge": """edge AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, p_brand AS dst, CAST(count(*) AS DOUBLE) AS weight
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
}


def with_(names: str, *parts: str) -> str:
    """``WITH`` clause from stand-in names and further CTE texts."""
    return "WITH " + ",\n".join([CTE[n] for n in names.split()] + list(parts)) + "\n"


def query(name: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame`` below ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r(value: Column | str, digits: int = 6) -> Column:
    """Round without a negative zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(col) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(col, digits))


def R(value: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"CASE WHEN abs({value}) < {0.5 * 10**-digits:.10f} THEN 0.0 ELSE round({value}, {digits}) END"
