"""Helpers shared by the text operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from essenta.session import plain_reads, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Row numbers have room for 2**23 files of 2**40 rows.
FILE_BITS = 40
# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does that by itself on pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (case ignored), made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def reads_files_only(df: DataFrame) -> bool:
    """Whether ``df`` is one set of Parquet files, projected and filtered without chance.

    Then the file and the place in it name a row, however the files are split into tasks.
    Files that are listed twice would repeat these names.
    """
    plan = df._jdf.queryExecution().analyzed()
    lines = plan.toString().splitlines()
    nodes = [re.sub(r"^[\s:+|-]+", "", line).split(" ")[0].split("[")[0] for line in lines]
    if nodes.count("Relation") != 1 or not set(nodes) <= {"Relation", "Project", "Filter", "SubqueryAlias"}:
        return False
    if not lines[-1].rstrip().endswith(" parquet") or not plan.deterministic() or "_metadata" in [c.lower() for c in df.columns]:
        return False
    leaf = plan
    while leaf.children().size():
        leaf = leaf.children().head()
    files = list(leaf.relation().location().inputFiles())
    return len(files) == len(set(files))


class Folder:
    """Tables of one run below the session's shared folder.

    A table written here cuts the lineage and survives the loss of executors. ``drop``
    deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)
        plain_reads(spark)

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def numbered(self, df: DataFrame, rid: str) -> DataFrame:
        """``df`` with a row number that stays the same in every reading, whatever the executors.

        For files it is the file's number and the row's place in the file; task and split numbers
        (``monotonically_increasing_id``) follow the cores of the moment. Other rows are stored.
        """
        if not reads_files_only(df):
            return self.write(df.withColumn(rid, F.monotonically_increasing_id()), "numbered")
        (place,) = own_name(df, "place")
        rows = df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(place))
        # one row per file of a list that the driver has read already
        paths = sorted(r[0] for r in rows.select(f"{place}.file_path").distinct().collect())
        file, first = own_name(rows, "file", "first")
        # from Arrow it is local to the driver; from a list it would start Python workers on the executors
        known = F.broadcast(self.spark.createDataFrame(pa.table({
            file: pa.array(paths, pa.string()), first: pa.array([k << FILE_BITS for k in range(len(paths))], pa.int64())})))
        joined = rows.join(known, F.col(f"{place}.file_path") == F.col(file))
        return joined.select(*df.columns, (F.col(first) + F.col(f"{place}.row_index")).alias(rid))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
