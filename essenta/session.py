"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Rows of one key above which the ordered operators split that key by value range.
SPLIT_ROWS_CONF = "spark.essenta.splitRows"
SPLIT_ROWS_DEFAULT = 1_000_000
# Largest row count a side may have to be broadcast by hint.
BROADCAST_ROWS_CONF = "spark.essenta.broadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000

# Whether Parquet files are read by the file system's vectored reads.
VECTORED_CONF = "parquet.hadoop.vectored.io.enabled"


def local_session(cores: str = "*", app: str = "essenta", partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def split_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SPLIT_ROWS_CONF, str(SPLIT_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint folder.

    ``spark.checkpoint.dir`` wins. Only where it is unset and Spark runs on this
    machine alone is a temporary folder made.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.essenta.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = tempfile.mkdtemp(prefix="essenta-")
        spark.conf.set("spark.essenta.scratch", found)
    return found


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet without vectored reads, unless the session says otherwise.

    On local disks these keep a buffer outside the heap, as large as a column of a row group, in each
    reading thread for as long as the executor lives.
    """
    if spark.conf.get(VECTORED_CONF, None) is None and spark.conf.get(f"spark.hadoop.{VECTORED_CONF}", None) is None:
        spark.conf.set(VECTORED_CONF, "false")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (survives the loss of executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned; it cannot be read afterwards."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName().endswith("LogicalRDD") or "LogicalRDD" in plan.getClass().getName():
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            drop_path(df.sparkSession, file.get())


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps whose frames are gone; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/essenta/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per session, wherever it was started from."""
    context = spark.sparkContext
    if spark.conf.get("spark.essenta.shipped", "") == context.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="essenta-"), "essenta.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.join("essenta", os.path.relpath(file, here)))
    context.addPyFile(path)
    spark.conf.set("spark.essenta.shipped", context.applicationId)


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when ``df`` was counted and is small enough.

    The count stops after ``rows + 1`` rows. A larger side is returned without a hint,
    so the planner shuffles both sides and adaptive execution splits skewed keys.
    """
    from pyspark.sql import functions as F

    limit = rows or broadcast_rows(df.sparkSession)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
