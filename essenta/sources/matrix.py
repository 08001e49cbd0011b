"""Wide labelled matrices as long rows, in either orientation."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from essenta.operators.order import attach


def _cells(line: Column) -> Column:
    """Split a CSV line of any width.

    Cut at quotes, the pieces outside and inside quotes alternate: commas inside are hidden
    while the outside is split. Two quotes inside quotes are one quote.
    """
    pieces = F.split(F.replace(line, F.lit('""'), F.lit("\x01")), '"', -1)
    hidden = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", "\x02")).otherwise(p)), "")
    shown = F.transform(F.split(hidden, ",", -1), lambda c: F.translate(
        F.when(c == "\x01", F.lit("")).otherwise(c), "\x01\x02", '",'))
    return F.when(F.contains(line, F.lit('"')), shown).otherwise(F.split(line, ",", -1))


def read_matrix(
    spark: SparkSession, path: str, row_key: str = "sample", col_key: str = "gene"
) -> DataFrame:
    """Read a CSV whose header holds feature names and whose first column is the row key.

    The lines are read as text, so the number of columns has no limit. Every file below
    ``path`` starts with the same header; another one is an error. Empty and non-numeric cells
    give no row.
    """
    lines = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("line"))
    # only the first lines of files can be headers, and a file's start is known from the scan
    starts = spark.read.text(path).select(
        F.rtrim("value", F.lit("\r")).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).where("at = 0")
    headers = starts.groupBy("file").agg(F.min_by("line", "n").alias("header")).select("header").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"files below {path} have different headers")
    header = headers[0]["header"] if headers else ""
    names = next(csv.reader([header]), [])
    # one row that the driver has read already: its size is that of one line
    known = spark.createDataFrame([(header, names)], "header string, names array<string>")
    both = attach(lines, known).where(F.col("line") != F.col("header"))
    cells = both.select(_cells(F.col("line")).alias("cells"), "names")
    rows = cells.select(
        F.get("cells", F.lit(0)).alias(row_key),
        F.explode(F.slice(F.arrays_zip("names", "cells"), 2, F.size("names"))).alias("pair"),
    )
    return rows.select(
        row_key, F.col("pair.names").alias(col_key), F.col("pair.cells").try_cast("double").alias("value")
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))


def swap_keys(df: DataFrame, first: str, second: str) -> DataFrame:
    """Transpose a long matrix: the two key columns change names."""
    swap = {first: second, second: first}
    return df.select(*[F.col(c).alias(swap.get(c, c)) for c in df.columns])


def as_sample_rows(df: DataFrame, samples: DataFrame, first: str, second: str) -> DataFrame:
    """Return the matrix with its samples in ``first``; transposed when they sit in ``second``.

    The side whose names occur in ``samples`` more often wins.
    """
    known = samples.select(F.col(samples.columns[0]).alias("_name")).distinct()

    def hits(column: str) -> int:
        names = df.select(F.col(column).alias("_name")).distinct()
        return names.join(known, "_name", "left_semi").count()

    return df if hits(first) >= hits(second) else swap_keys(df, first, second)


def write_matrix(df: DataFrame, path: str) -> None:
    """Write a table of modest width as CSV files with a header each."""
    df.write.option("header", True).csv(path)
